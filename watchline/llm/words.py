"""Words of Arrow text columns as integer ids, and stable 64-bit hashes of them. Used inside tasks."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 2 << 20


def slices(batch, column="text", limit=SLICE_BYTES):
    """Cut a record batch into pieces of about `limit` bytes of text (one long text may exceed it)."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts):
    """(words, ends): all words `[^\\x20\\x09-\\x0D]+` in order, and per text the index after its last one."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values = lists.flatten()
    real = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    return values.filter(real), before[offsets[1:]]


def word_ids(texts):
    """(ids, ends, dictionary): equal words have equal ids within this column."""
    words, ends = split_words(texts)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, coded.dictionary


def hash_words(words):
    """Stable unsigned 64-bit hashes of an Arrow string array."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mixed(x):
    """Scramble 64-bit values (finaliser of a multiply-xorshift generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes, width, keep=None):
    """Hash of every window of `width` consecutive entries; `keep` names the offsets that count."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for i in (range(width) if keep is None else keep):
        out = out * MIX
        out ^= out >> np.uint64(29)
        out += hashes[i:i + n]
    return mixed(out)


def signed(x):
    return x.view(np.int64)


def record_batch(schema, columns):
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                                       for c, f in zip(columns, schema)], schema=schema)
