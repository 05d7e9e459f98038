"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and reduced to letters and digits. A document leaks an item when a window of SPAN words of the one
agrees with a window of the other in all but MISSES words, at equal places. Fixed masks find such windows: the places of a
window fall into four interleaved classes (place modulo 4), and each of the six masks reads two classes and ignores two.
Two substitutions touch at most two classes, so one mask reads none of them: no window is missed. Hits on equal hashes are
verified word by word. Items of fewer words are windows of their own: of 8 to 11 words with one substitution, under two masks
that read every other place; of 5 to 7 words whole; of fewer words only where they are a document's whole text.

Only places whose hash may belong to the benchmark leave a scanning task: a Bloom filter of fixed size (2^25 bits) over the
benchmark's hashes is sent to all tasks. A benchmark too large for it lets more places pass to the join, and no fewer.

Equal items (after normalisation) are one class, reported by its smallest item_id and its number of items. Edge cases:
null and empty texts have no words and leak nothing; repeated rows, and rows that share a doc_id, give one row per
(doc_id, item_id); null ids are ids of their own; empty tables give an empty result; further columns are ignored by
`leaks` and kept by `clean`, which decides every row by its own text, whatever doc_id it has or shares.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..ship import ship
from .tables import join_small, stored, text_key
from .words import hash_words, mixed, record_batch, signed, slices, window_hashes, word_ids

SPAN, MISSES, ONE_MISS, SHORTEST = 12, 2, 8, 5
MASKS = tuple(tuple(i for i in range(SPAN) if i % 4 in two) for two in combinations(range(4), 2))
BLOOM_BITS = 25


def tokens(texts: pa.Array):
    """(hash of every normalised word, index after each text's last one)."""
    ids, ends, words = word_ids(texts)
    plain = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pN]+", "")
    full = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)[ids]
    before = np.concatenate([[0], np.cumsum(full)])
    return hash_words(plain)[ids[full]], before[ends]


def masks_of(width):
    """(number, offsets that count, None for all) of the masks for windows of this width.

    Four residues of which two count leave one mask untouched by MISSES changed words; two residues, by one; all, by none.
    """
    if width == SPAN:
        return list(enumerate(MASKS))
    if width >= ONE_MISS:
        return [(40 + r, tuple(range(r, width, 2))) for r in range(2)]
    return [(63, None)]


def misses(width):
    """Changed words that are tolerated in a window of this width, as a column."""
    return F.when(width == SPAN, MISSES).when(width >= ONE_MISS, 1).otherwise(0)


def seeds(hashes, ends, widths=()):
    """Yield (seed hash, first word, width) arrays: windows of SPAN words and of the other widths, under each of their masks.

    Windows of fewer than SHORTEST words are whole texts.
    """
    sizes = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), sizes)
    for width, number, keep in [(w, i, m) for w in (SPAN, *widths) for i, m in masks_of(w)]:
        n = max(0, len(hashes) - width + 1)
        at = np.flatnonzero(owner[:n] == owner[width - 1:]) if n else np.zeros(0, np.int64)
        if width < SHORTEST:
            at = at[sizes[owner[at]] == width]
        tag = np.uint64(width * 64 + number)
        yield mixed(window_hashes(hashes, width, keep)[at] ^ mixed(np.full(1, tag))), at, width


def _rows(schema, ids, owner, starts, hashes, found):
    """A record batch (id, seed, place, words)."""
    seed = np.concatenate([f[0] for f in found])
    at = np.concatenate([f[1] for f in found])
    width = np.concatenate([np.full(len(f[1]), f[2]) for f in found])
    ends = np.concatenate([[0], np.cumsum(width)])
    flat = np.arange(ends[-1]) - np.repeat(ends[:-1] - at, width)
    words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(hashes)[flat]))
    return record_batch(schema, [ids.take(pa.array(owner[at])), signed(seed), at - starts[owner[at]], words])


SCHEMA = pa.schema([("id", pa.int64()), ("seed", pa.int64()), ("place", pa.int64()), ("words", pa.list_(pa.int64()))])
DDL = "id long, seed long, place long, words array<long>"
KEYED = pa.schema([("id", pa.string()), *list(SCHEMA)[1:]])


def item_classes(items: DataFrame) -> DataFrame:
    """item_id (smallest of equal items), n_items, words."""
    ship(items.sparkSession)
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, ends = tokens(part.column("text"))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield record_batch(schema, [part.column("item_id"), pa.ListArray.from_arrays(offsets, signed(hashes))])

    rows = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, words array<long>")
    return rows.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))


def item_seeds(classes: DataFrame) -> DataFrame:
    """id (item), seed, place, words of every window of every item class."""
    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate([[0], ends])[:-1]
            owner = np.repeat(np.arange(len(ends)), ends - starts)
            lengths = ends - starts
            found = [(h, at, w) if w == SPAN else (h[lengths[owner[at]] == w], at[lengths[owner[at]] == w], w)
                     for h, at, w in seeds(hashes, ends, range(1, SPAN))]
            yield _rows(SCHEMA, batch.column("item_id"), owner, starts, hashes, found)

    return classes.select("item_id", "words").mapInArrow(run, DDL)


def bloom(table: DataFrame, column: str = "seed") -> np.ndarray:
    """A filter of 2^BLOOM_BITS bits over a column of hashes, two bits each, put together by Spark."""
    mask = (1 << BLOOM_BITS) - 1
    bit = F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)),
                            F.shiftrightunsigned(column, 64 - BLOOM_BITS))).alias("bit")
    parts = table.select(bit).groupBy(F.shiftrightunsigned("bit", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    for r in parts.collect():  # at most 2^(BLOOM_BITS - 6) rows
        out[r["at"]] = r["bits"]
    return out.view(np.uint8)


def may_contain(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    def test(place):
        return bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
    hit = np.flatnonzero(test(hashes & np.uint64((1 << BLOOM_BITS) - 1)))
    out = np.zeros(len(hashes), bool)
    out[hit[test(hashes[hit] >> np.uint64(64 - BLOOM_BITS)).astype(bool)]] = True
    return out


def doc_seeds(texts: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """texts(id, text), id a long or a string -> id, seed, place, words of the windows whose hash may belong to the benchmark."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    kind = texts.schema["id"].dataType.simpleString()
    schema, ddl = (KEYED, DDL.replace("id long", "id string", 1)) if kind == "string" else (SCHEMA, DDL)

    def run(batches):
        known = shared.value
        for batch in batches:
            for part in slices(batch):
                hashes, ends = tokens(part.column("text"))
                starts = np.concatenate([[0], ends])[:-1]
                owner = np.repeat(np.arange(len(ends)), ends - starts)
                found = []
                for h, at, w in seeds(hashes, ends, widths):
                    hit = may_contain(known, h)
                    found.append((h[hit], at[hit], w))
                if sum(len(f[0]) for f in found):
                    yield _rows(schema, part.column("id"), owner, starts, hashes, found)

    return texts.select("id", "text").mapInArrow(run, ddl)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_items, matched (most equal words in a window), first_word, end_word of the region."""
    return _leaks(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), items).withColumnRenamed("id", "doc_id")


def _leaks(texts: DataFrame, items: DataFrame) -> DataFrame:
    """As `leaks`, of texts(id, text)."""
    classes = stored(item_classes(items), "items")
    known = stored(item_seeds(classes), "seeds")
    widths = sorted(r[0] for r in classes.select(F.size("words").alias("w")).where(
        f"w >= 1 and w < {SPAN}").distinct().collect())  # at most 11 rows
    found = doc_seeds(texts, bloom(known), widths)
    b = known.select(F.col("id").alias("item"), F.col("seed").alias("s"), F.col("words").alias("w"))
    pairs = join_small(found, b, F.col("seed") == F.col("s"), limit=100_000)
    same = F.aggregate(F.zip_with("words", "w", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    width = F.size("w")
    pairs = pairs.where(F.size("words") == width).withColumn("same", same)
    pairs = pairs.where(F.col("same") >= width - misses(width))
    out = pairs.groupBy("id", "item").agg(
        F.max("same").alias("matched"), F.min("place").alias("first_word"),
        F.max(F.col("place") + width).alias("end_word"))
    counts = classes.select(F.col("item_id"), "n_items")
    return join_small(out, counts, F.col("item").eqNullSafe(F.col("item_id"))).select(
        "id", "item_id", "n_items", "matched", "first_word", "end_word")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents whose text leaks no item, with all their columns."""
    found = _leaks(docs.select(text_key().alias("id"), "text"), items)
    keys = stored(found.select(F.col("id").alias("_leak")).distinct(), "leaks")
    return join_small(docs, keys, text_key() == F.col("_leak"), how="left_anti", limit=250_000)
