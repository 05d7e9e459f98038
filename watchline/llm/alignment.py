"""Alignment of two tokenizers over the same text by divide and conquer at shared cuts.

A text (with a space in front) is tokenized by A and by B; offsets in bytes where tokens of both end cut it into groups, and
every A token is linked with every B token of its group. An interval of tokens is divided at a common end near its middle:
the A end in the middle is looked up among the B ends by bisection, then those around it in windows that double; both halves
are divided again. An interval without a common end inside is a group. All intervals of one depth, of all texts of a slice,
are handled together.

How many documents hold an id pair linked is counted over the whole corpus. Texts are read once, in slices of 1 MB; a slice
is stored with the links of its documents as numbers of pairs, and a list of its distinct pairs. Only these lists are
shuffled: counted by pair (combined before the shuffle), joined with the counts, and sent back to their slice, where the
documents' sums are taken. Nothing that grows with the corpus is broadcast; the highest count of each A id has as many rows as
the vocabulary has entries. A pair that occurs everywhere is one row for each slice.

Edge cases: null and empty texts, and texts whose bytes either tokenizer changes, have no tokens and count for nothing; a
group of any size is linked whole, in runs of bounded length; a repeated row is a document of its own; a null doc_id stays
null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..ship import ship
from .tables import stored
from .tokens import expand, pair_of, spaced_pieces, spread, tokenizer_path
from .words import record_batch, slices

LINKS = 1_000_000
SLICE = 1 << 20  # bytes of text that are aligned at once
NO_HASH = ""


def divide(a_ends, b_ends, lo, hi, lo_b, hi_b):
    """Groups (first A, end of A, first B, end of B) of intervals of tokens [lo, hi) and [lo_b, hi_b) that end together.

    Ends are offsets in bytes, increasing over all intervals.
    """
    now = np.stack([lo, hi, lo_b, hi_b])
    found = [now[:, :0]]
    while now.shape[1]:
        whole = (now[1] - now[0] == 1) | (now[3] - now[2] == 1)
        found.append(now[:, whole])
        now = now[:, ~whole]
        cut, at_b, leaf = middle_cuts(a_ends, b_ends, now)
        found.append(now[:, leaf])
        now, cut, at_b = now[:, ~leaf], cut[~leaf], at_b[~leaf]
        left, right = np.stack([now[0], cut + 1, now[2], at_b + 1]), np.stack([cut + 1, now[1], at_b + 1, now[3]])
        now = np.stack([left, right], axis=2).reshape(4, -1)
    out = np.concatenate(found, axis=1)
    return out[:, np.argsort(out[0], kind="stable")]


def bisected(a_ends, b_ends, at):
    """For A tokens: whether a B token ends where they end, and which."""
    j = np.searchsorted(b_ends, a_ends[at])
    return b_ends[np.minimum(j, len(b_ends) - 1)] == a_ends[at], j


def middle_cuts(a_ends, b_ends, now):
    """For every interval the A and B token that end together nearest to the middle, and whether there are none."""
    first, last = now[0], now[1] - 2  # tokens that end inside
    middle = (first + last) // 2
    hit, at_b = bisected(a_ends, b_ends, middle)
    cut = middle.copy()
    open_ = np.flatnonzero(~hit)
    inner, outer = 0, 2
    while len(open_):
        starts = np.stack([np.maximum(middle[open_] - outer, first[open_]), middle[open_] + inner + 1], 1)
        stops = np.stack([middle[open_] - inner, np.minimum(middle[open_] + outer, last[open_]) + 1], 1)
        sizes = np.maximum(stops - starts, 0).ravel()
        at = spread(starts.ravel(), sizes)
        who = np.repeat(np.arange(len(open_)), sizes.reshape(-1, 2).sum(1))
        same, j = bisected(a_ends, b_ends, at) if len(at) else (np.zeros(0, bool), at)
        at, who, j = at[same], who[same], j[same]
        order = np.lexsort((np.abs(at - middle[open_][who]), who))
        _, nearest = np.unique(who[order], return_index=True)
        pick = order[nearest]
        cut[open_[who[pick]]], at_b[open_[who[pick]]] = at[pick], j[pick]
        hit[open_[who[pick]]] = True
        open_ = open_[~hit[open_] & ((middle[open_] - outer > first[open_]) | (middle[open_] + outer < last[open_]))]
        inner, outer = outer, 4 * outer
    return cut, at_b, ~hit


class Aligner:
    """Texts of an Arrow column, tokenized and cut into groups; rows without tokens have none."""

    def __init__(self, texts, pair):
        n = len(texts)
        filled = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
        rows = np.flatnonzero(filled.to_numpy(zero_copy_only=False))
        pieces, piece_ends = spaced_pieces(texts.filter(filled))
        kept, sides = np.ones(len(rows), bool), []
        for ids, ends in expand(pieces, piece_ends, pair.pieces):
            changed = np.concatenate([[0], np.cumsum(ids < 0)])
            starts = np.concatenate([[0], ends])[:-1]
            kept &= (ends > starts) & (changed[ends] == changed[starts])
            sides.append((ids, starts, ends))
        self.rows = rows[kept]  # rows of the column that have tokens
        self.n = n
        self.a, self.a_starts, self.a_stops = self._side(*sides[0], kept)
        self.b, self.b_starts, self.b_stops = self._side(*sides[1], kept)
        self.a_ends, self.b_ends = np.cumsum(pair.length_a[self.a]), np.cumsum(pair.length_b[self.b])
        self.groups = divide(self.a_ends, self.b_ends, self.a_starts, self.a_stops, self.b_starts, self.b_stops)
        self.group_row = np.searchsorted(self.a_stops, self.groups[0], side="right")  # index into rows

    @staticmethod
    def _side(ids, starts, ends, kept):
        counts = (ends - starts)[kept]
        stops = np.cumsum(counts)
        return ids[spread(starts[kept], counts)], stops - counts, stops

    def counts(self):
        """n_a, n_b, n_groups, n_links of the rows that have tokens."""
        links = (self.groups[1] - self.groups[0]) * (self.groups[3] - self.groups[2])
        n = len(self.rows)
        return (self.a_stops - self.a_starts, self.b_stops - self.b_starts, np.bincount(self.group_row, minlength=n),
                np.bincount(self.group_row, weights=links, minlength=n).astype(np.int64))

    def texts(self, table):
        """`a1,a2|b1;a3|b2,b3` of every row, as bytes; `table` holds the ids with the marks after them."""
        strings, base = table
        lo, hi, lo_b, hi_b = self.groups
        n_a, n_b = len(self.a), len(self.b)
        size_a, size_b = hi - lo, hi_b - lo_b
        last_a, last_b, last = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64), np.zeros(n_b, np.int64)
        last_a[hi - 1], last_b[hi_b - 1], last[self.b_stops - 1] = 1, 1, 1
        code = np.zeros(n_a + n_b, np.int64)
        code[np.arange(n_a) + np.repeat(lo_b, size_a)] = self.a * 2 + last_a
        code[np.arange(n_b) + np.repeat(hi, size_b)] = base + self.b * 3 + last_b + last
        joined = strings.take(pa.array(code))
        offsets = np.frombuffer(joined.buffers()[1], np.int32)
        data = memoryview(joined.buffers()[2] or b"")
        ends = offsets[(self.a_stops + self.b_stops)]
        starts = offsets[(self.a_starts + self.b_starts)]
        return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]

    def links(self, limit=LINKS):
        """(row, a, b, times) arrays of the linked id pairs of each row; a run of rows at a time, rows in order.

        Pairs of one row are distinct. Long groups are expanded in runs of A tokens.
        """
        lo, hi, lo_b, hi_b = self.groups
        group = np.repeat(np.arange(len(lo)), hi - lo)
        each = (hi_b - lo_b)[group]
        ends = np.cumsum(each)
        out, start = [], 0
        shift = int(self.b.max(initial=0)).bit_length()
        width = shift + int(self.a.max(initial=0)).bit_length()
        while start < len(each):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
            a = np.repeat(np.arange(start, stop), each[start:stop])
            b = spread(lo_b[group[start:stop]], each[start:stop])
            key = (self.group_row[group[a]].astype(np.int64) << width) | (self.a[a].astype(np.int64) << shift) | self.b[b]
            out.append(np.unique(key, return_counts=True))
            start = stop
        if not out:
            return (np.zeros(0, np.int64),) * 4
        key, times = np.concatenate([k for k, _ in out]), np.concatenate([t for _, t in out])
        if len(out) > 1:  # a row may lie in two runs
            key, back = np.unique(key, return_inverse=True)
            times = np.bincount(back, weights=times, minlength=len(key)).astype(np.int64)
        return key >> width, (key >> shift) & ((1 << (width - shift)) - 1), key & ((1 << shift) - 1), times


_marked = {}


def marked_ids(pair):
    """(strings, index of the first B string): every id with `,` or `|` after it, for B with `,`, `;` or nothing."""
    if id(pair) not in _marked:
        a, b = len(pair.bytes_a), len(pair.bytes_b)
        _marked[id(pair)] = (pa.array([f"{i}{m}" for i in range(a) for m in ",|"] + [f"{i}{m}" for i in range(b) for m in (",", ";", "")],
                                      pa.string()), 2 * a)
    return _marked[id(pair)]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for every slice: block, packed columns of its documents and of their links, and its distinct pairs.

    doc_ids, null_ids, numbers (n_a, n_b, n_groups, n_links), hashes, sizes (distinct pairs of each document) and links (index of
    the pair, times) are little-endian arrays in binary columns; pairs holds (a << 32 | b, documents of the slice).
    """
    ship(docs.sparkSession)
    binary = ("doc_ids", "null_ids", "numbers", "hashes", "sizes", "links")
    kind = pa.struct([("pair", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in binary] + [("pairs", pa.list_(kind))])

    def run(batches):
        pair = pair_of(path_a, path_b)
        table = marked_ids(pair)
        block = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                x = Aligner(part.column("text"), pair)
                row, a, b, times = x.links()
                key, index, n = np.unique((a << 32) | b, return_inverse=True, return_counts=True)
                numbers = np.zeros((4, x.n), "<i8")
                numbers[:, x.rows] = x.counts()
                sizes = np.zeros(x.n, "<i8")
                sizes[x.rows] = np.bincount(row, minlength=len(x.rows))
                hashes = [b""] * x.n
                for i, text in zip(x.rows.tolist(), x.texts(table)):
                    hashes[i] = hashlib.sha256(text).digest()
                ids = part.column("doc_id")
                held = [pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                        ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes(), numbers.tobytes(),
                        b"".join(h or bytes(32) for h in hashes), sizes.tobytes(), np.stack([index, times]).astype("<u4").tobytes()]
                pairs = pa.StructArray.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([h], pa.binary()) for h in held], lists],
                                                 schema=schema)
                block += 1

    ddl = "block long, " + ", ".join(f"{c} binary" for c in binary) + ", pairs array<struct<pair: long, n: long>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def pair_counts(entries: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no other pair of its A id has more)."""
    counts = stored(entries.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    # One row for each entry of A's vocabulary, whatever the corpus.
    return counts.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str = None, path_b: str = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    blocks = stored(aligned(docs, path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")),
                    "blocks")
    entries = blocks.select("block", F.posexplode("pairs").alias("at", "entry")).select(
        "block", F.col("at").cast("long"), F.col("entry.pair").alias("pair"), F.col("entry.n").alias("n"))
    counts = pair_counts(entries).select(F.col("pair").alias("p"), F.col("n").alias("total"), "best")
    back = entries.select("block", "at", "pair").join(counts, F.col("pair") == F.col("p")).groupBy(F.col("block").alias("b")).agg(
        F.collect_list(F.struct("at", (F.col("total") * 2 + F.col("best").cast("long")).alias("v"))).alias("known"))
    both = blocks.drop("pairs").join(back, F.col("block") == F.col("b"), "left").drop("b", "block")
    longs = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = pa.schema([(c, pa.int64()) for c in longs] + [("groups_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: E731,B023
                ids, null, sizes = get("doc_ids", "<i8"), get("null_ids", "u1").astype(bool), get("sizes", "<i8")
                numbers = get("numbers", "<i8").reshape(4, -1)
                index, times = get("links", "<u4").reshape(2, -1).astype(np.int64)
                known = batch.column("known")[i].values
                value = np.zeros(0 if known is None else len(known), np.int64)
                if len(value):
                    value[known.field("at").to_numpy(zero_copy_only=False)] = known.field("v").to_numpy(zero_copy_only=False)
                before = lambda x: np.concatenate([[0], np.cumsum(x)])
                ends = np.cumsum(sizes)
                total, best = before(times * (value >> 1)[index]), before(times * (value & 1)[index])
                of = lambda x: x[ends] - x[ends - sizes]  # noqa: E731,B023
                digests = get("hashes", "u1").tobytes().hex()
                texts = [digests[64 * k:64 * k + 64] if n else NO_HASH for k, n in enumerate(numbers[0].tolist())]
                yield record_batch(schema, [pa.array(ids, mask=null), *numbers, of(best), of(total), pa.array(texts)])

    return both.mapInArrow(run, ", ".join(f"{c} long" for c in longs) + ", groups_sha256 string")


def groups(docs: DataFrame, path_a: str = None, path_b: str = None) -> DataFrame:
    """doc_id, a (ids), b (ids), start, end (bytes of space + text) of every group of every document."""
    ship(docs.sparkSession)
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("a", ints), ("b", ints), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        pair = pair_of(path_a, path_b)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                x = Aligner(part.column("text"), pair)
                if not len(x.rows):
                    continue
                lo, hi, lo_b, hi_b = x.groups
                base = np.concatenate([[0], x.a_ends])[x.a_starts][x.group_row]
                lists = [pa.ListArray.from_arrays(pa.array(np.append(s, len(v)), pa.int32()), pa.array(v, pa.int32()))
                         for s, v in ((lo, x.a), (lo_b, x.b))]
                ids = part.column("doc_id").take(pa.array(x.rows[x.group_row]))
                yield record_batch(schema, [ids, *lists, np.concatenate([[0], x.a_ends])[lo] - base, x.a_ends[hi - 1] - base])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, a array<int>, b array<int>, start long, end long")
