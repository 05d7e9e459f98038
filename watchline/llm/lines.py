"""Line deduplication by deletion neighbourhoods: lines within one word of each other (insertion, deletion, substitution)
or equal to each other are copies, and a line stays only if no copy of it comes earlier.

Lines are the \\n-split parts of a text with a word `[^\\x20\\x09-\\x0D]+`; they compare by their words, so white space does
not matter. Lines of fewer than MIN_WORDS words are copies only of equal lines: with one word of four changed, most of a
short line can say something else. Two lines within one word both have MIN_WORDS words. `all_copies` compares every line,
`copies` only those of MIN_WORDS words or more. Order is (doc_id, line number). Only neighbours count, not neighbours of neighbours: a
dropped line names the earliest line within the bound, kept or not.

Two lines at distance one share a variant with a word left out: the same place is left out of both (substitution), or one
of them is whole (insertion, deletion). So variants are hashed to keys, grouped by key and place, and each line meets only
the earliest line of its groups: work and rows are linear in the variants, however many lines share one. Every meeting is
verified by the edit distance of the two word lists. Before variants are made, lines are narrowed to those that share half
their words, their first or their last ones, with another line; any two lines at distance one do, so none is lost.

Edge cases: null and empty texts have no lines; lines without a word are never dropped and never counted; repeated rows of one
doc_id and line number are one occurrence; a null doc_id comes first; empty tables give empty results; other columns are
ignored by `all_copies` and kept by `deduplicated`.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..ship import ship
from .decontaminate import bloom, may_contain
from .tables import same_row, stored, text_key
from .words import hash_words, mixed, record_batch, signed, slices, word_ids

MIN_WORDS = 5
BASE = np.uint64(0x9DDFEA08EB382D69)


def split_lines(texts, shortest=MIN_WORDS):
    """(owner, number, word hashes, word starts, word ends) of every line with at least `shortest` words."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    ids, ends, words = word_ids(lists.flatten())
    hashes = hash_words(words)[ids]
    starts = np.concatenate([[0], ends])[:-1]
    long = np.flatnonzero(ends - starts >= shortest)
    return owner[long], number[long], hashes, starts[long], ends[long]


def _powers(of, n):
    """of^0 .. of^n modulo 2^64."""
    out = np.full(n + 1, of, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prefixes:
    """Polynomial hashes of all runs of a sequence of word hashes."""

    def __init__(self, hashes, seed):
        x = mixed(hashes + np.uint64(seed))
        power = _powers(BASE, len(x))
        # Sums of x[i] * BASE^i; a run's hash is a difference of two, divided by BASE^start.
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:-1], dtype=np.uint64)])

    def raw(self, start, end):
        return self.sum[end] - self.sum[start]

    def run(self, start, end):
        """Hash of words start..end-1, independent of where the run stands."""
        return mixed(self.raw(start, end) * _inverse_power(start) + (end - start).astype(np.uint64))


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _inverse_power(at):
    return _powers(_INVERSE, int(at.max()) if len(at) else 0)[at]


def line_rows(docs: DataFrame, shortest: int = MIN_WORDS) -> DataFrame:
    """doc_id, line, h, h2 (the line's 128-bit name) and the hashes of its halves, null below MIN_WORDS words."""
    ship(docs.sparkSession)
    names = ("doc_id", "line", "h", "h2", "a0", "a1", "b0", "b1")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                owner, number, hashes, start, end = split_lines(part.column("text"), shortest)
                if not len(owner):
                    continue
                one, two = Prefixes(hashes, 1), Prefixes(hashes, 2)
                n, tag = end - start, np.uint64(0xA5A5A5A5)
                low, high = (n - 1) // 2, n // 2
                half = lambda x: pa.array(signed(x), mask=n < MIN_WORDS)
                yield record_batch(schema, [
                    part.column("doc_id").take(pa.array(owner)), number, signed(one.run(start, end)), signed(two.run(start, end)),
                    half(one.run(start, start + low)), half(one.run(start, start + high)),
                    half(one.run(end - low, end) ^ tag), half(one.run(end - high, end) ^ tag)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def distinct_lines(rows: DataFrame) -> DataFrame:
    """One row per line text: h, h2, first (its earliest place), halves."""
    halves = [F.min(c).alias(c) for c in ("a0", "a1", "b0", "b1")]
    return rows.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), *halves)


def may_have_neighbours(lines: DataFrame) -> DataFrame:
    """(h, h2, first) of the lines that share a half with another line."""
    keys = lines.where("a0 is not null").select("h", "h2", "first", F.explode(F.array_distinct(F.array("a0", "a1", "b0", "b1"))).alias("half"))
    shared = keys.groupBy(F.col("half").alias("s")).agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    return keys.join(shared, F.col("half") == F.col("s"), "left_semi").select("h", "h2", "first").distinct()


def line_words(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """h, h2, words (hashes) of the lines whose name may be in the filter."""
    schema = pa.schema([("h", pa.int64()), ("h2", pa.int64()), ("words", pa.list_(pa.int64()))])
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                owner, number, hashes, start, end = split_lines(part.column("text"))
                if not len(owner):
                    continue
                h = Prefixes(hashes, 1).run(start, end)
                hit = np.flatnonzero(may_contain(shared.value, h))
                _, first = np.unique(h[hit], return_index=True)
                hit = hit[first]
                if len(hit):
                    h2 = Prefixes(hashes, 2).run(start, end)[hit]
                    n = (end - start)[hit]
                    ends = np.concatenate([[0], np.cumsum(n)])
                    flat = np.arange(ends[-1]) - np.repeat(ends[:-1] - start[hit], n)
                    words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(hashes)[flat]))
                    yield record_batch(schema, [signed(h[hit]), signed(h2), words])

    return docs.select("text").mapInArrow(run, "h long, h2 long, words array<long>")


def variants(lines: DataFrame) -> DataFrame:
    """key, place, doc_id, line, h: the whole line (place -1) and the line without each of its words."""
    names = ("key", "place", "doc_id", "line", "h", "h2")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column("words")
                n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                end = np.cumsum(n)
                start = end - n
                p = Prefixes(hashes, 1)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(hashes)) - start[row]
                # The words after the gap move one place to the front.
                left, right = p.raw(start[row], start[row] + place), p.raw(start[row] + place + 1, end[row])
                raw = (left + right * _INVERSE) * _inverse_power(start[row])
                out = np.concatenate([p.run(start, end), mixed(raw + (n[row] - 1).astype(np.uint64))])
                who = np.concatenate([np.arange(len(n)), row])
                take = lambda c: part.column(c).take(pa.array(who))
                yield record_batch(schema, [signed(out), np.concatenate([np.full(len(n), -1), place]),
                                            take("doc_id"), take("line"), take("h"), take("h2")])

    return lines.select("words", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"), "h", "h2").mapInArrow(
        run, ", ".join(f"{c} long" for c in names))


def meetings(made: DataFrame) -> DataFrame:
    """(h, h2, eh, eh2): each line with the earliest line of its variant groups, where that is another, earlier one."""
    me = F.struct("doc_id", "line", "h", "h2")
    group = Window.partitionBy("key")
    whole = F.min(F.when(F.col("place") == -1, me)).over(group)
    met = made.select("*", me.alias("me"), whole.alias("whole"), F.min(me).over(group).alias("any"),
                      F.min(me).over(Window.partitionBy("key", "place")).alias("same"))
    best = F.when(F.col("place") == -1, F.col("any")).otherwise(F.least("same", "whole"))  # least skips nulls
    met = met.withColumn("e", best).where(F.col("e") < F.col("me"))
    return met.select("h", "h2", F.col("e.h").alias("eh"), F.col("e.h2").alias("eh2")).distinct()


def within_one(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two word lists are at most one insertion, deletion or substitution apart."""
    n, m = len(left), len(right)
    if abs(n - m) > 1:
        return False
    k = min(n, m)
    differ = np.flatnonzero(left[:k] != right[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(left[::-1][:k] != right[::-1][:k])
    tail = int(differ[0]) if len(differ) else k
    return head + tail >= max(n, m) - 1


def all_copies(docs: DataFrame) -> DataFrame:
    """doc_id, line, first_doc, first_line, distance for every line to drop."""
    return copies(docs, 1)


def copies(docs: DataFrame, shortest: int = MIN_WORDS) -> DataFrame:
    """As all_copies, among lines of at least `shortest` words."""
    rows = stored(line_rows(docs, shortest), "lines")
    lines = stored(distinct_lines(rows), "distinct")
    narrow = stored(may_have_neighbours(lines), "narrow")
    words = line_words(docs, bloom(narrow, "h")).groupBy(F.col("h").alias("_h"), F.col("h2").alias("_h2")).agg(
        F.first("words").alias("words"))
    known = stored(narrow.join(words, (F.col("h") == F.col("_h")) & (F.col("h2") == F.col("_h2"))).select(
        "h", "h2", "first", "words"), "words")
    met = meetings(variants(known))

    def side(prefix):
        return known.select(*[F.col(c).alias(prefix + c) for c in ("h", "h2", "first", "words")])

    both = met.join(side("l_"), (F.col("h") == F.col("l_h")) & (F.col("h2") == F.col("l_h2"))).join(
        side("r_"), (F.col("eh") == F.col("r_h")) & (F.col("eh2") == F.col("r_h2")))
    schema = pa.schema([("h", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int64())])

    def verify(batches):
        for batch in batches:
            left, right = (batch.column(c) for c in ("l_words", "r_words"))
            lv, rv = (x.flatten().to_numpy(zero_copy_only=False) for x in (left, right))
            le, re = (np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in (left, right))
            ls, rs = (np.concatenate([[0], x])[:-1] for x in (le, re))
            good = [within_one(lv[a:b], rv[c:d]) for a, b, c, d in zip(ls, le, rs, re)]
            kept = batch.select(["h", "h2", "doc_id", "line"]).filter(pa.array(good, pa.bool_()))
            yield record_batch(schema, kept.columns)

    near = both.select("h", "h2", F.col("r_first.doc_id").alias("doc_id"), F.col("r_first.line").alias("line"), "l_words",
                       "r_words").mapInArrow(verify, "h long, h2 long, doc_id long, line long")
    near = near.groupBy(F.col("h").alias("nh"), F.col("h2").alias("nh2")).agg(F.min(F.struct("doc_id", "line")).alias("near"))
    found = lines.join(near, (F.col("h") == F.col("nh")) & (F.col("h2") == F.col("nh2")), "left").select(
        F.col("h").alias("gh"), F.col("h2").alias("gh2"), "first", F.least("first", "near").alias("keep"))
    at = F.struct("doc_id", "line")
    out = rows.select("doc_id", "line", "h", "h2").distinct().join(
        found, (F.col("h") == F.col("gh")) & (F.col("h2") == F.col("gh2"))).where(~at.eqNullSafe(F.col("keep")))
    return out.select("doc_id", "line", F.col("keep.doc_id").alias("first_doc"), F.col("keep.line").alias("first_line"),
                      F.when(F.col("keep").eqNullSafe(F.col("first")), 0).otherwise(1).alias("distance"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with their copied lines taken out of the text.

    Rows are told apart by doc_id and text, so lines of rows without a doc_id, or with a shared one, are compared with each
    other too; among rows of one doc_id the order is that of the text keys.
    """
    names = docs.where("text is not null").select(F.col("doc_id").alias("_d"), text_key().alias("_k")).distinct()
    names = stored(names.orderBy(F.col("_d").cast("long"), "_k").select(
        "_d", "_k", F.monotonically_increasing_id().alias("_n")), "names")
    numbered = docs.join(names, same_row("_d", "_k")).select(F.col("_n").alias("doc_id"), "text")
    gone = all_copies(numbered).groupBy(F.col("doc_id").alias("_m")).agg(F.collect_set("line").alias("_gone"))
    gone = names.join(gone, F.col("_n") == F.col("_m")).select("_d", "_k", "_gone")
    out = docs.join(gone, same_row("_d", "_k"), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i.cast("long")))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
