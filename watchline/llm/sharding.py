"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension until every leaf holds
one shard's share of the bytes. DataFrame functions only.

Points are documents, or groups of equal texts, so that copies stay together. Dimensions are the logarithm of the size,
the source and the language (of the group's first document), each on a grid of 2^20. On each dimension a row has a key of
62 bits: coordinate, hash of the text, hash of doc_id. A node with s shards is cut where floor(s / 2) / s of its bytes lie
before the cut. The cut is found by histograms of 2048 bins over the key range of all open nodes at once, narrowed to the
bin that holds the median until that bin weighs little; the driver sees at most 2048 sums a node, whatever the input.
Cuts lie between groups of equal texts; only a group heavier than 2 % of a shard is cut through, by the hash of doc_id.
So the law is `bytes`: the shards' sizes are equal up to that tolerance and to single long documents.

Slots are numbered inside ranges of a shard that hold about 100 000 rows each and are offset by the ranges before.

Edge cases: null and empty texts have size 8 and are equal texts; null source, lang and doc_id are values of their own
(the lowest coordinate; the hash of null); repeated rows are separate rows of one group; an empty table gives an empty
result; columns other than doc_id, text, source and lang are ignored by `assign` and passed through by `sharded`.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import join_small, stored

BINS = 2048
COORD, TEXT, ROW = 20, 20, 22  # bits of a key
DIMS = ("k_size", "k_source", "k_lang")
SHARDS = 24
GROUP_TOLERANCE, TOLERANCE = 0.02, 0.001  # of a shard's bytes
SLOT_ROWS = 100_000


@dataclass
class Node:
    """Shards first .. first + shards - 1; a split node has a dimension, a cut and two children."""
    first: int
    shards: int
    dim: int | None = None
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None

    def column(self) -> Column:
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(DIMS[self.dim]) < self.cut, self.left.column()).otherwise(self.right.column())


def doc_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8


def _code(name) -> Column:
    return F.coalesce(F.shiftrightunsigned(F.crc32(F.col(name).cast("binary")), 32 - COORD), F.lit(0))


def _keys(size: Column, source: Column, lang: Column, text: Column) -> list[Column]:
    low = F.shiftleft(text.bitwiseAND(F.lit((1 << TEXT) - 1)), ROW).bitwiseOR(
        F.xxhash64(F.lit(1), F.col("doc_id")).bitwiseAND(F.lit((1 << ROW) - 1)))
    level = F.least(F.floor(F.log2(size) * (1 << 15)).cast("long"), F.lit((1 << COORD) - 1))
    return [F.shiftleft(c, TEXT + ROW).bitwiseOR(low).alias(k) for c, k in zip((level, source, lang), DIMS)]


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the keys; equal texts share their coordinates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", doc_size().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                        F.xxhash64(text).alias("h"), _code("source").alias("source"), _code("lang").alias("lang"))
    light = stored(light, "points")
    groups = light.groupBy(F.col("h").alias("g")).agg(F.min(F.struct("doc_id", "source", "lang")).alias("m"))
    both = light.join(groups, F.col("h") == F.col("g"))
    return both.select("doc_id", "size", "text_crc32", *_keys(F.col("size"), F.col("m.source"), F.col("m.lang"), F.col("h")))


def _choose(by_node: dict, column: str) -> Column:
    """A column of per-node numbers."""
    out = F.lit(None).cast("long")
    for node, value in by_node.items():
        out = F.when(F.col("node") == node, F.lit(value)).otherwise(out)
    return out.alias(column)


def _cuts(rows: DataFrame, open_nodes: dict, leaf: float) -> None:
    """Set dimension and cut of every open node (by its first shard)."""
    spans = [f(k).alias(f"{w}_{k}") for k in DIMS for w, f in (("lo", F.min), ("hi", F.max))]
    found = rows.groupBy("node").agg(F.sum("size").alias("size"), *spans).collect()  # one row a node
    lo, hi, base, want = {}, {}, {}, {}
    for r in found:
        node = open_nodes[r["node"]]
        width = [(r[f"hi_{k}"] >> (TEXT + ROW)) - (r[f"lo_{k}"] >> (TEXT + ROW)) for k in DIMS]
        node.dim = max(range(len(DIMS)), key=lambda i: (width[i], -i))
        lo[node.first], hi[node.first] = r[f"lo_{DIMS[node.dim]}"], r[f"hi_{DIMS[node.dim]}"] + 1
        base[node.first], want[node.first] = 0, r["size"] * (node.shards // 2) / node.shards
    while lo:
        bins, within = {}, {}
        for n in lo:
            within[n] = lo[n] >> ROW == hi[n] - 1 >> ROW  # inside one group of equal texts
            unit = 1 if within[n] else 1 << ROW
            lo[n] = lo[n] // unit * unit
            bins[n] = -(-(hi[n] - lo[n]) // (BINS * unit)) * unit
        key = F.lit(None).cast("long")
        for n in lo:
            key = F.when(F.col("node") == n, F.col(DIMS[open_nodes[n].dim])).otherwise(key)
        inside = rows.select("node", "size", key.alias("key"), _choose(lo, "lo"), _choose(hi, "hi"), _choose(bins, "step"))
        inside = inside.where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
        sums = inside.groupBy("node", F.floor((F.col("key") - F.col("lo")) / F.col("step")).alias("bin")).agg(
            F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last"))
        seen = {n: [] for n in lo}
        for r in sums.collect():  # at most BINS rows a node
            seen[r["node"]].append((r["bin"], r["size"], r["first"], r["last"]))
        for n, cells in seen.items():
            run = base[n]
            for i, size, first, last in sorted(cells):
                if run + size >= want[n]:
                    break
                run += size
            unit = 1 if within[n] else 1 << ROW
            near = first // unit * unit if want[n] - run <= run + size - want[n] else last // unit * unit + unit
            group = not within[n] and first >> ROW == last >> ROW
            if first == last or size <= leaf * (GROUP_TOLERANCE if group else TOLERANCE):
                open_nodes[n].cut = near
                del lo[n]
            else:
                lo[n], hi[n], base[n] = first, last + 1, run


def tree(rows: DataFrame, shards: int = SHARDS) -> Node:
    """The k-d tree over the keys and sizes of the rows."""
    root = Node(0, shards)
    total = rows.agg(F.sum("size")).first()[0] or 0
    todo = {0: root} if total and shards > 1 else {}
    while todo:
        _cuts(rows.select("size", *DIMS, root.column().alias("node")).where(F.col("node").isin([*todo])), todo, total / shards)
        following = {}
        for node in todo.values():
            if node.dim is None:  # no rows came here
                continue
            half = node.shards // 2
            node.left, node.right = Node(node.first, half), Node(node.first + half, node.shards - half)
            following |= {c.first: c for c in (node.left, node.right) if c.shards > 1}
        todo = following
    return root


def _slots(rows: DataFrame, order: list[str], keep: list[Column], total: int, shards: int) -> DataFrame:
    parts = max(1, -(-total // (shards * SLOT_ROWS)))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(2), F.col("doc_id")), F.lit(parts)))
    counts = rows.groupBy(F.col("_shard").alias("_s"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_s").orderBy("_p")) - F.col("_n")
    counts = counts.select("_s", "_p", before.alias("_before"))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_shard", "_part").orderBy(*order)) - 1)
    out = join_small(rows, counts, (F.col("_shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return out.select(*keep, F.col("_shard").alias("shard"), (F.col("_before") + F.col("_at")).cast("long").alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every document; equal texts stay together where their weight allows."""
    rows = stored(points(docs), "keys")
    placed = rows.withColumn("_shard", tree(rows, shards).column())
    return _slots(placed, ["doc_id", "text_crc32", "size"], [F.col(c) for c in ("doc_id", "size", "text_crc32")],
                  rows.count(), shards)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with shard and slot; columns of the input by these names give way. Coordinates are the document's
    own here, so texts are moved once only, to their shard."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    keys = _keys(doc_size(), _code("source"), _code("lang"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = stored(docs.select("doc_id", doc_size().alias("size"), *keys), "keys")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), "doc_id", *keys)
    placed = packed.withColumn("_shard", tree(rows, shards).column())
    return _slots(placed, ["doc_id", F.crc32(F.col("_row.text").cast("binary"))], [F.col(f"_row.`{c}`") for c in kept],
                  rows.count(), shards)
