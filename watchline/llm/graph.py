"""Connected components by alternating large and small stars; every step is joins and minima on shuffled edges."""

from pyspark.sql import DataFrame, functions as F

from .tables import stored


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))


def _is_done(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on anything."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"), F.lit(True).alias("leaf")).union(
        edges.select("v", F.col("v"), F.lit(False)))
    seen = ends.groupBy("node").agg(F.min(F.when(F.col("leaf"), F.col("root"))).alias("low"),
                                    F.max(F.when(F.col("leaf"), F.col("root"))).alias("high"),
                                    F.bool_and("leaf").alias("leaf"))
    return seen.where("low is not null and (low <> high or not leaf)").isEmpty()


def components(edges: DataFrame, rows: int = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b) other than the roots; root is the smallest node reachable.

    Nodes are of any type with an order. Edges with equal ends are ignored; an empty table gives an empty result. `rows`
    bounds the number of distinct edges, where it is known.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = stored(e.distinct(), "edges", rows)
    while not _is_done(e):
        rows = e.count()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(both.join(_smallest(both), F.col("u") == F.col("c")).where("v > u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")), "large", rows)
        least = _smallest(large)
        small = large.join(least, F.col("u") == F.col("c")).where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        e = stored(small, "edges", 2 * rows)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
