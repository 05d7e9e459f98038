"""Connected components of an undirected graph."""

from pyspark.sql import DataFrame, functions as F

from ..storage import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (src, dst): root is the smallest node that can be reached.

    Every node points to the smallest one it has heard of. A round tells each node the pointers of its neighbours (hook),
    then lets it jump to its pointer's pointer (shortcut); both are a join and a minimum by node, so a hub is one skewed join key
    and never one task's list. Rounds grow with the logarithm of the longest path in practice; they end when nothing moves.
    """
    both = checkpointed(edges.select("src", "dst").union(edges.select("dst", "src")).where(
        "src is not null and dst is not null").distinct())
    roots = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("root")))
    while True:
        heard = both.join(roots, both.dst == roots.node).groupBy("src").agg(F.min("root").alias("heard"))
        hooked = roots.join(heard, roots.node == heard.src, "left").select(
            "node", "root", F.least("root", "heard").alias("low"))
        # A root takes the lowest pointer that any of its followers has heard of, so whole trees move together.
        told = hooked.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("told"))
        moved = hooked.join(told, hooked.root == told.r, "left").select("node", "root", F.least("low", "told").alias("low"))
        ups = moved.select(F.col("node").alias("n"), F.col("low").alias("up"))
        jumped = moved.join(ups, moved.low == ups.n, "left").select("node", F.col("root").alias("was"), F.least("low", "up").alias("root"))
        jumped = checkpointed(jumped)
        roots = jumped.select("node", "root")
        if jumped.where("was <> root").isEmpty():
            return roots
