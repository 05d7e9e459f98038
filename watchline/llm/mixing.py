"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

`water_fill` shares a budget over sources by weight; a source is clamped at `max_epochs` of its size and what it cannot
use goes to the others by weight. The level is found in closed form: sources in the order of cap / weight are clamped as
long as their cap lies below the level that the rest would get. `mix` then repeats each source floor(target / size)
times, and takes the remaining fraction as the documents that come first in a seeded order (md5 of seed and doc_id), up
to the wanted size. The order is cut by two prefix sums, over 4096 key ranges and inside one of them, so no task sees a
whole source.

Nulls and edge cases: a null source is a source of its own, last in order; a null text has size 0; a null doc_id orders
as the empty string; rows that share a doc_id are taken or left together; a source of size 0 has target 0 and takes
nothing; an empty table gives an empty result. Other columns are ignored. The sources table has one row per source.
"""

from pyspark.sql import DataFrame, Window, functions as F

from .tables import WORD, join_small, stored

WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def order_key(seed: str = SEED):
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def weighted(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Give the sources, by code point with null last, the weights in turn."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Add target to (source, source_size, weight)."""
    cap = F.col("source_size") * max_epochs
    every = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = every.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = sources.select("*", cap.alias("_cap"),
                       F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("_capped"),
                       F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_used"),
                       (F.sum("source_size").over(whole) * share).alias("_budget"), F.sum("weight").over(whole).alias("_all"))
    level = (F.col("_budget") - F.col("_capped")) / (F.col("_all") - F.col("_used"))
    s = s.withColumn("_level", level).withColumn("_open", F.col("_cap") > F.col("_level") * F.col("weight"))
    s = s.withColumn("_final", F.min(F.when(F.col("_open"), F.struct("_capped", "_level"))).over(whole)["_level"])
    target = F.when(F.col("_open") | F.col("_final").isNull() | (F.col("_cap") > F.col("_final") * F.col("weight")),
                    F.col("_final") * F.col("weight")).otherwise(F.col("_cap").cast("double"))
    return s.select(*sources.columns, F.coalesce(target, F.col("_cap").cast("double")).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: str = SEED):
    """(sized documents, one row per source: source_size, target, whole, cut); a key below cut is taken once more."""
    light = stored(sizes(docs).withColumn("key", order_key(seed)), "mix")
    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    filled = water_fill(weighted(sources, weights), share, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = filled.withColumn("whole", F.floor(ratio)).withColumn(
        "want", F.col("target") - F.col("whole") * F.col("source_size"))
    part = F.substring("key", 1, 3)
    ranges = light.groupBy("source", part.alias("part")).agg(F.sum("size").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy("source").orderBy("part"))
    ranges = ranges.withColumn("base", upto - F.col("sum")).join(
        filled.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    # The first range in which the wanted size is reached; none if all of the source is wanted.
    hit = (ranges.where(F.col("base") + F.col("sum") >= F.col("want")).groupBy("_s")
           .agg(F.min(F.struct("part", "base", "want")).alias("h")).select("_s", "h.*"))
    inside = light.withColumn("p", part).join(
        F.broadcast(hit) if hit.count() <= 100_000 else hit,
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("p") == F.col("part")))
    keys = inside.groupBy("_s", "part", "base", "want", "key").agg(F.sum("size").alias("sum"))
    run = F.col("base") + F.sum("sum").over(Window.partitionBy("_s").orderBy("key")) - F.col("sum")
    over = keys.withColumn("run", run).groupBy("_s", "part").agg(
        F.min(F.when(F.col("run") + F.col("sum") / 2 > F.col("want"), F.col("key"))).alias("first"))
    # No key of the range is left out: the cut lies behind the range ('g' sorts after every hex digit).
    cuts = over.select(F.col("_s").alias("_c"), F.coalesce("first", F.concat("part", F.lit("g"))).alias("cut"))
    filled = filled.join(cuts, F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c", "want")
    return light, stored(filled, "mix-sources")


def taken_times(key):
    """How often the mix takes a row, from its key and its source's plan."""
    return F.col("whole") + F.when(key < F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for every document."""
    light, filled = plan(docs, **how)
    s = filled.withColumnRenamed("source", "_s")
    out = join_small(light, s, F.col("source").eqNullSafe(F.col("_s")))
    times = F.when(F.col("size") > 0, taken_times(F.col("key"))).otherwise(0).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("times"),
                      (times * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    _, filled = plan(docs, **how)
    s = filled.select(F.col("source").alias("_mix_source"), "whole", "cut")
    s = s.select("_mix_source", F.struct("whole", "cut").alias("_mix_plan"))
    seed = how.get("seed", SEED)
    out = join_small(docs, s, F.col("source").eqNullSafe(F.col("_mix_source")))
    times = F.col("_mix_plan.whole") + F.when(order_key(seed) < F.col("_mix_plan.cut"), 1).otherwise(0)
    some = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    out = out.where(some).withColumn("_mix_times", times).where(F.col("_mix_times") > 0)
    out = out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
