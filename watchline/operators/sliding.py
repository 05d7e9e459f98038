"""Sliding-window counts per key in linear time, split over time buckets.

A candidate row covers the interval [ts, ts + window]; the sliding count at a row is the number of
intervals covering it. For distinct counts a value's interval ends early where the value comes again.
Intervals become +1 / -1 steps and the count is their running sum, so a row costs the same however many
rows its window holds. Steps are cut at bucket borders, so a busy key spreads over (key, bucket) tasks.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import SECOND_US


class Sliding:
    """One sliding count: candidate rows, window length, and the value counted distinctly (if any)."""

    def __init__(self, candidate: Column, window_us: int, distinct: Column = None):
        self.candidate, self.window_us, self.distinct = candidate, window_us, distinct


def sliding_counts(events: DataFrame, specs: dict, key: str = "source_ip", bucket_us: int = None) -> DataFrame:
    """(key, event_id, ts_us, one long column per spec) for every event; windows include both ends and peers."""
    bucket_us = max([bucket_us or 60 * SECOND_US] + [s.window_us for s in specs.values()])
    names = list(specs)
    slot = {n: f"_d{i}" for i, n in enumerate(names)}
    plain = [n for n in names if specs[n].distinct is None]
    base = events.select(
        key, "event_id", "ts_us", F.floor(F.col("ts_us") / bucket_us).alias("_b"),
        *[F.coalesce(specs[n].candidate, F.lit(False)).alias(f"_c{slot[n]}") for n in names],
        *[specs[n].distinct.cast("string").alias(f"_v{slot[n]}") for n in names if n not in plain])

    def step(bucket, at, delta, event=None):
        return F.struct(
            bucket.alias("_b"), at.alias("ts_us"),
            (event if event is not None else F.lit(None).cast("long")).alias("event_id"),
            *[delta.get(n, F.lit(0)).cast("long").alias(slot[n]) for n in names])

    ts, b = F.col("ts_us"), F.col("_b")
    border = (b + 1) * bucket_us
    steps = [step(b, ts, {n: F.col(f"_c{slot[n]}").cast("long") for n in plain}, F.col("event_id"))]
    for n in plain:
        cand, stop = F.col(f"_c{slot[n]}"), ts + F.lit(specs[n].window_us + 1)
        steps.append(F.when(cand & (stop < border), step(b, stop, {n: F.lit(-1)})))
        steps.append(F.when(cand & (stop > border), step(b + 1, border, {n: F.lit(1)})))
        steps.append(F.when(cand & (stop > border) & (stop < border + bucket_us), step(b + 1, stop, {n: F.lit(-1)})))
    # Missing steps are null and dropped after the explode, which keeps the whole projection in generated code.
    moves = base.select(key, F.explode(F.array(*steps)).alias("s")).filter("s is not null").select(key, "s.*")

    for n in names:
        if n in plain:
            continue
        width = specs[n].window_us
        seen = base.filter(F.col(f"_c{slot[n]}") & F.col(f"_v{slot[n]}").isNotNull())
        # A row near a bucket's end also counts in the next bucket.
        seen = seen.select(key, "ts_us", F.col(f"_v{slot[n]}").alias("_v"), F.explode(
            F.when(ts + width >= border, F.array(b, b + 1)).otherwise(F.array(b))).alias("_b"))
        again = F.lead("ts_us").over(Window.partitionBy(key, "_b", "_v").orderBy("ts_us"))
        low, high = b * bucket_us, (b + 1) * bucket_us
        spans = (seen.withColumn("_from", F.greatest(ts, low))
                 .withColumn("_stop", F.least(ts + (width + 1), again))
                 .filter(F.col("_stop") > F.col("_from")))
        both = F.array(step(b, F.col("_from"), {n: F.lit(1)}),
                       F.when(F.col("_stop") < high, step(b, F.col("_stop"), {n: F.lit(-1)})))
        moves = moves.unionByName(
            spans.select(key, F.explode(both).alias("s")).filter("s is not null").select(key, "s.*"))

    order = Window.partitionBy(key, "_b").orderBy("ts_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (moves.select(key, "event_id", "ts_us", *[F.sum(slot[n]).over(order).alias(n) for n in names])
            .filter(F.col("event_id").isNotNull()))


def rate_per_second(events: DataFrame, window_us: int, key: str = "source_ip") -> DataFrame:
    counted = sliding_counts(events, {"n": Sliding(F.lit(True), window_us)}, key)
    return counted.withColumn("rate", F.col("n") / F.lit(window_us / SECOND_US))
