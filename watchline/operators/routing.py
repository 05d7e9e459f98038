"""Routing anomalies: mutual parent claims and forwarding drops."""

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULTS, micros
from ..functions import text as X


def wormhole_claims(events: DataFrame, key: str = "source_ip") -> DataFrame:
    """Parent claims (key, parent, event_id, ts_us) answered by an earlier claim the other way round.

    Claims never expire; a node that names itself is flagged at once. The first claim per pair is aggregated on the
    map side, and each claim meets at most one row, so repeated claims of one pair do not multiply.
    """
    claims = (events.select(F.lower(key).alias("child"), X.rpl_parent(F.col("message")).alias("parent"),
                            F.col(key), "event_id", "ts_us").filter(F.col("parent").isNotNull()))
    when = F.struct("ts_us", "event_id")
    first = claims.groupBy(F.col("child").alias("_parent"), F.col("parent").alias("_child")).agg(
        F.min(when).alias("_first"))
    hit = claims.join(first, (F.col("child") == F.col("_child")) & (F.col("parent") == F.col("_parent")))
    return hit.filter(F.col("_first") <= when).select(key, "parent", "event_id", "ts_us")


def forward_ticks(events: DataFrame, tick_us: int, key: str = "source_ip") -> DataFrame:
    """(key, tick, packet_count): messages per tick; fwd_count=n sets the count to n, later messages add one."""
    n = X.forward_count(F.col("message"))
    rows = events.select(key, F.floor(F.col("ts_us") / tick_us).alias("tick"), F.struct("ts_us", "event_id").alias("at"),
                         n.alias("n"))
    last = rows.groupBy(key, "tick").agg(
        F.max_by("n", F.when(F.col("n").isNotNull(), F.col("at"))).alias("set_to"),
        F.max(F.when(F.col("n").isNotNull(), F.col("at"))).alias("set_at"), F.count(F.lit(1)).alias("all"))
    has_set = last.filter(F.col("set_at").isNotNull())
    later = (rows.join(has_set.select(key, "tick", "set_at"), [key, "tick"]).filter(F.col("at") > F.col("set_at"))
             .groupBy(key, "tick").agg(F.count(F.lit(1)).alias("later")))
    return last.join(later, [key, "tick"], "left").select(key, "tick", F.coalesce(
        F.col("set_to") + F.coalesce("later", F.lit(0)), "all").alias("packet_count"))


def rolling_baseline(ticks: DataFrame, key: str, cfg=DEFAULTS) -> DataFrame:
    """Adds points, mean and sample deviation over up to `blackhole_history` earlier ticks.

    One row per key and tick, so a key's partition grows with elapsed time only, not with its traffic.
    """
    before = Window.partitionBy(key).orderBy("tick").rowsBetween(-cfg.blackhole_history, -1)
    return (ticks.withColumn("points", F.count("packet_count").over(before))
            .withColumn("mean", F.avg("packet_count").over(before))
            .withColumn("std", F.coalesce(F.when(F.col("points") >= 2, F.stddev_samp("packet_count").over(before)),
                                          F.lit(0.0))))


def blackhole(ticks: DataFrame, key: str, cfg=DEFAULTS) -> DataFrame:
    """Completed ticks whose count falls below mean - sigma * std of the node's own history."""
    base = rolling_baseline(ticks, key, cfg).withColumn(
        "threshold", F.col("mean") - F.lit(float(cfg.blackhole_sigma)) * F.col("std"))
    return base.filter((F.col("points") >= cfg.blackhole_min_points) & (F.col("std") > 0)
                       & (F.col("packet_count") < F.col("threshold")))


def blackhole_events(events: DataFrame, key: str = "source_ip", cfg=DEFAULTS) -> DataFrame:
    return blackhole(forward_ticks(events, micros(cfg.blackhole_tick_s), key), key, cfg)
