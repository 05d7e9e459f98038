"""Slope-fluctuation profiling of per-node packet counts. One row per node and tick throughout."""

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULTS


def slopes(ticks: DataFrame, key: str, cfg=DEFAULTS) -> DataFrame:
    """Adds points, slope (least squares over the last counts) and fluctuation (change of slope) per tick."""
    order = Window.partitionBy(key).orderBy("tick")
    recent = order.rowsBetween(-(cfg.amof_history - 1), 0)
    numbered = ticks.withColumn("_i", F.row_number().over(order)).withColumn(
        "_y", F.col("packet_count").cast("double"))
    fitted = (numbered.withColumn("points", F.least(F.col("_i"), F.lit(cfg.amof_history)))
              .withColumn("slope", F.when(F.col("_i") >= 2, F.regr_slope("_y", F.col("_i").cast("double")).over(recent))
                          .otherwise(0.0)))
    trusted = F.when(F.col("points") >= cfg.amof_min_points, F.col("slope"))
    return fitted.withColumn("fluctuation", F.abs(trusted - F.lag(trusted).over(order))).drop("_i", "_y")


def _accumulated(sloped: DataFrame, key: str, cfg) -> DataFrame:
    """Per node: accumulated fluctuation, the tick it latched at (null if never) and its value at that tick."""
    steps = sloped.filter(F.col("points") >= cfg.amof_min_points).groupBy(key).agg(F.sort_array(F.collect_list(
        F.struct("tick", F.coalesce("fluctuation", F.lit(0.0)).alias("f")))).alias("steps"))
    tick_type = sloped.schema["tick"].dataType
    start = F.struct(F.lit(0.0).alias("a"), F.lit(None).cast(tick_type).alias("latched"))

    def step(acc, s):
        grown = acc["a"] + s["f"]
        return F.when(grown >= cfg.amof_threshold, F.struct(
            grown.alias("a"), F.coalesce(acc["latched"], s["tick"]).alias("latched"))
        ).otherwise(F.struct((grown * cfg.amof_decay).alias("a"), acc["latched"].alias("latched")))

    return steps.select(key, F.aggregate("steps", start, step).alias("s")).select(key, "s.a", "s.latched")


def amof(ticks: DataFrame, key: str, cfg=DEFAULTS) -> DataFrame:
    """Anomalous (key, tick) rows: once the accumulated fluctuation reaches the threshold it no longer decays."""
    sloped = slopes(ticks, key, cfg)
    found = _accumulated(sloped, key, cfg).filter(F.col("latched").isNotNull()).select(key, "latched")
    return (sloped.join(found, key).filter(F.col("tick") >= F.col("latched"))
            .select(key, "tick", "slope", F.col("latched").alias("first_anomalous_tick")))


def amof_state(ticks: DataFrame, key: str, cfg=DEFAULTS) -> DataFrame:
    """Per node: accumulated fluctuation, last slope, history length and the last slopes."""
    sloped = slopes(ticks, key, cfg)
    last = sloped.groupBy(key).agg(
        F.max("points").alias("count_history_len"),
        F.max_by("slope", F.when(F.col("points") >= cfg.amof_min_points, F.col("tick"))).alias("_last"),
        F.sort_array(F.collect_list(F.when(F.col("points") >= cfg.amof_min_points, F.struct(
            F.col("tick"), F.round("slope", 4).alias("s"))))).alias("_steps"))
    last = last.withColumn("_slopes", F.col("_steps.s"))
    tail = F.when(F.size("_slopes") > cfg.amof_slopes, F.slice("_slopes", -cfg.amof_slopes, cfg.amof_slopes)
                  ).otherwise(F.col("_slopes"))
    return (last.join(_accumulated(sloped, key, cfg), key, "left")
            .select(key, F.round(F.coalesce("a", F.lit(0.0)), 4).alias("accumulated_fluctuation"),
                    F.round(F.coalesce("_last", F.lit(0.0)), 4).alias("last_slope"), "count_history_len",
                    tail.alias("slope_history")))
