"""Alert table operators: storage filter, forwarding, counts, paging, eviction."""

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULTS, micros


def storable(detections: DataFrame) -> DataFrame:
    return detections.filter((F.col("predicted_label") != "benign") & ~F.col("deduplicated"))


def forwardable(detections: DataFrame, cfg=DEFAULTS) -> DataFrame:
    return (detections.filter(F.col("predicted_label").isin(*cfg.forward_labels))
            .withColumn("honeypot_sent", F.lit(True)))


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Total, forwarded total and counts by label and by severity, in one aggregation."""
    flagged = alerts.withColumn("_sent", F.col("honeypot_sent").cast("long"))
    sets = flagged.groupingSets(
        [[], [F.col("predicted_label")], [F.col("severity")]], F.col("predicted_label"), F.col("severity")
    ).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_sent"), F.lit(0)).alias("forwarded"),
          F.grouping_id().alias("_g"))
    kind = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "label").otherwise("severity")
    return sets.select(kind.alias("kind"),
                       F.coalesce("predicted_label", "severity", F.lit("all")).alias("name"),
                       "n", F.col("forwarded").cast("long").alias("forwarded"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def alerts_page(alerts: DataFrame, limit=50, offset=0, label=None, severity=None, order="event_id") -> DataFrame:
    """Newest first; limit is 1..500 as the read API allows."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    if label:
        alerts = alerts.filter(F.col("predicted_label") == label)
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    return alerts.orderBy(F.col(order).desc()).offset(offset).limit(limit)


def evict_idle(df: DataFrame, key: str, ts: str, now_us, idle_s: float) -> DataFrame:
    """Rows of keys seen within idle_s of now_us; older keys are forgotten."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    live = df.groupBy(key).agg(F.max(ts).alias("_last")).filter(now - F.col("_last") <= micros(idle_s))
    return df.join(live.select(key), key, "left_semi")
