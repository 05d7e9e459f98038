"""Event scoring pipeline: flags, allowlist, severity, dedup, explanation."""

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULTS, micros
from ..functions import text as X, verdicts as V
from .cooldown import first_per_window

DEDUP_KEY = ("source_ip", "hostname", "service", "message")


def with_flags(events: DataFrame) -> DataFrame:
    return events.withColumn("rule_flags", X.rule_flags(F.col("message")))


def mark_allowlisted(events: DataFrame, cfg=DEFAULTS) -> DataFrame:
    hit = X.is_allowlisted(F.col("source_ip"), F.col("message"), cfg.allowlist_ips, cfg.allowlist_keywords)
    return events.withColumn("allowlisted", hit)


def mark_allowlisted_by(events: DataFrame, ips: DataFrame) -> DataFrame:
    """Allowlist held in a table (one source_ip column); Spark picks the join by the table's size."""
    listed = ips.select("source_ip").distinct().withColumn("_listed", F.lit(True))
    return (events.join(listed, "source_ip", "left")
            .withColumn("allowlisted", F.coalesce("_listed", F.lit(False))).drop("_listed"))


def with_severity(scored: DataFrame, cfg=DEFAULTS) -> DataFrame:
    return scored.withColumn(
        "severity", V.severity(F.col("predicted_label"), F.col("confidence"), F.col("rule_flags"), cfg))


def dedup_anchors(events: DataFrame, cfg=DEFAULTS) -> DataFrame:
    """(event_id, ts_us) of events that open a dedup window.

    An event is known by the SHA-256 of its text fields, so texts of any length shuffle as 32 bytes. The rule flags
    follow from the message and need not be part of it.
    """
    digest = F.unhex(F.sha2(F.concat_ws("|", *DEDUP_KEY), 256))
    keyed = events.select(digest.alias("digest"), "event_id", "ts_us")
    return first_per_window(keyed, ["digest"], micros(cfg.dedup_window_s), inclusive=True).drop("digest")


def mark_duplicates(events: DataFrame, cfg=DEFAULTS) -> DataFrame:
    """Adds `deduplicated`; allowlisted events neither open nor join a window."""
    anchors = dedup_anchors(events.filter(~F.col("allowlisted")), cfg).select(
        "event_id", F.lit(True).alias("_anchor"))
    return (events.join(anchors, "event_id", "left")
            .withColumn("deduplicated", ~F.col("allowlisted") & F.col("_anchor").isNull()).drop("_anchor"))


def detect(scored: DataFrame, cfg=DEFAULTS) -> DataFrame:
    """Full detections from scored events (source columns + allowlisted, predicted_label, confidence)."""
    out = mark_duplicates(with_severity(with_flags(scored), cfg), cfg)
    return out.withColumn("explanation", V.explanation(
        F.col("predicted_label"), F.col("confidence"), F.col("rule_flags"), F.col("allowlisted")))


def detect_with_model(events: DataFrame, model, cfg=DEFAULTS) -> DataFrame:
    """Allowlisted rows skip the model; the rest are scored by a fitted text classifier."""
    from .classify import score_events

    marked = mark_allowlisted(events, cfg)
    skipped = (marked.filter("allowlisted")
               .withColumn("predicted_label", F.lit("benign"))
               .withColumn("confidence", F.lit(cfg.allowlist_confidence)))
    scored = score_events(marked.filter("not allowlisted"), model)
    return detect(skipped.unionByName(scored), cfg)
