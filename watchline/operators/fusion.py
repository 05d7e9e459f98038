"""Physical motion fused with detections: corroboration, recordings, notices."""

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULTS, micros
from ..functions.text import names_where
from ..functions.verdicts import escalate


def with_last_motion(detections: DataFrame, motion: DataFrame, cfg=DEFAULTS, salts: int = None) -> DataFrame:
    """Adds motion_ts_us: the latest motion at or before the event and at most the motion window old (else null).

    Motion has no source key, so the as-of match is done per time bucket of the window's length, each split by a
    salt, as many as the session has shuffle partitions; distinct motion times are copied to their own and the next bucket
    of every salt.
    """
    salts = salts or int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    window = micros(cfg.motion_window_s)
    bucket = F.floor(F.col("ts_us") / window)
    left = detections.withColumn("_b", bucket).withColumn("_salt", F.pmod(F.hash("event_id"), F.lit(salts)))
    moved = motion.select("ts_us").distinct().withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    moved = moved.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    payload = [c for c in detections.columns if c != "ts_us"]
    rows = left.select("_b", "_salt", "ts_us", F.struct(*payload).alias("_row")).unionByName(
        moved.select("_b", "_salt", "ts_us", F.lit(None).cast(left.select(F.struct(*payload).alias("r")).schema["r"].dataType
                                                              ).alias("_row")))
    order = Window.partitionBy("_b", "_salt").orderBy("ts_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("_row").isNull(), F.col("ts_us"))).over(order)
    return (rows.withColumn("_m", last).filter(F.col("_row").isNotNull())
            .select("_row.*", "ts_us", F.when(F.col("ts_us") - F.col("_m") <= window, F.col("_m")).alias("motion_ts_us")))


def fuse(detections: DataFrame, motion: DataFrame, cfg=DEFAULTS) -> DataFrame:
    """Detections with effective_severity, the three fusion booleans and extra_flags.

    Camera and SMS gateways are taken to accept every request; notices(…) holds the texts to send.
    """
    near = with_last_motion(detections, motion, cfg)
    moved = F.col("motion_ts_us").isNotNull()
    hit = F.col("predicted_label").isin(*cfg.motion_labels) & moved
    out = near.withColumn("physical_motion_detected", hit).withColumn(
        "effective_severity", F.when(hit, escalate(F.col("severity"))).otherwise(F.col("severity")))
    critical = F.col("effective_severity") == "critical"
    out = (out.withColumn("camera_recording_started", critical | (F.col("predicted_label") == "malicious"))
           .withColumn("gsm_alert_sent", critical & moved))
    return out.withColumn("extra_flags", names_where({
        "physical_motion_corroborated": F.col("physical_motion_detected"),
        "camera_recording_started": F.col("camera_recording_started"), "gsm_alert_sent": F.col("gsm_alert_sent")}))


def notices(fused: DataFrame) -> DataFrame:
    """SMS texts for critical detections with motion."""
    # Fixed value: the text of the message.
    text = F.format_string("[IDS CRITICAL] %s from %s on %s. Physical motion also detected. Conf=%.2f",
                           F.upper("predicted_label"), F.col("source_ip"), F.col("hostname"), F.col("confidence"))
    return fused.filter("gsm_alert_sent").select("event_id", "ts_us", text.alias("sms"))


def recording_sessions(fused: DataFrame, cfg=DEFAULTS) -> DataFrame:
    """Camera recordings: each start extends the recording by the gap; a start exactly at its end continues it.

    Starts are first reduced to one row per gap-long bucket, in which all starts belong together; only these, at most
    one per gap of elapsed time, are ordered globally.
    """
    gap = micros(cfg.recording_gap_s)
    starts = fused.filter("camera_recording_started")
    cells = starts.groupBy(F.floor(F.col("ts_us") / gap).alias("cell")).agg(
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("cell")
    opens = F.coalesce(F.col("lo") - F.lag("hi").over(order) > gap, F.lit(True)).cast("int")
    numbered = cells.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(order))
    return numbered.groupBy("session").agg(
        F.min("lo").alias("start_us"), (F.max("hi") + gap).alias("end_us"), F.sum("n").alias("starts")).drop("session")
