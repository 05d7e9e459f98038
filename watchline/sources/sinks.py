"""Alert table and forwarding outbox, batch and per micro-batch."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULTS
from ..operators.alerts import forwardable, storable


def stored_form(detections: DataFrame, cfg=DEFAULTS) -> DataFrame:
    """Alerts to keep, with the forwarding mark and a date column to partition by."""
    return (storable(detections)
            .withColumn("honeypot_sent", F.col("predicted_label").isin(*cfg.forward_labels))
            .withColumn("dt", F.to_date(F.timestamp_micros("ts_us"))))


def write_alerts(detections: DataFrame, path: str, cfg=DEFAULTS) -> None:
    stored_form(detections, cfg).write.mode("append").partitionBy("dt").parquet(path)


def write_batch(detections: DataFrame, batch_id: int, alerts: str, outbox: str = None, cfg=DEFAULTS) -> None:
    """foreachBatch body. A batch owns its partition, so a batch that is run again replaces its own rows only."""
    once = detections.persist()
    try:
        for frame, path in ((stored_form(once, cfg), alerts), (forwardable(once, cfg), outbox)):
            if path:
                (frame.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    finally:
        once.unpersist()


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
