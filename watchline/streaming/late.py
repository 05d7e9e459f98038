"""Rows that come too late for an operator, kept beside it and counted.

A stateful operator drops rows whose event time is not after the watermark, and only says how many. The dead-letter side of an
operator is a second query over the same source: it follows the same watermark (the latest event time of earlier batches less the
operator's delay, in milliseconds as Spark keeps it) and stores the rows that the operator will have dropped. Each batch
writes its own partition, so a batch that is repeated replaces what it wrote.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

_MARKS = "top_us long, batch_id long"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def watermark_us(top_us: int, delay_s: float) -> int:
    return top_us // 1000 * 1000 - int(delay_s * 1000) * 1000


def keep_late_rows(path: str, operator: str, delay_s: float):
    """foreachBatch body for rows with ts_us: late ones go to path/rows with the operator and the watermark they missed."""
    marks, late = f"{path}/marks/{operator}", f"{path}/rows"

    def run(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        top = None
        if _exists(spark, marks):
            top = spark.read.schema(_MARKS).parquet(marks).where(F.col("batch_id") < batch_id).agg(F.max("top_us")).first()[0]
        if top is not None:
            limit = watermark_us(top, delay_s)
            missed = rows.where(F.col("ts_us") <= limit).withColumn("watermark_us", F.lit(limit)).withColumn(
                "operator", F.lit(operator)).withColumn("batch_id", F.lit(batch_id).cast("long"))
            missed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("operator", "batch_id").parquet(late)
        now = rows.agg(F.max("ts_us").alias("top_us")).where("top_us is not null").withColumn("batch_id", F.lit(batch_id).cast("long"))
        now.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(marks)
    return run


def dead_letters(stream: DataFrame, path: str, operator: str, delay_s: float = 600.0) -> DataStreamWriter:
    """The dead-letter side of an operator that reads `stream` with this delay; start it beside the operator."""
    return stream.writeStream.foreachBatch(keep_late_rows(path, operator, delay_s)).option(
        "checkpointLocation", f"{path}/checkpoints/{operator}")


def late_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All rows kept under a path, with operator, batch_id and the watermark; `like` gives the columns of the stream."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    schema = f"{columns}, watermark_us long, operator string, batch_id long"
    if not _exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/rows")


def late_counts(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """(operator, late): how many rows each operator has dropped."""
    return late_rows(spark, path, like).groupBy("operator").agg(F.count(F.lit(1)).alias("late"))
