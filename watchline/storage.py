"""Reliable checkpoints for iterative operators, and folders beside them for stream output."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made = {}  # application -> folders


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; fall back to a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="watchline-"))


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def release(spark: SparkSession) -> int:
    """Delete the folders that new_folder made for this session's application; tables read from them are gone then."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in made:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(made)


def written(df: DataFrame, kind: str) -> DataFrame:
    """Written to a fresh folder and read back: cuts the lineage and keeps column pruning."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
