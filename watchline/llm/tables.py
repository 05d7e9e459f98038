"""Reading the driver tables, partition counts, and results kept in the shared folder."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..ship import ship
from ..storage import checkpointed, new_folder

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILE_ROWS = 500_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, kind: str, rows: int = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and keeps column pruning.

    A bound on the number of rows saves a small table from being written as many small files. The shuffle files of the write
    go when it ends, else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, kind)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions so that none holds many more than per_task rows, and no fewer than the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def join_small(left: DataFrame, small: DataFrame, on, how="inner", limit=100_000) -> DataFrame:
    """Join with a table that is usually small: broadcast when its counted rows are few, else a shuffled join."""
    return left.join(F.broadcast(small) if small.count() <= limit else small, on, how)


def lowest(rows: DataFrame, group: str, h: str, n: int) -> DataFrame:
    """The rows that can be among the n lowest of their group by a 64-bit hash column, and a few times n at most.

    Hashes are spread evenly, so a bound follows from the size of the group: four times n are expected below it. Sizes are counted
    first, with partial sums, and no task sees a whole group.
    """
    counts = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_size"))
    share = F.least(F.lit(1.0), F.lit(4.0 * n) / F.col("_size"))
    bound = F.when(share >= 1, F.lit(2 ** 63 - 1)).otherwise((share * F.lit(2.0 ** 64) - F.lit(2.0 ** 63)).cast("long"))
    counts = stored(counts.select("_g", bound.alias("_bound")), "bounds")
    return join_small(rows, counts, F.col(group).eqNullSafe(F.col("_g"))).where(F.col(h) <= F.col("_bound")).drop("_g", "_bound")


def text_key(text="text"):
    """A 128-bit name of the text, null for null: with doc_id, whether null or shared, it names a row up to equal ones."""
    return F.md5(F.col(text))


def same_row(doc_id: str, key: str):
    """Condition: a row's doc_id and text are those that the two columns name."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & text_key().eqNullSafe(F.col(key))


__all__ = ["WORD", "lowest", "table", "stored", "text_key", "same_row", "checkpointed", "partitions", "join_small"]
