"""Dataset catalogue: per-file row counts, columns, label distribution and sample rows."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.verdicts import normalize_label
from ..sources.csv import quoted, training_sources
from ..sources.records import csv_records
from ..storage import checkpointed

SAMPLE_ROWS = 5
MAX_COLUMNS = 12


def label_distribution(df: DataFrame, label: Column, by=()) -> DataFrame:
    """(by, label, n): counts of normalised labels; labels that say nothing count as unknown."""
    name = F.coalesce(normalize_label(label), F.lit("unknown"))
    return df.groupBy(*by, name.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def sample_text(col: Column) -> Column:
    text = col.cast("string")
    return F.when(F.length(text) > 120, F.concat(F.substring(text, 1, 117), F.lit("..."))).otherwise(text)


def sample_columns(columns) -> list:
    columns = list(columns)
    return columns if len(columns) <= MAX_COLUMNS else columns[:MAX_COLUMNS - 1] + columns[-1:]


def sample_rows(df: DataFrame, by: str, order: str, columns) -> DataFrame:
    """(by, row, values map): the first rows of each file, cut to few columns and short values.

    The rank limit is applied before the shuffle too, so each task sends at most a handful of rows per file.
    """
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(
        F.col("_r") <= SAMPLE_ROWS)
    pairs = F.map_from_arrays(
        F.array(*[F.lit(c) for c in sample_columns(columns)]),
        F.array(*[sample_text(quoted(c)) for c in sample_columns(columns)]))
    return first.select(by, F.col("_r").alias("row"), pairs.alias("sample"))


def profile(df: DataFrame, by: str, order: str, label: Column = None, columns=None) -> DataFrame:
    """One row per file: rows, columns, label distribution (map) and sample rows (array of maps)."""
    columns = columns or [c for c in df.columns if c not in (by, order)]
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    samples = sample_rows(df, by, order, columns).groupBy(by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row", F.to_json("sample").alias("s")))),
                    lambda x: x["s"]).alias("sample_rows"))
    out = counts.join(samples, by).withColumn("columns", F.array(*[F.lit(c) for c in columns]))
    if label is None:
        return out.withColumn("label_distribution", F.lit(None).cast("map<string,bigint>"))
    dist = label_distribution(df, label, [by]).groupBy(by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("label_distribution"))
    return out.join(dist, by)


def csv_catalogue(records: DataFrame) -> DataFrame:
    """One row per CSV source of a table of records (file, record, fields), whatever columns the files have: one plan for all."""
    sources = training_sources(records)
    named = lambda c: F.transform(c, lambda n, i: F.when(
        n.isNull() | (F.size(F.filter(c, lambda m: m.eqNullSafe(n))) > 1), F.concat(F.coalesce(n, F.lit("_c")), i)).otherwise(n))
    few = lambda c: F.when(F.size(c) <= MAX_COLUMNS, c).otherwise(F.concat(
        F.slice(c, 1, MAX_COLUMNS - 1), F.slice(c, -1, 1)))
    sources = checkpointed(sources.withColumn("columns", named(F.col("names"))).withColumn(
        "label_file", F.coalesce("labels", "dataset")).withColumn(
        "label_column", F.get(named(F.when(F.col("kind") == "paired_csv", F.col("label_names")).otherwise(F.col("names"))),
                              F.col("label_at").cast("int"))))
    first = records.where((F.col("record") >= 1) & (F.col("record") <= SAMPLE_ROWS)).join(
        sources.select(F.col("dataset").alias("file"), "columns"), "file").where(F.size("fields") == F.size("columns"))
    sample = F.to_json(F.map_from_arrays(few(F.col("columns")), F.transform(few(F.col("fields")), sample_text)))
    samples = first.groupBy(F.col("file").alias("dataset")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("record", sample.alias("s")))), lambda x: x["s"]).alias("sample_rows"))
    marked = records.where("record > 0").join(
        sources.where("label_at is not null").select(F.col("label_file").alias("file"), "dataset", "label_at"), "file")
    dist = label_distribution(marked, F.get("fields", F.col("label_at").cast("int")), ["dataset"]).groupBy("dataset").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("label_distribution"))
    stem = F.regexp_extract("dataset", r"([^/]*)\.csv$", 1)
    return sources.join(samples, "dataset", "left").join(dist, "dataset", "left").select(
        F.when(F.col("kind") == "paired_csv", F.regexp_replace(stem, "_dataset$", "")).otherwise(stem).alias("name"), "kind",
        F.array_compact(F.array("dataset", "labels")).alias("paths"), F.col("n").cast("long").alias("rows"), "columns", "label_column",
        "label_distribution", F.coalesce("sample_rows", F.array().cast("array<string>")).alias("sample_rows"),
        F.array_compact(F.array("problem")).alias("notes"))


def scan_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue of every CSV source and text log under a folder; rows are counted by parsing, all files in one plan."""
    out = csv_catalogue(csv_records(spark, root, recursive=True))
    logs = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{log,txt}").text(root)
            .withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
            .filter("value <> ''").withColumnRenamed("value", "line"))
    log_part = profile(logs, "_file", "_at", None, ["line"]).select(
        F.regexp_extract("_file", r"([^/]*)\.[^./]*$", 1).alias("name"), F.lit("log").alias("kind"),
        F.array("_file").alias("paths"), "rows", F.array().cast("array<string>").alias("columns"),
        F.lit(None).cast("string").alias("label_column"), "label_distribution", "sample_rows",
        F.array().cast("array<string>").alias("notes"))
    return out.unionByName(log_part)
