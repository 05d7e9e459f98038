"""Ordered per-key scans whose state passes between time slices.

A key's rows are packed per (key, slice); each slice is summarised as a small function of the state it is
entered with; the summaries of a key are walked in order to get every slice's entry state; slices are then
replayed. No task sees more than one slice of rows.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SECOND_US

SLICE_US = 60 * SECOND_US


def pack(df: DataFrame, keys, fields, slice_us: int = SLICE_US) -> DataFrame:
    """(keys, slice, rows): rows is an array of (ts_us, event_id, *fields) in order."""
    return (df.withColumn("slice", F.floor(F.col("ts_us") / slice_us)).groupBy(*keys, "slice")
            .agg(F.sort_array(F.collect_list(F.struct("ts_us", "event_id", *fields))).alias("rows")))


def walk(summaries: DataFrame, keys, column: str, entries_of) -> DataFrame:
    """(keys, slice, entry): entries_of maps the ordered array of (slice, summary) to one entry per slice."""
    per_key = summaries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slice", column))).alias("_s"))
    zipped = F.arrays_zip(F.col("_s.slice").alias("slice"), entries_of(F.col(f"_s.{column}")).alias("entry"))
    return per_key.select(*keys, F.explode(zipped).alias("_e")).select(*keys, "_e.slice", "_e.entry")


def final(summaries: DataFrame, keys, column: str, start: Column, apply) -> DataFrame:
    """(keys, state): the state after a key's last slice."""
    per_key = summaries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slice", column))).alias("_s"))
    return per_key.select(*keys, F.aggregate(f"_s.{column}", start, apply).alias("state"))
