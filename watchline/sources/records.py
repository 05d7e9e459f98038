"""CSV files cut into records by all tasks at once, newlines inside quotes included.

Files are read as lines of byte ranges. Whether a range begins inside quotes depends on everything before it, so a first pass
reduces each range to a function: where it ends (in quotes or not) and how many records start in it, for either way of
beginning. A quote in the middle of an unquoted field is an ordinary character, so this is no mere parity. Such functions are
either constant, the identity or a swap, and a window over the ranges of a file composes them. The second pass knows the true
state and record number at the start of its range: it joins lines to records, numbers and parses them. A record that crosses
ranges leaves pieces, which meet by (file, record number). Record 0 of a file is its header.
"""

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..ship import ship
from ..storage import checkpointed, written

#: Ranges whose states are sent to every task; with more of them the lines are shuffled to their range's state instead.
RANGES_SENT = 200_000


def csv_lines(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """line (binary), file, block (start of the byte range that the line belongs to)."""
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    return reader.text(paths).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"),
                                     F.col("_metadata.file_block_start").alias("block"))


def ends_in_quotes(line: bytes, quoted: bool, comma: bytes = b",") -> bool:
    """Whether a line that begins inside quotes or at a record's start ends inside quotes."""
    at = 0
    while True:
        if not quoted:
            if line[at:at + 1] != b'"':
                at = line.find(comma + b'"', at) + 1
                if not at:
                    return False
            at += 1
        while True:
            at = line.find(b'"', at) + 1
            if not at:
                return True
            if line[at:at + 1] != b'"':
                break
            at += 1
        at = line.find(comma, at) + 1
        if not at:
            return False
        quoted = False


def _runs(batch):
    """(file, block, lines) for the runs of a batch that belong to one range."""
    file, block = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False)
    codes = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield file[a].as_py(), int(block[a]), batch.column("line").slice(a, b - a)


def _content(lines):
    """Which lines are not blank, and the numbers of those with a quote."""
    bare = pc.or_(pc.equal(pc.binary_length(lines), 0), pc.equal(lines, pa.scalar(b"\r", lines.type)))
    quotes = pc.match_substring(lines, '"')
    return ~bare.to_numpy(zero_copy_only=False), np.flatnonzero(quotes.to_numpy(zero_copy_only=False))


def _states(lines, quotes, quoted):
    """Whether each line begins inside quotes, and whether the last one ends there."""
    out = np.zeros(len(lines), bool)
    start = 0
    for i in quotes.tolist():
        out[start:i + 1] = quoted
        quoted, start = ends_in_quotes(lines[i].as_py(), quoted), i + 1
    out[start:] = quoted
    return out, quoted


def range_states(lines: DataFrame) -> DataFrame:
    """file, block, entry (whether the range begins inside quotes), base (records that start before it), leaves."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_exit", pa.bool_()), ("q_exit", pa.bool_()),
                        ("n_starts", pa.int64()), ("q_starts", pa.int64())])

    def run(batches):
        now, ends, starts = None, [False, True], [0, 0]

        def row():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, *ends, *starts)))], schema=schema)

        for batch in batches:
            for file, block, part in _runs(batch):
                if now != (file, block):
                    if now:
                        yield row()
                    now, ends, starts = (file, block), [False, True], [0, 0]
                filled, quotes = _content(part)
                for k in (0, 1):
                    inside, ends[k] = _states(part, quotes, ends[k])
                    starts[k] += int((filled & ~inside).sum())
        if now:
            yield row()

    found = lines.mapInArrow(run, "file string, block long, n_exit boolean, q_exit boolean, n_starts long, q_starts long")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("n_exit") & ~F.col("q_exit")).cast("long")
    found = found.withColumn("swaps", F.sum(swap).over(order))
    fixed = F.when(F.col("n_exit") == F.col("q_exit"), F.struct("n_exit", "swaps"))
    found = found.withColumn("since", F.last(fixed, ignorenulls=True).over(before)).withColumn(
        "odd", (F.coalesce(F.sum(swap).over(before), F.lit(0)) - F.coalesce("since.swaps", F.lit(0))) % 2 == 1)
    found = found.withColumn("entry", F.coalesce("since.n_exit", F.lit(False)) != F.col("odd"))
    starts = F.when(F.col("entry"), F.col("q_starts")).otherwise(F.col("n_starts"))
    return checkpointed(found.select("file", "block", "entry", F.coalesce(F.sum(starts).over(before), F.lit(0)).alias("base"),
                                     F.when(F.col("entry"), F.col("q_exit")).otherwise(F.col("n_exit")).alias("leaves")))


def parsed(texts, comma=","):
    """Fields of records given as bytes; the newline at the end of a record is not part of them."""
    csv.field_size_limit(1 << 31)
    return list(csv.reader([t.decode("utf-8", "replace") for t in texts], delimiter=comma))


def _cut(lines: DataFrame, states: DataFrame) -> DataFrame:
    """file, record, block, fields of every whole record, or text of a piece of one that crosses ranges."""
    schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("block", pa.int64()), ("fields", pa.list_(pa.string())),
                        ("text", pa.binary())])
    states = states.drop("leaves")
    if states.count() <= RANGES_SENT:
        placed = lines.join(F.broadcast(states), ["file", "block"], "left")
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        placed = numbered.join(states, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "at")
    placed = placed.select("line", "file", "block", "entry", "base")

    def batch_of(file, numbers, blocks, fields, texts):
        return pa.RecordBatch.from_arrays([pa.array([file] * len(numbers), pa.string()), pa.array(numbers, pa.int64()),
                                           pa.array(blocks, pa.int64()), pa.array(fields, schema.field("fields").type),
                                           pa.array(texts, pa.binary())], schema=schema)

    def run(batches):
        now, quoted, count, open_ = None, False, 0, []  # open_: lines of the record that has not ended

        def leave():
            """The piece of a record that goes on in the next range."""
            return batch_of(now[0], [count - 1], [now[1]], [None], [b"\n".join(open_)])

        for batch in batches:
            offset = 0
            for file, block, part in _runs(batch):
                entry, base = batch.column("entry")[offset].as_py(), batch.column("base")[offset].as_py()
                offset += len(part)
                if entry is None:
                    raise ValueError(f"{file} changed while it was read")
                if now != (file, block):
                    if now and open_:
                        yield leave()
                    now, quoted, count, open_, whole = (file, block), entry, base, [], not entry
                filled, quotes = _content(part)
                inside, quoted_next = _states(part, quotes, quoted)
                kept = np.flatnonzero(filled | inside)
                lines_ = part.take(pa.array(kept)).to_pylist()
                begins = ~inside[kept]
                ends = np.append(inside[1:], quoted_next)[kept]
                numbers, texts, piece = [], [], None
                for line, new, goes_on in zip(lines_, begins.tolist(), ends.tolist()):
                    if new:
                        count += 1
                        whole = True
                    if goes_on:
                        open_.append(line)
                        continue
                    line = line[:-1] if line.endswith(b"\r") else line
                    if open_:
                        line = b"\n".join([*open_, line])
                        open_ = []
                    if whole:
                        numbers.append(count - 1)
                        texts.append(line)
                    else:
                        piece = batch_of(file, [count - 1], [block], [None], [line])
                        whole = True
                quoted = quoted_next
                if piece is not None:
                    yield piece
                if numbers:
                    yield batch_of(file, numbers, [block] * len(numbers), parsed(texts), [None] * len(numbers))
        if now and open_:
            yield leave()

    return placed.mapInArrow(run, "file string, record long, block long, fields array<string>, text binary")


def csv_records(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """file, record (from 0, the header), fields of every record; blank lines are none, an empty field is null."""
    ship(spark)
    lines = csv_lines(spark, paths, recursive)
    states = range_states(lines)
    cut = written(_cut(lines, states), "records")
    whole = cut.where("fields is not null").select("file", "record", "fields")
    if not states.where("entry").isEmpty():
        pieces = cut.where("fields is null").groupBy("file", "record").agg(
            F.array_sort(F.collect_list(F.struct("block", "text"))).alias("pieces"))
        schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("fields", pa.list_(pa.string()))])

        def join(batches):
            for batch in batches:
                texts = [b"\n".join(p["text"] for p in x) for x in batch.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("record"),
                                                  pa.array(parsed(texts), schema.field("fields").type)], schema=schema)

        whole = whole.union(pieces.mapInArrow(join, "file string, record long, fields array<string>"))
    return whole.withColumn("fields", F.transform("fields", lambda x: F.nullif(x, F.lit(""))))
