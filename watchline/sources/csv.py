"""Labelled CSV training sources: discovery, single files, features/labels pairs, normalisation."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.verdicts import normalize_label
from ..storage import checkpointed, written
from .records import csv_records

# Column names per role, first match wins, compared trimmed and lower-cased.
LABEL_NAMES = ("label", "labels", "class", "target", "attack", "attack_type", "category", "malicious", "outcome", "y", "x")
TEXT_NAMES = ("message", "log", "log_text", "text", "event", "payload", "content", "summary")
IP_NAMES = ("source_ip", "src_ip", "ip", "src", "source")
HOST_NAMES = ("hostname", "host", "device", "machine", "sensor")
SERVICE_NAMES = ("service", "protocol", "app", "application")
TRAINING_COLUMNS = ("text", "label", "source_ip", "hostname", "service")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(columns, names):
    """The first column matching a role name, or None."""
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[n] for n in names if n in by_name), None)


def header_names(fields) -> list:
    """Column names of a header: an empty one is named by its place, a repeated one gets its place at the end."""
    names = [f"_c{i}" if f is None else f for i, f in enumerate(fields)]
    names = [n.lstrip("\ufeff") for n in names]
    return [f"{n}{i}" if names.count(n) > 1 else n for i, n in enumerate(names)]


def _columns(records: DataFrame, index: str = None):
    """(rows as string columns in the order of the first file's header, header); `index` numbers rows over all files."""
    header = records.where("record = 0").orderBy("file").first()
    if header is None:
        raise ValueError("no header, the file is empty")
    names = header_names(header.fields)
    n = F.size("fields")
    good = F.assert_true(n == len(names), F.concat(F.lit("Malformed CSV record "), F.col("record"), F.lit(" of "), F.col("file"),
                                                   F.lit(": "), n, F.lit(f" fields, the header has {len(names)}"))).isNull()
    rows = records.where((F.col("record") > 0) & good)
    columns = [F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(names)]
    if index is None:
        return rows.select(*columns), names
    before = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    shift = records.groupBy(F.col("file").alias("f")).agg(F.max("record").alias("n")).select(
        "f", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rows = rows.join(shift, F.col("file") == F.col("f"))
    return rows.select(*columns, (F.col("record") - 1 + F.col("shift")).alias(index)), names


def read_raw_csv(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """All columns as strings, so 1 stays "1" and labels keep their spelling.

    Quoted fields may hold newlines, and every file is cut into byte ranges that are read at once. A row with more or fewer
    fields than the header fails the read instead of moving values into other columns. multiline=False reads files known
    to hold no such newlines in one pass.
    """
    if multiline:
        return _columns(csv_records(spark, path))[0]
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.option("mode", "FAILFAST").csv(path)


def normalize_training(df: DataFrame) -> DataFrame:
    """(text, label, source_ip, hostname, service); rows whose label says nothing are dropped."""
    label = find_column(df.columns, LABEL_NAMES)
    if label is None:
        raise ValueError(f"no label column among {df.columns}; expected one of {list(LABEL_NAMES)}")
    text = find_column(df.columns, TEXT_NAMES)
    if text is not None:
        body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    else:
        body = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(quoted(c).cast("string"), F.lit("")))
                                  for c in df.columns if c not in (label, "label")])

    def context(names):
        found = find_column(df.columns, names)
        if found is None:
            return F.lit("unknown")
        return F.coalesce(F.nullif(quoted(found).cast("string"), F.lit("")), F.lit("unknown"))

    out = df.select(body.alias("text"), normalize_label(quoted(label)).alias("label"),
                    context(IP_NAMES).alias("source_ip"), context(HOST_NAMES).alias("hostname"),
                    context(SERVICE_NAMES).alias("service"))
    return out.filter(F.col("label").isNotNull())


def read_labeled_csv(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """Training rows of one labelled file or a folder of files with one header."""
    return normalize_training(read_raw_csv(spark, path, multiline))


def paired_label_column(columns):
    """A label-named column, else the only column, else the only one that is not an index."""
    found = find_column(columns, LABEL_NAMES)
    if found is not None:
        return found
    if len(columns) == 1:
        return columns[0]
    # A header left empty is an index column; Spark names it _c0, exports may say "Unnamed: 0".
    usable = [c for c in columns if not (c.lower().startswith("unnamed") or c.startswith("_c"))]
    if len(usable) == 1:
        return usable[0]
    raise ValueError(f"cannot tell the label column among {columns}")


def with_row_index(df: DataFrame, columns, name: str = "row_idx") -> DataFrame:
    """Rows of a file-backed DataFrame numbered 0, 1, 2 … in file order.

    Rows are numbered inside each file block and shifted by the counts of earlier blocks, so no task orders more than
    one block.
    """
    block = F.struct(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("s"))
    rows = df.select(*[quoted(c) for c in columns], block.alias("_block"), F.monotonically_increasing_id().alias("_id"))
    counts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("_id")) - 1
    return (rows.withColumn("_i", inside).join(shifts, "_block")
            .select(*[quoted(c) for c in columns], (F.col("_i") + F.col("_shift")).alias(name)))


def pair_by_row_index(left: DataFrame, right: DataFrame, name: str = "row_idx") -> DataFrame:
    """Row i beside row i; sides of different length are an error when the result is read.

    Both sides are numbered 0, 1, 2 …, so equal counts mean every row has its partner. The check sits in a filter
    that raises, below anything that could drop unmatched rows first.
    """
    n_left, n_right = [df.agg(F.count(F.lit(1))).scalar() for df in (left, right)]
    same = F.assert_true(n_left == n_right, "features and labels have different numbers of rows").isNull()
    return left.filter(same).join(right.filter(same).hint("merge"), name)  # whatever the sides' sizes on disk say


def read_paired_csv(spark: SparkSession, features, labels) -> DataFrame:
    """Row i of the features beside row i of the labels, normalised."""
    left, names = _columns(csv_records(spark, features), "row_idx")
    right, label_names = _columns(csv_records(spark, labels), "row_idx")
    label = paired_label_column(label_names)
    left = left.select("row_idx", *[quoted(c) for c in names if c.lower() != "label"])
    right = right.select("row_idx", quoted(label).alias("label"))
    return normalize_training(pair_by_row_index(left, right).drop("row_idx"))


def match_sources(files: DataFrame) -> DataFrame:
    """(kind, dataset, labels) of files (path): features/labels pairs and single CSVs; lone label files are skipped."""
    named = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
                         F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    labels = named.filter(F.col("name").endswith("_labels.csv")).select(
        "folder", F.col("path").alias("labels"), F.expr("substring(name, 1, length(name) - 11)").alias("lbase"))
    data = named.filter(~F.col("name").endswith("_labels.csv")).withColumn(
        "base", F.when(F.col("name").endswith("_dataset.csv"), F.expr("substring(name, 1, length(name) - 12)")))
    # Exact, lower-case, upper-case base name, in this order; each is an equi-join on folder and base.
    spelled = data.filter(F.col("base").isNotNull()).select(
        "path", "folder", F.posexplode(F.array("base", F.lower("base"), F.upper("base"))).alias("rank", "lbase"))
    same = (spelled.join(labels, ["folder", "lbase"])
            .groupBy("path").agg(F.min_by("labels", "rank").alias("matched")))
    only = labels.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("labels").alias("only")).filter("n = 1")
    found = (data.join(same, "path", "left").join(only.select("folder", "only"), "folder", "left")
             .withColumn("labels", F.when(F.col("base").isNotNull(), F.coalesce("matched", "only"))))
    kind = F.when(F.col("labels").isNotNull(), "paired_csv").otherwise("single_csv")
    return found.select(kind.alias("kind"), F.col("path").alias("dataset"), "labels")


def discover_sources(spark: SparkSession, root: str) -> DataFrame:
    """(kind, dataset, labels) of the CSV files under a folder."""
    return match_sources(spark.read.format("binaryFile").option("recursiveFileLookup", True)
                         .option("pathGlobFilter", "*.csv").load(root).select("path"))


def _role(names: str, candidates):
    """Index of the first candidate among trimmed, lower-cased names, null if there is none."""
    lowered = F.transform(names, lambda n: F.lower(F.trim(F.coalesce(n, F.lit("")))))
    return F.coalesce(*[F.nullif(F.array_position(lowered, F.lit(c)), F.lit(0).cast("long")) for c in candidates]) - 1


def _paired_role(names: str):
    """As paired_label_column: a label-named column, else the only one, else the only one that is not an index."""
    at = F.sequence(F.lit(0), F.size(names) - 1)
    usable = F.filter(at, lambda i: ~F.coalesce(F.lower(F.get(names, i)).rlike("^(unnamed|_c)"), F.lit(True)))
    return F.coalesce(_role(names, LABEL_NAMES), F.when(F.size(names) == 1, F.lit(0).cast("long")),
                      F.when(F.size(usable) == 1, F.get(usable, F.lit(0)).cast("long")))


def training_sources(records: DataFrame) -> DataFrame:
    """A row for each source: kind, dataset, labels, names, the places of its roles, and its problem (null: usable)."""
    rows = records.join(records.where("record = 0").select(F.col("file").alias("f"), F.col("fields").alias("names")),
                        F.col("file") == F.col("f"))
    files = rows.groupBy("file").agg(
        F.any_value("names").alias("names"), F.max("record").alias("n"),
        F.min(F.when(F.size("fields") != F.size("names"), F.col("record"))).alias("ragged"))
    files = checkpointed(files)
    sources = match_sources(files.select(F.col("file").alias("path")))
    own = files.select(F.col("file").alias("dataset"), "names", "n", "ragged")
    side = files.select(F.col("file").alias("labels"), F.col("names").alias("label_names"), F.col("n").alias("label_n"),
                        F.col("ragged").alias("label_ragged"))
    found = sources.join(own, "dataset").join(side, "labels", "left")
    paired = F.col("kind") == "paired_csv"
    found = found.withColumn("label_at", F.when(paired, _paired_role("label_names")).otherwise(_role("names", LABEL_NAMES)))
    for role, candidates in (("text_at", TEXT_NAMES), ("ip_at", IP_NAMES), ("host_at", HOST_NAMES), ("service_at", SERVICE_NAMES)):
        found = found.withColumn(role, _role("names", candidates))
    bad = lambda c: F.concat(F.lit("record "), F.col(c), F.lit(" has another number of fields than the header"))
    return found.withColumn("problem", F.when(F.col("label_at").isNull(), "no label column")
                            .when(F.col("ragged").isNotNull(), bad("ragged")).when(F.col("label_ragged").isNotNull(), bad("label_ragged"))
                            .when(paired & (F.col("n") != F.col("label_n")), "features and labels have different numbers of rows"))


def read_training_sources(spark: SparkSession, root: str):
    """(training rows of every usable source under a folder, messages about skipped ones).

    One plan reads all files, whatever their columns: records are parsed once and stored, a source with a broken record, no
    label or a labels file of another length is reported, and the others go on.
    """
    records = csv_records(spark, root, recursive=True)
    sources = written(training_sources(records), "sources")
    skipped = [f"{r.dataset}: {r.problem}" for r in sources.where("problem is not null").orderBy("dataset").collect()]
    usable = sources.where("problem is null")
    if usable.isEmpty():
        raise ValueError(f"no usable training data under {root}: {skipped}")
    rows = records.where("record > 0")
    single = rows.join(usable.where("kind = 'single_csv'"), F.col("file") == F.col("dataset")).withColumn(
        "raw", F.get("fields", F.col("label_at").cast("int"))).withColumn("own", F.col("label_at"))
    pairs = usable.where("kind = 'paired_csv'")
    right = rows.join(pairs.select(F.col("labels").alias("l"), F.col("dataset").alias("d"), F.col("label_at").alias("a")),
                      F.col("file") == F.col("l")).select("d", F.col("record").alias("r"), F.get("fields", F.col("a").cast("int")).alias("raw"))
    # Stored records take a fraction of their size in memory, so neither side is ever sent whole by its size on disk.
    paired = rows.join(pairs, F.col("file") == F.col("dataset")).join(
        right.hint("merge"), (F.col("file") == F.col("d")) & (F.col("record") == F.col("r"))).drop("d", "r").withColumn("own", F.lit(-1).cast("long"))
    both = single.unionByName(paired.select(*single.columns))
    value = lambda x: F.coalesce(x, F.lit(""))
    places = F.sequence(F.lit(0), F.size("fields") - 1)
    shown = F.filter(places, lambda i: (i != F.col("own")) & (value(F.get("names", i)) != "label"))
    pairs_text = F.array_join(F.transform(shown, lambda i: F.concat(
        F.coalesce(F.get("names", i), F.concat(F.lit("_c"), i)), F.lit("="), value(F.get("fields", i)))), " ")
    at = lambda c: F.get("fields", F.col(c).cast("int"))
    context = lambda c: F.coalesce(at(c), F.lit("unknown"))
    out = both.select(F.when(F.col("text_at").isNotNull(), value(at("text_at"))).otherwise(pairs_text).alias("text"),
                      normalize_label(F.col("raw")).alias("label"), context("ip_at").alias("source_ip"),
                      context("host_at").alias("hostname"), context("service_at").alias("service"))
    return out.filter(F.col("label").isNotNull()), skipped
