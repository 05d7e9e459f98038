"""URL filter as a temporal list join: dated list entries become validity intervals, captures meet those active when
they were fetched.

Entries are (list, kind, pattern, action, day): kind `domain` covers a host and its subdomains, `prefix` a host with the
start of a path, cut at slashes; action is `add` or `remove`. An entry holds from its day until the next entry of the same
list and pattern; on one day a removal wins. A capture is looked up by every domain suffix of its host and every prefix of
its path. Intervals are laid out over time buckets, so the join is on (kind, pattern, bucket) and a long history of one
pattern does not multiply its captures; hot patterns are an ordinary skewed join, which adaptive execution splits.
The longest active pattern decides; at equal length `deny` beats `allow`; without one the capture is kept.

Edge cases: a null or unparsable url has no host, meets no entry and is kept; a null fetch day meets none either; entries
with a null list, pattern or day are ignored; rows repeated in full give repeated results; with no captures or no entries
the result has the captures' rows, all kept. Other columns are ignored.
"""

from pyspark.sql import DataFrame, Window, functions as F

BUCKET_DAYS = 32
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def host(url):
    out = F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(out != "", F.rtrim(out, F.lit(".")))


def path(url):
    return F.rtrim(F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1), F.lit("/"))


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, since, until: the days [since, until) on which an entry holds; until is null if it still does."""
    e = entries.dropna(subset=["list", "kind", "pattern", "day"])
    e = e.groupBy("list", "kind", "pattern", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("list", "kind", "pattern").orderBy("day"))
    return e.withColumn("until", until).where(F.col("action") == "add").select(
        "list", "kind", "pattern", F.col("day").alias("since"), "until")


def _bucket(day):
    return F.floor(day / BUCKET_DAYS)


def lookups(captures: DataFrame) -> DataFrame:
    """One row per pattern that could cover a capture."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    steps = F.split("path", "/")
    prefixes = F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat("host", F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("pattern"))))
    both = F.when(F.col("host").isNotNull(), F.concat(suffixes, F.coalesce(prefixes, F.slice(suffixes, 1, 0))))
    return captures.select("*", F.explode_outer(F.array_distinct(both)).alias("_p")).select(
        *captures.columns, "_p.kind", "_p.pattern", _bucket(F.col("day")).alias("bucket"))


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, day, host, n_active, pattern, since, verdict for each capture (page_id, url, day)."""
    c = captures.groupBy("page_id", "url", "day").agg(F.count(F.lit(1)).alias("_n"))
    c = c.select("*", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    last = c.agg(F.max("day")).first()[0]
    held = intervals(entries).where(F.col("since") <= F.lit(last)).withColumn(
        "_upto", F.least(F.coalesce(F.col("until"), F.lit(last) + 1), F.lit(last) + 1))
    held = held.select("*", F.explode(F.sequence(_bucket(F.col("since")), _bucket(F.col("_upto") - 1))).alias("bucket"))
    l = lookups(c)
    met = l.join(held.select(*[F.col(x).alias(f"e_{x}") for x in held.columns]), on=[
        F.col("kind") == F.col("e_kind"), F.col("pattern") == F.col("e_pattern"), F.col("bucket") == F.col("e_bucket"),
        F.col("day") >= F.col("e_since"), F.col("day") < F.col("e__upto")], how="left")
    strength = F.when(F.col("e_pattern").isNotNull(), F.struct(
        F.length("e_pattern").alias("length"), (F.col("e_list") == "deny").alias("deny"), F.col("e_pattern").alias("pattern"),
        F.col("e_since").alias("since")))
    out = met.groupBy("page_id", "url", "day", "host", "_n").agg(
        F.max(strength).alias("_m"), F.count("e_pattern").alias("n_active"))
    out = out.select("page_id", "url", "day", "host", "n_active", F.col("_m.pattern").alias("pattern"),
                     F.col("_m.since").alias("since"), F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i"),
                     F.when(F.col("_m.deny"), "drop").otherwise("keep").alias("verdict"))
    return out.drop("_i")


def number(text, modulus: int):
    """A stable number below modulus from a string."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long"), F.lit(modulus))


def page_captures(pages: DataFrame, days: int = 366) -> DataFrame:
    """Pages as captures: the fetch day comes from the page's number."""
    return pages.select("page_id", "url", number(F.concat(F.lit("f"), F.col("page_id").cast("string")), days).alias("day"))


def page_lists(pages: DataFrame, days: int = 366) -> DataFrame:
    """Dated list entries over the pages' own hosts and first path steps: every pattern is added on some day, two in three
    are removed later, and one in three of these is added again. Host patterns are denied, path patterns allowed or denied."""
    u = pages.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).where("host is not null").distinct()
    step = F.regexp_extract("path", r"^/[^/]+", 0)
    patterns = u.select(F.lit("domain").alias("kind"), F.col("host").alias("pattern")).union(
        u.where(step != "").select(F.lit("prefix"), F.concat("host", step))).distinct()
    p = F.col("pattern")
    added, gone = number(p, days), number(F.concat(F.lit("g"), p), 90) + 1
    again, what = number(F.concat(F.lit("a"), p), 60) + 1, number(F.concat(F.lit("k"), p), 9)
    listed = F.when((F.col("kind") == "prefix") & (number(F.concat(F.lit("l"), p), 2) == 0), "allow").otherwise("deny")
    entry = lambda action, day: F.struct(F.lit(action).alias("action"), day.alias("day"))
    dated = F.when(what < 3, F.array(entry("add", added))).when(
        what < 7, F.array(entry("add", added), entry("remove", added + gone))).otherwise(
        F.array(entry("add", added), entry("remove", added + gone), entry("add", added + gone + again)))
    return patterns.select(listed.alias("list"), "kind", "pattern", F.inline(dated))
