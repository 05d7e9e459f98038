"""Run-time event sources: text logs, decoded packets, ingest JSON."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import INGEST


def log_lines_to_events(lines: DataFrame, column: str = "value", time_pattern: str = None) -> DataFrame:
    """One event per non-blank line. time_pattern may name a group holding epoch seconds; else ingest time is used."""
    text = F.regexp_replace(F.regexp_replace(F.col(column), "�", ""), r"(?U)^\s+|\s+$", "")
    now = F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    when = now if time_pattern is None else F.coalesce(
        F.nullif(F.regexp_extract("message", time_pattern, 1), F.lit("")).try_cast("double"), now)
    keep = [c for c in lines.columns if c != column]
    return (lines.select(*keep, text.alias("message")).filter("message <> ''")
            .select(*keep, when.alias("timestamp"), F.lit("unknown").alias("source_ip"),
                    F.lit("log_host").alias("hostname"), F.lit("log").alias("service"), "message"))


def read_text_log(spark: SparkSession, path, time_pattern: str = None, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return log_lines_to_events(reader.text(path), "value", time_pattern)


def payload_text(payload: Column, limit: int = None) -> Column:
    """The bytes (the first `limit`, where that is set) as text, invalid ones left out."""
    if limit is not None:
        payload = F.substring(payload, 1, limit)
    return F.replace(F.make_valid_utf8(payload.cast("string")), F.lit("�"), F.lit(""))


def packets_to_events(packets: DataFrame, payload_limit: int = None) -> DataFrame:
    """Decoded packets -> events with key=value messages; packets that say nothing are dropped."""
    def part(key, col):
        return F.when(col.isNotNull(), F.concat(F.lit(f"{key}="), col.cast("string")))

    l4 = F.lower(F.coalesce(F.col("l4"), F.lit("")))
    ported, tcp = l4.isin("tcp", "udp"), l4 == "tcp"
    text = payload_text(F.col("payload"), payload_limit)
    message = F.concat_ws(
        " ", part("dst_ip", F.col("dst")), part("ip_proto", F.col("ip_proto")),
        F.when(ported, part("src_port", F.col("sport"))), F.when(ported, part("dst_port", F.col("dport"))),
        F.when(tcp, part("tcp_flags", F.col("tcp_flags"))), F.when(l4 == "icmp", "icmp=true"),
        F.when(F.regexp_replace(text, r"(?U)\s", "") != "", F.concat(F.lit("payload="), text)))
    fixed = ("ts", "src", "dst", "ip_proto", "l4", "sport", "dport", "tcp_flags", "payload")
    keep = [c for c in packets.columns if c not in fixed]
    return (packets.withColumn("_message", message).filter("_message <> ''")
            .select(*keep, F.col("ts").alias("timestamp"), F.coalesce("src", F.lit("unknown")).alias("source_ip"),
                    F.lit("pcap_host").alias("hostname"),
                    F.when(l4.isin("tcp", "udp", "icmp"), l4).otherwise("unknown").alias("service"),
                    F.col("_message").alias("message")))


def with_ingest_time(events: DataFrame) -> DataFrame:
    now = F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    return events.withColumn("timestamp", F.coalesce("timestamp", now))


def parse_ingest(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Events from JSON text holding one event or a list of events per row."""
    keep = [c for c in payloads.columns if c != column]
    text = F.trim(F.col(column))
    as_list = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    events = F.from_json(as_list, f"array<{INGEST.simpleString()}>")
    return with_ingest_time(payloads.select(*keep, F.explode(events).alias("e")).select(*keep, "e.*"))


def read_events_json(spark: SparkSession, path, streaming: bool = False, multiline: bool = False) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(INGEST).option("multiLine", multiline)
    return with_ingest_time(reader.json(path))
