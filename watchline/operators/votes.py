"""Multi-sensor voting on sources."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULTS, micros


def forwarded_votes(detections: DataFrame, cfg=DEFAULTS) -> DataFrame:
    """Confident, non-benign detections are the votes sniffers send; the filter runs below any shuffle."""
    return detections.filter((F.col("predicted_label") != "benign")
                             & (F.col("confidence") >= cfg.vote_confidence))


def kept_votes(votes: DataFrame, cfg=DEFAULTS) -> DataFrame:
    """All votes; with `vote_depth` set, the last that many of each (source, sniffer)."""
    if cfg.vote_depth is None:
        return votes
    newest = Window.partitionBy("source_ip", "sniffer_id").orderBy(F.col("ts_us").desc(), F.col("event_id").desc())
    return votes.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= cfg.vote_depth).drop("_r")


def latest(df: DataFrame) -> Column:
    return df.agg(F.max("ts_us")).scalar()


def sniffer_votes(detections: DataFrame, now=None, cfg=DEFAULTS) -> DataFrame:
    """(source_ip, sniffer_id, vote): each sniffer's most severe recent label."""
    now = latest(detections) if now is None else now
    recent = kept_votes(forwarded_votes(detections, cfg), cfg).filter(
        now - F.col("ts_us") <= micros(cfg.vote_window_s))
    return recent.groupBy("source_ip", "sniffer_id").agg(
        F.when(F.max(F.col("predicted_label") == "malicious"), "malicious").otherwise("suspicious").alias("vote"))


def with_verdict(counted: DataFrame, registered: DataFrame = None, cfg=DEFAULTS) -> DataFrame:
    """Adds total and verdict to rows holding malicious_votes and suspicious_votes.

    The denominator is the number of registered sniffers, or of those voting on the source when none are given.
    """
    voters = F.col("malicious_votes") + F.col("suspicious_votes")
    total = voters
    if registered is not None:
        known = registered.agg(F.countDistinct("sniffer_id")).scalar()
        total = F.when(known > 0, known).otherwise(voters)
    counted = counted.withColumn("total", total)
    share = F.when(F.col("total") > 0, F.col("malicious_votes") / F.col("total"))
    either = F.when(F.col("total") > 0, voters / F.col("total"))
    return counted.withColumn("verdict", F.when(share >= cfg.consensus, "malicious").when(
        either >= cfg.consensus, "suspicious"))


def consensus(votes: DataFrame, registered: DataFrame = None, cfg=DEFAULTS) -> DataFrame:
    """(source_ip, malicious_votes, suspicious_votes, total, verdict or null)."""
    counted = votes.groupBy("source_ip").agg(
        F.count_if(F.col("vote") == "malicious").alias("malicious_votes"),
        F.count_if(F.col("vote") == "suspicious").alias("suspicious_votes"))
    return with_verdict(counted, registered, cfg)


def active_threats(detections: DataFrame, now=None, registered: DataFrame = None, window_s: float = None,
                   cfg=DEFAULTS) -> DataFrame:
    """Sources with a verdict: sniffers ever seen voting, recent votes and the latest recent vote time.

    window_s changes which votes are counted, not which ones decide.
    """
    sent = kept_votes(forwarded_votes(detections, cfg), cfg)
    if now is None:
        # Joined as a row: Spark 4.1 cannot write a plan whose aggregate compares with the scalar subquery over the same rows.
        sent, now = sent.crossJoin(F.broadcast(detections.agg(F.max("ts_us").alias("_now")))), F.col("_now")
    age = now - F.col("ts_us")
    deciding, counted = age <= micros(cfg.vote_window_s), age <= micros(window_s or cfg.vote_window_s)
    per = sent.groupBy("source_ip", "sniffer_id").agg(
        F.count_if(deciding).alias("recent"),
        F.count_if(deciding & (F.col("predicted_label") == "malicious")).alias("malicious"),
        F.count_if(counted).alias("n"), F.max(F.when(counted, F.col("ts_us"))).alias("last"))
    sources = per.groupBy("source_ip").agg(
        F.count_if(F.col("malicious") > 0).alias("malicious_votes"),
        F.count_if((F.col("recent") > 0) & (F.col("malicious") == 0)).alias("suspicious_votes"),
        F.count(F.lit(1)).alias("sniffer_count"), F.sum("n").alias("cci_count"), F.max("last").alias("latest_ts_us"))
    return with_verdict(sources, registered, cfg).filter(F.col("verdict").isNotNull()).select(
        "source_ip", "verdict", "sniffer_count", "cci_count", "latest_ts_us")
