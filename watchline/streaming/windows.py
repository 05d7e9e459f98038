"""Windowed streams: per-node ticks and their detectors, sensor consensus, recording sessions."""

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULTS
from ..operators import profiler, routing, votes
from . import stateful
from .folds import event_timed


def tick_counts(stream: DataFrame, tick_s: float, key: str = "source_ip", delay: str = "10 minutes") -> DataFrame:
    """(key, tick, packet_count) for every tick the watermark has closed; tick is the tick's number since the epoch."""
    timed = stream if "event_time" in stream.columns else event_timed(stream, delay)
    width = f"{tick_s:g} seconds"
    counted = timed.groupBy(F.window("event_time", width).alias("w"), key).agg(F.count(F.lit(1)).alias("packet_count"))
    start = F.unix_micros(F.col("w.start"))
    return counted.select(key, F.floor(start / F.lit(int(tick_s * 1_000_000))).alias("tick"), "packet_count")


def on_ticks(detector, path: str, key: str = "source_ip", lookback: int = None):
    """foreachBatch body: adds closed ticks to a table and runs a batch detector over the nodes that got new ones.

    `detector(ticks, key)` is blackhole or amof with its settings bound; its rows for the new ticks are written under
    path/alerts. `lookback` is the number of earlier ticks it needs (all when None). Batch ids name the partitions, so a repeated batch replaces its own output.
    """
    def run(ticks: DataFrame, batch_id: int) -> None:
        if ticks.isEmpty():
            return
        spark = ticks.sparkSession
        (ticks.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/ticks"))
        stored = spark.read.parquet(f"{path}/ticks").filter(F.col("batch_id") <= batch_id)
        new = stored.filter(F.col("batch_id") == batch_id).select(key, "tick")
        history = stored.drop("batch_id").join(new.select(key).distinct(), key, "left_semi")
        if lookback is not None:
            oldest = new.agg(F.min("tick")).first()[0]
            history = history.filter(F.col("tick") >= (0 if oldest is None else oldest) - lookback)
        found = detector(history, key).join(new, [key, "tick"], "left_semi")
        (found.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/alerts"))
    return run


def blackhole_on_ticks(path: str, key: str = "source_ip", cfg=DEFAULTS):
    return on_ticks(lambda ticks, k: routing.blackhole(ticks, k, cfg), path, key, cfg.blackhole_history)


def amof(stream: DataFrame, tick_s: float, key: str = "source_ip", cfg=DEFAULTS, delay: str = "10 minutes") -> DataFrame:
    """(key, tick, slope, first_anomalous_tick) from a stream of events, with a bounded state for each node."""
    return stateful.profiled(tick_counts(stream, tick_s, key, delay), key, cfg)


def amof_on_ticks(path: str, key: str = "source_ip", cfg=DEFAULTS):
    return on_ticks(lambda ticks, k: profiler.amof(ticks, k, cfg), path, key)


def consensus(stream: DataFrame, cfg=DEFAULTS, slide_s: float = 30.0, delay: str = "10 minutes") -> DataFrame:
    """(window, source_ip, malicious_votes, suspicious_votes, total, verdict) for every closed sliding window."""
    sent = votes.forwarded_votes(stream, cfg)
    timed = sent if "event_time" in sent.columns else event_timed(sent, delay)
    window = F.window("event_time", f"{cfg.vote_window_s:g} seconds", f"{slide_s:g} seconds")
    per_sniffer = timed.groupBy(window.alias("w"), "source_ip", "sniffer_id").agg(
        F.max(F.col("predicted_label") == "malicious").alias("bad"))
    per_source = per_sniffer.groupBy("w", "source_ip").agg(
        F.count_if("bad").alias("malicious_votes"), F.count_if(~F.col("bad")).alias("suspicious_votes"))
    return votes.with_verdict(per_source, None, cfg)


def recording_sessions(starts: DataFrame, camera: str = "camera", cfg=DEFAULTS, delay: str = "10 minutes") -> DataFrame:
    """(camera, start_us, end_us, starts) of closed sessions from a stream of camera starts.

    A stream needs a key beside the session; the camera is it, one constant where there is a single camera.
    """
    timed = starts if "event_time" in starts.columns else event_timed(starts, delay)
    session = F.session_window("event_time", f"{cfg.recording_gap_s:g} seconds")
    merged = timed.groupBy(session.alias("s"), camera).agg(F.count(F.lit(1)).alias("starts"))
    return merged.select(camera, F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"), "starts")
