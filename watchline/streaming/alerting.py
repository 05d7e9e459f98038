"""Classify a stream of events and keep its alerts."""

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..config import DEFAULTS, micros
from ..functions.verdicts import explanation
from ..operators import detect
from ..operators.classify import score_events
from ..sources.sinks import write_batch
from . import folds


def scored_stream(events: DataFrame, model, cfg=DEFAULTS) -> DataFrame:
    """Allowlisted rows skip the model; rows keep one schema and are joined by union."""
    marked = detect.mark_allowlisted(events, cfg)
    skipped = (marked.filter("allowlisted").withColumn("predicted_label", F.lit("benign"))
               .withColumn("confidence", F.lit(cfg.allowlist_confidence)))
    return skipped.unionByName(score_events(marked.filter("not allowlisted"), model))


def detections_stream(scored: DataFrame, cfg=DEFAULTS, delay: str = "10 minutes") -> DataFrame:
    """Full detections as a stream; dedup state is kept per event text, allowlisted rows pass it by."""
    cols = ("event_id", "ts_us", "source_ip", "hostname", "service", "message", "predicted_label", "confidence")
    flagged = detect.with_severity(detect.with_flags(scored.select(*cols, "allowlisted")), cfg)
    text = explanation(F.col("predicted_label"), F.col("confidence"), F.col("rule_flags"), F.col("allowlisted"))
    done = flagged.withColumn("explanation", text)
    keys = list(detect.DEDUP_KEY) + ["allowlisted"]
    window = micros(cfg.dedup_window_s) + 1
    rest = [f for f in done.schema.fields if f.name not in keys]

    def step(state, key, rows):
        starts = np.ones(len(rows["ts_us"]), bool)
        if not key[-1]:
            state, starts = folds.anchored(state, rows, window)
        return state, np.arange(len(starts)), {"deduplicated": (~starts).tolist()}

    schema = T.StructType([done.schema[k] for k in keys] + rest
                                + [T.StructField("deduplicated", T.BooleanType())])
    return folds.fold(done, keys, schema, None, step, cfg.dedup_window_s, delay, passed=[f.name for f in rest])


def run_alerts(detections: DataFrame, alerts: str, checkpoint: str, outbox: str = None, cfg=DEFAULTS,
               available_now: bool = False) -> StreamingQuery:
    """Start writing alerts (and forwardable detections to the outbox); each micro-batch replaces only itself."""
    writer = (detections.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, batch_id: write_batch(df, batch_id, alerts, outbox, cfg)))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
