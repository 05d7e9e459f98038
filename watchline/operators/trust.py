"""Trust scores per source, their spread to neighbours, and protocol automata."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULTS, micros
from ..functions.verdicts import trust_multiplier
from ..storage import checkpointed
from . import sliced
from ..ship import ship

# Scores are counted in millionths, so clamped sums are exact and can be regrouped freely.
UNIT = 1_000_000
_UNBOUNDED = 10 ** 15


def _units(x: float) -> int:
    return int(round(x * UNIT))


def _moves(detections: DataFrame, key: str, cfg) -> DataFrame:
    label = F.col("predicted_label")
    move = (F.when(label == "malicious", _units(cfg.trust_malicious))
            .when(label == "suspicious", _units(cfg.trust_suspicious)).otherwise(_units(cfg.trust_benign)))
    return detections.select(key, "ts_us", "event_id", move.cast("long").alias("move"))


def _slice_functions(packed: DataFrame) -> DataFrame:
    """A slice maps an entry score x to least(high, greatest(low, x + shift))."""
    def clamp(x):
        return F.least(F.greatest(x, F.lit(0).cast("long")), F.lit(UNIT).cast("long"))

    return packed.withColumn("f", F.aggregate("rows.move", _identity(), lambda acc, m: F.struct(
        (acc["shift"] + m).alias("shift"), clamp(acc["low"] + m).alias("low"), clamp(acc["high"] + m).alias("high"))))


def _enter(x, f):
    return F.least(f["high"], F.greatest(f["low"], x + f["shift"]))


def _then(f, g):
    """The function that applies f, then g."""
    return F.struct((f["shift"] + g["shift"]).alias("shift"), _enter(f["low"], g).alias("low"),
                    _enter(f["high"], g).alias("high"))


def _identity():
    return F.struct(F.lit(0).cast("long").alias("shift"), F.lit(-_UNBOUNDED).cast("long").alias("low"),
                    F.lit(_UNBOUNDED).cast("long").alias("high"))


def trust_scores(detections: DataFrame, cfg=DEFAULTS, key: str = "source_ip") -> DataFrame:
    """(key, score): every event moves the score, clamped to [0, 1] after each move."""
    summaries = _slice_functions(sliced.pack(_moves(detections, key, cfg), [key], ["move"])).drop("rows")
    initial = F.lit(_units(cfg.trust_initial)).cast("long")
    last = sliced.final(summaries, [key], "f", initial, _enter)
    return last.select(key, (F.col("state") / F.lit(float(UNIT))).alias("score"))


def clamped_sums(moves, lengths, entry):
    """Running sums of the moves of each slice from its entry score, clamped to [0, UNIT] after each move.

    Every move is a function min(high, max(low, x + shift)); prefixes of them are composed in steps of doubling length.
    """
    shift, low, high = moves.copy(), np.zeros(len(moves), np.int64), np.full(len(moves), UNIT, np.int64)
    place = np.arange(len(moves)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    step = 1
    while step <= place.max(initial=0):
        at = np.flatnonzero(place >= step)
        before, s, lo, hi = at - step, shift[at], low[at], high[at]
        low[at], high[at], shift[at] = (np.minimum(hi, np.maximum(lo, low[before] + s)),
                                        np.minimum(hi, np.maximum(lo, high[before] + s)), shift[before] + s)
        step *= 2
    return np.minimum(high, np.maximum(low, np.repeat(entry, lengths) + shift))


def trust_path(detections: DataFrame, cfg=DEFAULTS, key: str = "source_ip",
               slice_us: int = sliced.SLICE_US) -> DataFrame:
    """(key, event_id, ts_us, score): the score after every event."""
    ship(detections.sparkSession)
    packed = sliced.pack(_moves(detections, key, cfg), [key], ["move"], slice_us)
    first = _units(cfg.trust_initial)

    def entries(functions: pa.Array) -> pa.Array:
        out = []
        for key_functions in functions.to_pylist():
            x, seen = first, []
            for f in key_functions:
                seen.append(x)
                x = min(f["high"], max(f["low"], x + f["shift"]))
            out.append(seen)
        return pa.array(out, pa.list_(pa.int64()))

    def scores(moves: pa.Array, entry: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(moves).to_numpy(zero_copy_only=False).astype(np.int64)
        path = clamped_sums(moves.flatten().to_numpy(zero_copy_only=False), lengths, entry.to_numpy(zero_copy_only=False))
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(path / UNIT))

    entry = sliced.walk(_slice_functions(packed).drop("rows"), [key], "f", F.arrow_udf(entries, "array<long>"))
    replay = F.arrow_udf(scores, "array<double>")
    return (packed.join(entry, [key, "slice"])
            .select(key, F.explode(F.arrays_zip("rows", replay("rows.move", "entry").alias("score"))).alias("r"))
            .select(key, "r.rows.event_id", "r.rows.ts_us", "r.score"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Neighbours know each other: (src, dst) in both directions, once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()


def disseminate(nodes: DataFrame, edges: DataFrame, strategy: str = "nbtd", cfg=DEFAULTS) -> DataFrame:
    """One round: nodes below the initial score push a share of the shortfall onto their neighbours.

    nodes(ip, score[, cluster_id]); edges(src, dst), already in both directions. Returns nodes with new scores.
    """
    if strategy not in ("nbtd", "cntd"):
        raise ValueError("strategy must be 'nbtd' or 'cntd'")
    short = nodes.filter(F.col("score") < cfg.trust_initial)
    if strategy == "nbtd":
        push = short.select(F.col("ip").alias("src"), (
            (F.lit(cfg.trust_initial) - F.col("score")) * cfg.trust_neighbour_weight).alias("push"))
        landed = edges.join(push, "src")
    else:
        push = short.select(F.col("ip").alias("src"), F.col("cluster_id").alias("_c"),
                            (F.lit(cfg.trust_initial) - F.col("score")).alias("gap"))
        other = nodes.select(F.col("ip").alias("dst"), F.col("cluster_id").alias("_oc"))
        same = (F.coalesce("_c", F.lit("")) != "") & (F.col("_c") == F.col("_oc"))
        weight = F.when(same, cfg.trust_cluster_weight).otherwise(cfg.trust_outside_weight)
        landed = edges.join(push, "src").join(other, "dst").withColumn("push", F.col("gap") * weight)
    total = landed.groupBy(F.col("dst").alias("ip")).agg(F.sum("push").alias("_push"))
    return (nodes.join(total, "ip", "left")
            .withColumn("score", F.when(F.col("_push").isNull(), F.col("score"))
                        .otherwise(F.greatest(F.lit(0.0), F.col("score") - F.col("_push")))).drop("_push"))


def trust_rounds(detections: DataFrame, edges: DataFrame, tick_us: int, strategy: str = "nbtd", cfg=DEFAULTS,
                 clusters: DataFrame = None) -> DataFrame:
    """Direct updates and dissemination together, in rounds of tick_us.

    Within a round each source applies its own events, then the sources seen in the round push once. With at most
    one event per neighbourhood and tick this equals pushing after every event; coarser ticks trade that order for
    parallel rounds. The events are read once, into one function per source and tick; rounds work on those and on the
    scores, which are checkpointed between rounds.
    """
    slice_us = sliced.SLICE_US if tick_us % sliced.SLICE_US == 0 else tick_us
    moved = _slice_functions(sliced.pack(_moves(detections, "source_ip", cfg), ["source_ip"], ["move"], slice_us))
    steps = moved.groupBy(F.col("source_ip").alias("ip"), F.floor(F.col("slice") * slice_us / tick_us).alias("tick")).agg(
        F.sort_array(F.collect_list(F.struct("slice", "f"))).alias("fs"))
    steps = checkpointed(steps.select("ip", "tick", F.aggregate("fs.f", _identity(), _then).alias("f")))
    ips = steps.select("ip").union(edges.select("src")).union(edges.select("dst")).distinct()
    nodes = ips.withColumn("score", F.lit(cfg.trust_initial))
    nodes = nodes.join(clusters, "ip", "left") if clusters is not None else nodes.withColumn("cluster_id", F.lit(""))
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    scale = F.lit(float(UNIT))
    score = F.least(F.col("f.high") / scale, F.greatest(F.col("f.low") / scale, F.col("score") + F.col("f.shift") / scale))
    for row in steps.select("tick").distinct().orderBy("tick").toLocalIterator():
        part = steps.filter(F.col("tick") == row.tick).drop("tick")
        direct = nodes.join(part, "ip", "left").withColumn(
            "score", F.when(F.col("f").isNull(), F.col("score")).otherwise(score)).drop("f")
        seen = edges.join(part.select(F.col("ip").alias("src")), "src", "left_semi")
        nodes = checkpointed(disseminate(direct, seen, strategy, cfg))
    return nodes


def severity_multipliers(detections: DataFrame, scores: DataFrame, cfg=DEFAULTS) -> DataFrame:
    return (detections.join(scores, "source_ip", "left")
            .withColumn("multiplier", trust_multiplier(F.col("score"), cfg)))


def trust_snapshot(detections: DataFrame, clusters: DataFrame = None, cfg=DEFAULTS) -> DataFrame:
    label = F.col("predicted_label")
    counts = detections.groupBy("source_ip").agg(
        F.count_if(label == "malicious").alias("malicious_count"),
        F.count_if(label == "suspicious").alias("suspicious_count"),
        F.count_if(~label.isin("malicious", "suspicious")).alias("benign_count"),
        F.max("ts_us").alias("last_updated_us"))
    out = trust_scores(detections, cfg).join(counts, "source_ip").withColumn("score", F.round("score", 4))
    if clusters is None:
        return out.withColumn("cluster_id", F.lit(""))
    return (out.join(clusters.withColumnRenamed("ip", "source_ip"), "source_ip", "left")
            .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(""))))


def live_records(detections: DataFrame, now_us: int, cfg=DEFAULTS) -> DataFrame:
    """Trust snapshot without sources idle longer than the record lifetime."""
    return trust_snapshot(detections, cfg=cfg).filter(
        F.lit(now_us) - F.col("last_updated_us") <= micros(cfg.trust_ttl_s))
