"""Sequential probability ratio test on gateway packet drops."""

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULTS, SECOND_US, micros
from ..storage import checkpointed
from ..ship import ship

KEY = "gateway_id"
_SLOT_US = 60 * SECOND_US
_RESULT = ("struct<stat:double,last_alert:long,alerts:array<struct<event_id:long,ts_us:long,sprt_statistic:double,"
           "total_forwarded:long,total_dropped:long,seen:long>>>")


def boundaries(cfg=DEFAULTS):
    """(accept-normal, alert) limits of the test statistic."""
    return (math.log(cfg.sprt_beta / (1 - cfg.sprt_alpha)), math.log((1 - cfg.sprt_beta) / cfg.sprt_alpha))


def weights(cfg=DEFAULTS):
    """Log-likelihood ratio of one dropped and of one forwarded packet."""
    return (math.log(cfg.sprt_p1 / cfg.sprt_p0), math.log((1 - cfg.sprt_p1) / (1 - cfg.sprt_p0)))


def advance(stat, last, ts, forwarded, dropped, seen, cfg=DEFAULTS):
    """One observation: (statistic, last alert time or None, statistic alerted at or None)."""
    low, high = boundaries(cfg)
    per_drop, per_forward = weights(cfg)
    stat += dropped * per_drop + forwarded * per_forward
    if stat <= low:
        stat = 0.0
    quiet = last is not None and ts - last <= micros(cfg.sprt_cooldown_s)
    if stat >= high and seen >= cfg.sprt_min_observations and not quiet:
        return 0.0, ts, stat
    return stat, last, None


def _chunked(obs: DataFrame, chunk_rows: int) -> DataFrame:
    """(gateway, chunk, rows, totals before the chunk); chunks follow time and hold about chunk_rows rows."""
    slots = obs.groupBy(KEY, F.floor(F.col("ts_us") / _SLOT_US).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("forwarded").alias("f"), F.sum("dropped").alias("d"))
    before = Window.partitionBy(KEY).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(KEY, "slot", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before")
                                        for c in ("n", "f", "d")])
    slots = slots.withColumn("chunk", F.floor(F.col("n_before") / chunk_rows))
    # One plan at every size: observations that are small on disk are not sent to every task either.
    placed = obs.withColumn("slot", F.floor(F.col("ts_us") / _SLOT_US)).join(slots.hint("merge"), [KEY, "slot"])
    return placed.groupBy(KEY, "chunk").agg(
        F.min("n_before").alias("n_before"), F.min("f_before").alias("f_before"), F.min("d_before").alias("d_before"),
        F.sort_array(F.collect_list(F.struct("ts_us", "event_id", "forwarded", "dropped"))).alias("rows"))


def _run(cfg):
    def scan(ts, ids, forwarded, dropped, n, f, d, stat, last):
        out = []
        for ts_, ids_, fw, dr, n_, f_, d_, s, a in zip(*[
                c.to_pylist() for c in (ts, ids, forwarded, dropped, n, f, d, stat, last)]):
            alerts = []
            for t, i, x, y in zip(ts_, ids_, fw, dr):
                n_, f_, d_ = n_ + 1, f_ + x, d_ + y
                s, a, hit = advance(s, a, t, x, y, n_, cfg)
                if hit is not None:
                    alerts.append({"event_id": i, "ts_us": t, "sprt_statistic": hit, "total_forwarded": f_,
                                   "total_dropped": d_, "seen": n_})
            out.append({"stat": s, "last_alert": a, "alerts": alerts})
        alert = pa.struct([("event_id", pa.int64()), ("ts_us", pa.int64()), ("sprt_statistic", pa.float64()),
                           ("total_forwarded", pa.int64()), ("total_dropped", pa.int64()), ("seen", pa.int64())])
        return pa.array(out, pa.struct([("stat", pa.float64()), ("last_alert", pa.int64()), ("alerts", pa.list_(alert))]))

    def typed(ts: pa.Array, ids: pa.Array, forwarded: pa.Array, dropped: pa.Array, n: pa.Array, f: pa.Array,
              d: pa.Array, stat: pa.Array, last: pa.Array) -> pa.Array:
        return scan(ts, ids, forwarded, dropped, n, f, d, stat, last)

    return F.arrow_udf(typed, _RESULT)


def _scanned(chunks: DataFrame, cfg) -> DataFrame:
    """chunks with in_stat, in_last -> (gateway, chunk, in_stat, in_last, r)"""
    return chunks.select(KEY, "chunk", "in_stat", "in_last", _run(cfg)(
        "rows.ts_us", "rows.event_id", "rows.forwarded", "rows.dropped", "n_before", "f_before", "d_before",
        "in_stat", "in_last").alias("r"))


def _resolved(obs: DataFrame, cfg, chunk_rows: int):
    """(chunks, the entry and end state of every chunk): a chunk's entry is where the one before it ends.

    Chunks start from a guess (statistic 0, no alert); a chunk whose predecessor ends otherwise is run again from that
    end until nothing changes. Resets make runs from different starts meet quickly, so few chunks are run twice. The
    rows of the chunks are shuffled and stored once: a round sends only the states of stale chunks, at most one for
    every chunk_rows rows, and keeps no alerts.
    """
    ship(obs.sparkSession)
    start = (F.lit(0.0).alias("in_stat"), F.lit(None).cast("long").alias("in_last"))
    ends = lambda scanned: scanned.select(
        KEY, "chunk", "in_stat", "in_last", F.col("r.stat").alias("stat"), F.col("r.last_alert").alias("last"))
    chunks = checkpointed(_chunked(obs, chunk_rows))
    done = checkpointed(ends(_scanned(chunks.select("*", *start), cfg)))
    order = Window.partitionBy(KEY).orderBy("chunk")
    while True:
        linked = done.select(
            "*", F.lag("stat", 1, 0.0).over(order).alias("new_stat"), F.lag("last").over(order).alias("new_last"))
        stale = checkpointed(linked.filter(~(F.col("in_stat").eqNullSafe(F.col("new_stat"))
                                             & F.col("in_last").eqNullSafe(F.col("new_last")))).select(
            KEY, "chunk", F.col("new_stat").alias("in_stat"), F.col("new_last").alias("in_last")))
        if stale.isEmpty():
            return chunks, done
        again = ends(_scanned(chunks.join(F.broadcast(stale), [KEY, "chunk"]), cfg))
        done = checkpointed(done.join(stale.select(KEY, "chunk"), [KEY, "chunk"], "left_anti").unionByName(again))


def _replayed(obs: DataFrame, cfg, chunk_rows: int) -> DataFrame:
    """Every chunk scanned from its true entry state; a gateway's first chunk has none to be sent."""
    chunks, done = _resolved(obs, cfg, chunk_rows)
    known = done.where("in_stat <> 0 or in_last is not null").select(KEY, "chunk", "in_stat", "in_last")
    return _scanned(chunks.join(F.broadcast(known), [KEY, "chunk"], "left").withColumn(
        "in_stat", F.coalesce("in_stat", F.lit(0.0))), cfg)


def gateway_alerts(obs: DataFrame, cfg=DEFAULTS, chunk_rows: int = 200_000) -> DataFrame:
    """(gateway, event_id, ts_us, sprt_statistic, estimated_pdp, observation_count, message) per alert."""
    hits = _replayed(obs, cfg, chunk_rows).select(KEY, F.explode("r.alerts").alias("a")).select(KEY, "a.*")
    total = F.col("total_forwarded") + F.col("total_dropped")
    pdp = F.when(total > 0, F.col("total_dropped").cast("double") / total).otherwise(0.0)
    normal, attack = [f"{p:.1%}".replace("%", "%%") for p in (cfg.sprt_p0, cfg.sprt_p1)]
    # Fixed value: the text of the alert.
    text = F.format_string(
        f"Gateway %s packet-drop probability %.1f%% exceeds SPRT threshold (normal={normal}, attack={attack})",
        F.col(KEY), F.col("estimated_pdp") * 100)
    return (hits.withColumn("estimated_pdp", pdp)
            .withColumn("observation_count", F.least("seen", F.lit(cfg.sprt_window).cast("long")))
            .withColumn("message", text)
            .select(KEY, "event_id", "ts_us", "sprt_statistic", "estimated_pdp", "observation_count", "message"))


def gateway_status(obs: DataFrame, cfg=DEFAULTS, chunk_rows: int = 200_000) -> DataFrame:
    """Totals, drop estimate, current statistic and observation count per gateway."""
    totals = obs.groupBy(KEY).agg(F.sum("forwarded").alias("total_forwarded"), F.sum("dropped").alias("total_dropped"),
                                  F.least(F.count(F.lit(1)), F.lit(cfg.sprt_window).cast("long")).alias("observation_count"))
    total = F.col("total_forwarded") + F.col("total_dropped")
    now = _resolved(obs, cfg, chunk_rows)[1].groupBy(KEY).agg(F.max_by("stat", "chunk").alias("_s"))
    return totals.join(now, KEY).select(
        KEY, "total_forwarded", "total_dropped",
        F.when(total > 0, F.round(F.col("total_dropped").cast("double") / total, 4)).otherwise(0.0).alias("estimated_pdp"),
        F.round("_s", 4).alias("sprt_stat"), F.lit(round(boundaries(cfg)[1], 4)).alias("upper_threshold"),
        F.col("observation_count").cast("long").alias("observation_count"))
