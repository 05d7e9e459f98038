"""Per-key stateful streams. Each has a batch twin in watchline.operators with the same meaning.

Rows are taken in (ts_us, event_id) order inside a micro-batch and in arrival order between micro-batches; rows
older than the watermark are dropped (`late` keeps them). A group of Spark holds many keys, dealt by hash, so that a micro-batch
pays for groups and rows and not for each key; its state is one record with an entry for each key, which expires by event time.
"""

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import DEFAULTS, micros
from ..operators import gateway, protocol, trust
from ..ship import ship
from . import stateful

def event_timed(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def timed(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return stream if "event_time" in stream.columns else event_timed(stream, delay)


#: Groups that the keys of a stream are dealt to; fixed, since stored state is found by the number of its group.
GROUPS = 256


def fold(stream: DataFrame, keys, schema, first, step, idle_s: float, delay: str = "10 minutes", needs=(),
         passed=("event_id", "ts_us")) -> DataFrame:
    """Run `step(state, key, rows) -> (state, at, columns)` over each key and micro-batch.

    `rows` has an array for each of ts_us and `needs`, in (ts_us, event_id) order. A row goes out for each place in `at`: the key,
    the `passed` columns there, and those of `columns` (name -> values). States are plain Python values. A key idle for idle_s
    (event time) is forgotten.
    """
    ship(stream.sparkSession)
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, idle_ms = fields.names, int(idle_s * 1000)
    wanted = ["ts_us", *needs]

    def left(held, memory):
        """Keep what has not expired; the group wakes up when the next of its keys does."""
        now = memory.getCurrentWatermarkMs()
        held = {k: v for k, v in held.items() if v[1] >= now}
        if not held:
            memory.remove()
            return
        memory.update((pickle.dumps(list(held.items())),))
        memory.setTimeoutTimestamp(max(min(v[1] for v in held.values()), now + 1))

    def run(group, frames, memory):
        held = dict(pickle.loads(memory.get[0])) if memory.exists else {}
        if memory.hasTimedOut:
            left(held, memory)
            return
        frame = pd.concat(list(frames), ignore_index=True)
        code = np.zeros(len(frame), np.int64)
        for k in keys:
            one, _ = pd.factorize(frame[k], use_na_sentinel=False)
            code = np.unique(code * (int(one.max()) + 1) + one, return_inverse=True)[1]
        frame = frame.assign(_code=code).sort_values(["_code", "ts_us", "event_id"], kind="stable", ignore_index=True)
        code = frame["_code"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]]).tolist()
        heads = zip(*[frame[k].iloc[cuts[:-1]].astype(object).where(lambda x: x.notna(), None).tolist() for k in keys])
        values = {c: frame[c].to_numpy() for c in wanted}
        now, places, made = memory.getCurrentWatermarkMs(), [], {n: [] for n in names if n not in (*keys, *passed)}
        for key, a, b in zip(heads, cuts, cuts[1:]):
            state, at, columns = step(held[key][0] if key in held else first, key, {c: v[a:b] for c, v in values.items()})
            held[key] = state, max(int(values["ts_us"][b - 1]) // 1000 + idle_ms + 1, now + 1)
            if len(at):
                places.append(np.asarray(at, np.int64) + a)
                for n, v in columns.items():
                    made[n].extend(v)
        left(held, memory)
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        kept = {n: frame[n].iloc[at].reset_index(drop=True) for n in (*keys, *passed)}
        yield pd.DataFrame(kept | {n: pd.Series(v, dtype=None if v else object) for n, v in made.items()}, columns=names)

    rows = timed(stream, delay)
    used = dict.fromkeys([*keys, "event_id", "ts_us", "event_time", *needs, *passed])
    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("_group"), *used).groupBy("_group").applyInPandasWithState(
        run, fields, T._parse_datatype_string("held binary"), "append", GroupStateTimeout.EventTimeTimeout)


def _typed(df_schema, keys, more):
    return T.StructType([df_schema[k] for k in keys] + T._parse_datatype_string(more).fields)


def anchored(state, rows, quiet_us):
    """(state, whether each row starts a quiet time); the state is the end of the last one."""
    ts = rows["ts_us"].astype(np.int64)
    if len(ts) == 1:
        start = state is None or int(ts[0]) >= state
        return int(ts[0]) + quiet_us if start else state, np.array([start])
    at, until = stateful.fires(ts, np.arange(len(ts)), state, quiet_us)
    starts = np.zeros(len(ts), bool)
    starts[at] = True
    return until, starts


def dedup(stream: DataFrame, keys=("source_ip", "hostname", "service", "message"), cfg=DEFAULTS, **kw) -> DataFrame:
    """Adds deduplicated to (keys, event_id, ts_us)."""
    window = micros(cfg.dedup_window_s) + 1

    def step(state, key, rows):
        state, starts = anchored(state, rows, window)
        return state, np.arange(len(starts)), {"deduplicated": (~starts).tolist()}

    schema = _typed(stream.schema, keys, "event_id long, ts_us long, deduplicated boolean")
    return fold(stream, keys, schema, None, step, cfg.dedup_window_s, **kw)


def patterns(stream: DataFrame, specs, key: str = "source_ip", cfg=DEFAULTS, **kw) -> DataFrame:
    """Event-pattern alerts (key, pattern_name, event_id, ts_us, matched_count, severity)."""
    marked = stream
    for i, p in enumerate(specs):
        marked = marked.withColumn(f"candidate_{i}", F.coalesce(p.candidate, F.lit(False))).withColumn(
            f"value_{i}", (p.distinct if p.distinct is not None else F.lit(None)).cast("string"))
    spec = [(p.name, micros(p.window_s), p.min_count, p.severity, p.distinct is not None, tuple(p.requires)) for p in specs]
    # Patterns that others need are evaluated before them, so one event can complete a whole chain.
    order, placed = [], set()
    while len(order) < len(spec):
        ready = [i for i, s in enumerate(spec) if i not in order and not {n for n in s[5] if n != s[0]} - placed
                 & {t[0] for t in spec}]
        ready = ready or [i for i in range(len(spec)) if i not in order]  # a circle, or a pattern that is not here
        order += ready
        placed |= {spec[i][0] for i in ready}
    quiet = micros(cfg.pattern_cooldown_s)

    schema = _typed(stream.schema, [key], "pattern_name string, event_id long, ts_us long, matched_count long, severity string")
    processor = stateful.Patterns(spec, order, quiet)
    needs = [f"{c}_{i}" for i in range(len(spec)) for c in ("candidate", "value")]
    return fold(marked, [key], schema, processor.first, processor.step, cfg.pattern_idle_s, needs=needs, **kw)


def flood(stream: DataFrame, key: str = "source_ip", cfg=DEFAULTS, **kw) -> DataFrame:
    """(key, event_id, ts_us, flag): dos_flood_detected / dos_flood_ongoing."""
    schema = _typed(stream.schema, [key], "event_id long, ts_us long, flag string")
    processor = stateful.flood_processor(cfg)
    return fold(stream, [key], schema, processor.first, processor.step, cfg.flood_cooldown_s + cfg.flood_window_s, **kw)


def gateway_sprt(stream: DataFrame, cfg=DEFAULTS, idle_s: float = 30 * 86400.0, **kw) -> DataFrame:
    """(gateway_id, event_id, ts_us, sprt_statistic, estimated_pdp, observation_count) per alert."""
    def step(state, k, rows):
        stat, last, n, f, d = state
        forwarded, dropped, ts = (rows[c].astype(np.int64) for c in ("forwarded", "dropped", "ts_us"))
        all_f, all_d = f + np.cumsum(forwarded), d + np.cumsum(dropped)
        hits, stats = [], []
        for i, (t, a, b) in enumerate(zip(ts.tolist(), forwarded.tolist(), dropped.tolist())):
            stat, last, hit = gateway.advance(stat, last, t, a, b, n + i + 1, cfg)
            if hit is not None:
                hits.append(i)
                stats.append(hit)
        at = np.array(hits, np.int64)
        total, count = all_f[at] + all_d[at], n + at + 1
        pdp = np.divide(all_d[at], total, out=np.zeros(len(at)), where=total > 0)
        shown = count if cfg.sprt_window is None else np.minimum(count, cfg.sprt_window)
        return (stat, last, n + len(ts), int(all_f[-1]), int(all_d[-1])), at, {
            "sprt_statistic": stats, "estimated_pdp": pdp.tolist(), "observation_count": shown.tolist()}

    schema = _typed(stream.schema, [gateway.KEY],
                    "event_id long, ts_us long, sprt_statistic double, estimated_pdp double, observation_count long")
    return fold(stream, [gateway.KEY], schema, (0.0, None, 0, 0, 0), step, idle_s, needs=("forwarded", "dropped"), **kw)


def trust_path(stream: DataFrame, key: str = "source_ip", cfg=DEFAULTS, **kw) -> DataFrame:
    """(key, event_id, ts_us, score) after every event; a source idle past the record lifetime starts afresh."""
    moves = {"malicious": cfg.trust_malicious, "suspicious": cfg.trust_suspicious}
    units = {k: int(round(v * trust.UNIT)) for k, v in moves.items()}
    other, first = int(round(cfg.trust_benign * trust.UNIT)), int(round(cfg.trust_initial * trust.UNIT))

    def step(state, k, rows):
        move = np.array([units.get(label, other) for label in rows["predicted_label"]], np.int64)
        path = trust.clamped_sums(move, np.array([len(move)]), np.array([state]))
        return int(path[-1]), np.arange(len(path)), {"score": (path / trust.UNIT).tolist()}

    schema = _typed(stream.schema, [key], "event_id long, ts_us long, score double")
    return fold(stream, [key], schema, first, step, cfg.trust_ttl_s, needs=("predicted_label",), **kw)


def protocol_violations(stream: DataFrame, transitions=protocol.DEFAULT_TRANSITIONS, idle_s: float = 86400.0,
                        **kw) -> DataFrame:
    """(source_ip, protocol, event_id, ts_us, from_state, to_state)."""
    edges = protocol.edge_table(transitions)
    tidy = (stream.withColumn("protocol", F.lower("protocol")).withColumn("event_state", F.upper("event_state"))
            .withColumn("next_state", F.upper("next_state")))

    def step(state, k, rows):
        now, allowed, at, was, became = state, edges.get(k[1], set()), [], [], []
        nexts = [x if isinstance(x, str) else None for x in rows["next_state"]]
        for i, (event, following) in enumerate(zip(rows["event_state"].tolist(), nexts)):
            now, bad = protocol.follow(now, event, following, allowed)
            if bad is not None:
                at.append(i)
                was.append(bad)
                became.append(following)
        return now, at, {"from_state": was, "to_state": became}

    keys = ["source_ip", "protocol"]
    schema = _typed(tidy.schema, keys, "event_id long, ts_us long, from_state string, to_state string")
    return fold(tidy, keys, schema, protocol.UNSEEN, step, idle_s, needs=("event_state", "next_state"), **kw)


#: Parts of a time bucket that hold its events; each has a copy of the bucket's motions.
SALTS = 8


def with_last_motion(detections: DataFrame, motion: DataFrame, cfg=DEFAULTS, delay: str = "10 minutes", salts: int = SALTS) -> DataFrame:
    """(event_id, ts_us, motion_ts_us): the latest motion at or before the event, if recent enough.

    Events and motions of two watermarked streams meet by time bucket: an event lies in its own, a motion in its own and the next
    one. A bucket keeps its rows until the watermark has passed its end; then they are sorted and each event takes the last motion
    before it, so the work is linear in the rows however dense a bucket is. Events of a bucket are spread over salts.
    """
    ship(detections.sparkSession)
    window = micros(cfg.motion_window_s)
    bucket = F.floor(F.col("ts_us") / window)
    left = timed(detections, delay).where("ts_us is not null").select(
        bucket.alias("bucket"), F.pmod(F.hash("event_id"), F.lit(salts)).alias("salt"), "event_time", "ts_us",
        F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), F.when(F.col("event_id").isNull(), 2).otherwise(1).alias("kind"))
    right = timed(motion, delay).where("ts_us is not null").select(
        F.explode(F.array(bucket, bucket + 1)).alias("bucket"), "event_time", "ts_us").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "event_time", "ts_us", F.lit(0).cast("long").alias("event_id"),
        F.lit(0).alias("kind"))

    def run(key, frames, memory):
        held = np.frombuffer(memory.get[0], np.int64).reshape(-1, 3) if memory.exists else np.zeros((0, 3), np.int64)
        closed = memory.hasTimedOut
        if not closed:
            held = np.concatenate([held, *[f[["ts_us", "kind", "event_id"]].to_numpy(np.int64) for f in frames]])
            held = np.unique(held, axis=0)
            end, now = (int(key[0]) + 1) * window // 1000, memory.getCurrentWatermarkMs()
            closed = end < now
        if not closed:
            memory.update((held.tobytes(),))
            memory.setTimeoutTimestamp(end)
            return
        if memory.exists:
            memory.remove()
        is_motion = held[:, 1] == 0
        moved, events = held[is_motion, 0], held[~is_motion]
        at = np.searchsorted(moved, events[:, 0], side="right") - 1
        last = moved[np.maximum(at, 0)] if len(moved) else np.zeros(len(events), np.int64)
        near = (at >= 0) & (events[:, 0] - last <= window)
        yield pd.DataFrame({"event_id": pd.array(events[:, 2], "Int64"), "ts_us": events[:, 0], "motion_ts_us": pd.array(last, "Int64")}).assign(
            event_id=lambda x: x["event_id"].mask(events[:, 1] == 2), motion_ts_us=lambda x: x["motion_ts_us"].mask(~near))

    return left.union(right).groupBy("bucket", "salt").applyInPandasWithState(
        run, T._parse_datatype_string("event_id long, ts_us long, motion_ts_us long"), T._parse_datatype_string("held binary"), "append",
        GroupStateTimeout.EventTimeTimeout)
