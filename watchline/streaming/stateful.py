"""What streams keep of a key: lists of hits, kept to what a window can still need, and the state of chained profiles.

A hit list has one entry for each instant (or each distinct value), not one for each event, and loses what has left its window
with every micro-batch. The rows of a key in a micro-batch are evaluated as arrays; only alerts are handled one by one.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..config import DEFAULTS, micros
from ..ship import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(timed: DataFrame, keys, processor: StatefulProcessor, fields: T.StructType, mode: str = "EventTime") -> DataFrame:
    """The processor over each key; the session's state store becomes the one that holds lists and timers."""
    spark = timed.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=fields, outputMode="Append",
                                                           timeMode=mode)


def fires(ts, eligible, until, quiet):
    """Rows of `eligible` (increasing) that fire when each starts a quiet time, and the end of the last one."""
    out, at = [], 0
    times = ts[eligible]
    while True:
        if until is not None:
            at = max(at, int(np.searchsorted(times, until)))
        if at >= len(eligible):
            return out, until
        out.append(int(eligible[at]))
        until = int(times[at]) + quiet
        at += 1


def in_window(now, hits, counts, width):
    """For each instant: how many of the counted hits lie in the closed window that ends there."""
    total = np.concatenate([[0], np.cumsum(counts)])
    return total[np.searchsorted(hits, now, side="right")] - total[np.searchsorted(hits, now - width)]


def distinct_in_window(now, hits, values, width):
    """For each instant: how many different values lie in the closed window that ends there."""
    order = np.lexsort((hits, values))
    hits, values = hits[order], values[order]
    again = np.append(np.where(values[1:] == values[:-1], hits[1:] - 1, np.iinfo(np.int64).max), np.iinfo(np.int64).max) if len(hits) else hits
    ends = np.minimum(hits + width, again)
    return np.searchsorted(np.sort(hits), now, side="right") - np.searchsorted(np.sort(ends), now)


class Patterns:
    """Event-pattern alerts; spec: (name, window, least, severity, distinct, needs) with columns candidate_<i> and value_<i>.

    The state of a key: a list of hits (ts, n, value) for each pattern, and when each last fired.
    """

    def __init__(self, spec, order, quiet):
        self.spec, self.order, self.quiet = spec, order, quiet
        self.first = (((),) * len(spec), {})

    def _counts(self, i, rows, ts, held):
        """Counts at every row, and the hits that can still matter."""
        _, width, _, _, distinct, _ = self.spec[i]
        new = rows[f"candidate_{i}"].astype(bool)
        if not new.any() and not held:
            return np.zeros(len(ts), np.int64), ()
        if distinct:
            value = rows[f"value_{i}"].astype(object)
            new &= np.array([v is not None and v == v for v in value], bool)
            latest = dict(zip(value[new].tolist(), ts[new].tolist()))
            fresh = [(t, 1, v) for v, t in latest.items()]
            values, codes = np.unique(np.array([h[2] for h in held] + value[new].tolist(), dtype=object).astype(str), return_inverse=True)
            counted = distinct_in_window(ts, np.concatenate([np.array([h[0] for h in held], np.int64), ts[new]]), codes, width)
        else:
            at, n = np.unique(ts[new], return_counts=True)
            fresh = [(t, m, None) for t, m in zip(at.tolist(), n.tolist())]
            hits, counts = np.array([h[0] for h in held] + at.tolist(), np.int64), np.array([h[1] for h in held] + n.tolist(), np.int64)
            by_time = np.argsort(hits, kind="stable")
            counted = in_window(ts, hits[by_time], counts[by_time], width)
        oldest = int(ts[-1]) - width
        replaced = {v for _, _, v in fresh} if distinct else ()
        kept = [h for h in held if h[0] >= oldest and not (distinct and h[2] in replaced)]
        return counted, kept + [h for h in fresh if h[0] >= oldest]

    def step(self, state, key, rows):
        ts = rows["ts_us"].astype(np.int64)
        held, before = state
        found, last = {}, dict(before)
        place = {i: n for n, i in enumerate(self.order)}
        index = {s[0]: i for i, s in enumerate(self.spec)}
        out = []
        counts, hits = zip(*[self._counts(i, rows, ts, held[i]) for i in range(len(self.spec))])
        for i in self.order:
            name, width, least, severity, _, needs = self.spec[i]
            ready = counts[i] >= least
            for need in needs:
                j = index.get(need)
                if j is None or (place[j] >= place[i] and j not in before):
                    ready &= False
                    continue
                at = np.array([-1] + found.get(j, []))
                when = np.array([before.get(j, -(1 << 60))] + ts[found.get(j, [])].tolist(), np.int64)
                ready &= ts - when[np.searchsorted(at, np.arange(len(ts)), side="right") - 1] <= width
            until = before[i] + self.quiet if i in before else None
            found[i], _ = fires(ts, np.flatnonzero(ready), until, self.quiet)
            if found[i]:
                last[i] = int(ts[found[i][-1]])
            out += [(r, place[i], name, int(counts[i][r]), severity) for r in found[i]]
        out.sort(key=lambda x: x[:2])
        return (hits, last), [x[0] for x in out], dict(zip(("pattern_name", "matched_count", "severity"), list(zip(*out))[2:]))


class Flood:
    """Flags of a rate over a window: one detection, then ongoing rows until the quiet time has passed.

    The state of a key: its recent hits (ts, n) and the end of the quiet time.
    """

    first = ((), None)

    def __init__(self, window, quiet, need):
        self.window, self.quiet, self.need = window, quiet, need

    def step(self, state, key, rows):
        ts = rows["ts_us"].astype(np.int64)
        held, until = state
        hits = np.array([h[0] for h in held], np.int64)
        counts = np.array([h[1] for h in held], np.int64)
        out, at = [], 0
        while at < len(ts):
            if until is not None:
                stop = max(at, int(np.searchsorted(ts, until)))
                out += [(r, "dos_flood_ongoing") for r in range(at, stop)]
                at, until = stop, until if stop == len(ts) else None
                continue
            rest = ts[at:]
            total = np.concatenate([[0], np.cumsum(counts)])
            own = np.arange(1, len(rest) + 1) - np.searchsorted(rest, rest - self.window)
            recent = own + total[-1] - total[np.searchsorted(hits, rest - self.window)]
            hit = np.flatnonzero(recent >= self.need)
            stop = at + int(hit[0]) + 1 if len(hit) else len(ts)
            now, n = np.unique(ts[at:stop], return_counts=True)
            hits, counts = np.append(hits, now), np.append(counts, n)
            if len(hit):
                out.append((stop - 1, "dos_flood_detected"))
                until = int(ts[stop - 1]) + self.quiet
            at = stop
        live = hits >= ts[-1] - self.window
        state = list(zip(hits[live].tolist(), counts[live].tolist())), until
        return state, [r for r, _ in out], {"flag": [flag for _, flag in out]}


class Profile(StatefulProcessor):
    """Slopes and accumulated fluctuation of a node's ticks, from its last counts and two numbers."""

    def __init__(self, key, cfg, names):
        self.key, self.cfg, self.names = key, cfg, names

    def init(self, handle):
        self.state = handle.getValueState("profile", "counts array<double>, n long, slope double, total double, latched long")

    def handleInputRows(self, key, rows, timerValues):
        cfg = self.cfg
        frame = pd.concat(list(rows)).sort_values("tick", kind="stable")
        if self.state.exists():
            counts, n, slope, total, latched = self.state.get()
            counts = list(counts)
        else:
            counts, n, slope, total, latched = [], 0, None, 0.0, None
        out = []
        for tick, count in zip(frame["tick"].tolist(), frame["packet_count"].tolist()):
            counts, n = [*counts[-(cfg.amof_history - 1):], float(count)], n + 1
            x = np.arange(len(counts)) - (len(counts) - 1) / 2
            now = float((x * counts).sum() / (x * x).sum()) if len(counts) > 1 else 0.0
            if len(counts) < cfg.amof_min_points:
                continue
            total += abs(now - slope) if slope is not None else 0.0
            slope = now
            if total >= cfg.amof_threshold:
                latched = tick if latched is None else latched
            else:
                total *= cfg.amof_decay
            if latched is not None:
                out.append((*key, tick, now, latched))
        self.state.update((counts, n, slope, total, latched))
        yield pd.DataFrame(out, columns=self.names)

    def close(self):
        pass


def profiled(ticks: DataFrame, key: str = "source_ip", cfg=DEFAULTS) -> DataFrame:
    """(key, tick, slope, first_anomalous_tick) of the anomalous ticks in a stream of closed ticks (key, tick, packet_count).

    Chained behind the windowed count: a node's state is its last `amof_history` counts, and ticks of a node must close in
    order, which the watermark sees to.
    """
    fields = T.StructType([ticks.schema[key], *T._parse_datatype_string("tick long, slope double, first_anomalous_tick long").fields])
    return with_state(ticks, [key], Profile(key, cfg, fields.names), fields, "None")


def flood_processor(cfg):
    return Flood(micros(cfg.flood_window_s), micros(cfg.flood_cooldown_s), cfg.flood_rate * cfg.flood_window_s - 1e-9)
