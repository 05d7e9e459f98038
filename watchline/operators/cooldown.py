"""Fire-then-stay-quiet scans per key, exact and split over time slices.

A key fires at the first row it may, then stays quiet until `fire + cooldown`. Dedup windows, alert
cooldowns and flood detection are all this scan; they differ in how many rows must be in the rate
window before a row may fire.

The state carried along a key is one number, the end of the quiet period. So a key need not be folded
in one task:
  1. every (key, slice) is summarised as a step function  quiet-until on entry -> quiet-until on exit;
  2. the small step functions of a key are chained, giving the entry state of every slice;
  3. every (key, slice) is replayed from its entry state.
Work per task is bounded by rows per slice, not by rows per key, and nothing is approximated.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..config import DEFAULTS, SECOND_US, micros
from ..ship import ship

FIRED, QUIET = 1, 2


class _Slices:
    """The rows of many (key, slice) groups as flat arrays, with the pointers a scan follows."""

    def __init__(self, batch, slice_us, cooldown, need, rate):
        times = batch.column(batch.schema.get_field_index("times"))
        offsets = times.offsets.to_numpy().astype(np.int64)
        self.ts = times.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
        self.first = offsets[:-1] - offsets[0]
        self.end = offsets[1:] - offsets[0]
        self.groups = len(self.first)
        self.start = batch.column(batch.schema.get_field_index("slice")).to_numpy(zero_copy_only=False) * slice_us
        self.group = np.repeat(np.arange(self.groups), self.end - self.first)
        # Lay the groups on one axis, far enough apart that no search leaves its group.
        self.stride = slice_us + 2 * rate + 2 * cooldown + 10
        self.cooldown, self.need, self.rate = cooldown, need, rate
        n = len(self.ts)
        own = self.ts - self.start[self.group]
        self.axis = own + self.group * self.stride
        self.own = own >= 0
        may_fire = self.own.copy()
        if need > 1:
            oldest = np.searchsorted(self.axis, self.axis - rate, "left")
            may_fire &= np.arange(n) - oldest + 1 >= need
        at = np.where(may_fire, np.arange(n), n)
        self.next_fire = np.append(np.minimum.accumulate(at[::-1])[::-1], n)

    def fire(self, lo, group):
        """Row that fires when rows from `lo` on count, or -1."""
        j = lo + (self.need - 1)
        inside = j < self.end[group]
        hit = self.next_fire[np.where(inside, j, len(self.ts))]
        return np.where(inside & (hit < self.end[group]), hit, -1)

    def resume(self, fired):
        """First row after the quiet period opened by row `fired`."""
        return np.searchsorted(self.axis, self.axis[fired] + self.cooldown, "left")


def _step_tables(slice_us, cooldown, need, rate):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            s = _Slices(batch, slice_us, cooldown, need, rate)
            # A quiet period opened earlier ends at most `cooldown` into the slice.
            reach = np.searchsorted(s.axis, np.arange(s.groups) * s.stride + cooldown, "right")
            upto = np.minimum(reach + 1, s.end)
            sizes = upto - s.first
            group = np.repeat(np.arange(s.groups), sizes)
            lo = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + s.first[group]
            entry = lo.copy()
            leave = np.full(len(lo), -1, dtype=np.int64)
            live = np.arange(len(lo))
            while len(live):
                hit = s.fire(lo[live], group[live])
                live, hit = live[hit >= 0], hit[hit >= 0]
                leave[live] = s.ts[hit] + cooldown
                lo[live] = s.resume(hit)
            last = np.ones(len(lo), dtype=bool)
            if len(lo) > 1:
                last[:-1] = (leave[1:] != leave[:-1]) | (group[1:] != group[:-1])
            counts = np.bincount(group[last], minlength=s.groups)
            offs = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("slice")),
                 pa.ListArray.from_arrays(offs, pa.array(s.ts[entry[last]], pa.int64())),
                 pa.ListArray.from_arrays(offs, pa.array(leave[last], pa.int64()))],
                names=["key", "slice", "upto", "leave"])
    return run


_NEVER = -2 ** 62


def _entry_states(slice_us, cooldown, rate):
    stride = slice_us + 2 * rate + 2 * cooldown + 10

    def run(steps: pa.Array) -> pa.Array:
        """Walk the step functions of all keys of a batch side by side, one slice per round."""
        lens = pc.list_value_length(steps).to_numpy(zero_copy_only=False).astype(np.int64)
        slices, upto, leave = steps.flatten().flatten()
        start = slices.to_numpy(zero_copy_only=False) * slice_us
        sizes = pc.list_value_length(upto).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(start)), sizes)
        axis = upto.flatten().to_numpy(zero_copy_only=False) - start[owner] + owner * stride
        exits = np.append(leave.flatten().to_numpy(zero_copy_only=False), -1)
        # Keys with most slices first, so the keys still walking are always a prefix.
        order = np.argsort(-lens, kind="stable")
        first = (np.cumsum(lens) - lens)[order]
        walking = len(lens) - np.searchsorted(np.sort(lens), np.arange(lens.max(initial=0)), "right")
        quiet = np.full(len(lens), _NEVER, dtype=np.int64)
        entry = np.full(len(start), _NEVER, dtype=np.int64)
        for j, m in enumerate(walking):
            at = first[:m] + j
            entry[at] = quiet[:m]
            own = np.clip(quiet[:m] - start[at], -rate - 1, slice_us + cooldown + 1)
            step = np.searchsorted(axis, own + at * stride, "left")
            left = exits[np.where(step < end[at], step, len(axis))]
            quiet[:m] = np.where(left >= 0, left, quiet[:m])
        offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(entry, pa.int64(), mask=entry == _NEVER))
    return F.arrow_udf(run, T.ArrayType(T.LongType()))


def _replay(slice_us, cooldown, need, rate, lists, marks_quiet):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            s = _Slices(batch, slice_us, cooldown, need, rate)
            quiet = batch.column(batch.schema.get_field_index("quiet_until"))
            known = ~np.asarray(quiet.is_null())
            until = quiet.fill_null(0).to_numpy(zero_copy_only=False)
            group = np.arange(s.groups)
            own = np.clip(until - s.start, -rate - 1, slice_us + cooldown + 1)
            lo = np.where(known, np.searchsorted(s.axis, own + group * s.stride, "left"), s.first)
            n = len(s.ts)
            mark = np.zeros(n, dtype=np.int8)
            edges = np.zeros(n + 1, dtype=np.int32)
            np.add.at(edges, s.first[known], 1)
            np.add.at(edges, lo[known], -1)
            while len(group):
                hit = s.fire(lo, group)
                group, hit = group[hit >= 0], hit[hit >= 0]
                mark[hit] = FIRED
                lo = s.resume(hit)
                np.add.at(edges, hit + 1, 1)
                np.add.at(edges, lo, -1)
            if marks_quiet:
                mark[(np.cumsum(edges[:-1]) > 0) & (mark == 0)] = QUIET
            rows = np.flatnonzero((mark > 0) & s.own)
            flat = []
            for name in lists:
                values = batch.column(batch.schema.get_field_index(name))
                offs = values.offsets.to_numpy()
                flat.append(pa.array(values.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]][rows], pa.int64()))
            owner = pa.array(s.group[rows])
            key = batch.column(batch.schema.get_field_index("key")).take(owner)
            yield pa.RecordBatch.from_arrays(
                [key, *flat, pa.array(s.ts[rows], pa.int64()), pa.array(mark[rows].astype(np.int32))],
                names=["key", *lists, "ts_us", "mark"])
    return run


def cooldown_scan(df: DataFrame, keys, cooldown_us: int, need: int = 1, rate_us: int = 0,
                  slice_us: int = None, marks_quiet: bool = False, carry=()) -> DataFrame:
    """Rows (keys, event_id, carry, ts_us, mark) that fire, and with marks_quiet those in a quiet period.

    `df` has event_id and ts_us; ties on ts_us are ordered by event_id. `carry` names non-null long
    columns taken along with each row.
    """
    ship(df.sparkSession)
    slice_us = slice_us or max(60 * SECOND_US, cooldown_us, rate_us)
    if rate_us > slice_us:
        raise ValueError("a slice must be at least as long as the rate window")
    lists = ["event_id", *carry]
    # One struct as the key: null fields compare equal, and every step below shares its hash partitioning.
    rows = df.select(F.struct(*keys).alias("key"), F.floor(F.col("ts_us") / slice_us).alias("slice"), *lists, "ts_us")
    if need > 1:
        # The rate window of a slice's first rows reaches back into the slice before.
        late = F.col("ts_us") >= (F.col("slice") + 1) * slice_us - rate_us
        rows = rows.withColumn("slice", F.explode(
            F.when(late, F.array("slice", F.col("slice") + 1)).otherwise(F.array("slice"))))
    rows = rows.repartition("key", "slice")
    row = F.struct(*lists)
    if need == 1:
        # Copies at one instant act as one row; both groupings reuse the partitioning above.
        first = F.min(row) if carry else F.min("event_id")
        rows = rows.groupBy("key", "slice", "ts_us").agg(first.alias("row"))
        row = F.col("row") if carry else F.struct(F.col("row").alias("event_id"))
    packed = (rows.groupBy("key", "slice")
              .agg(F.sort_array(F.collect_list(F.struct(F.col("ts_us"), row.alias("row")))).alias("rows"))
              .select("key", "slice", F.col("rows.ts_us").alias("times"),
                      *[F.col(f"rows.row.{c}").alias(c) for c in lists]))
    key_field, longs = packed.schema["key"], T.ArrayType(T.LongType())
    args = (slice_us, cooldown_us, need, rate_us)

    # Both passes read all of `packed`, so the shuffle under it is done once and reused.
    steps = packed.mapInArrow(
        _step_tables(*args),
        T.StructType([key_field, T.StructField("slice", T.LongType()), T.StructField("upto", longs),
                      T.StructField("leave", longs)]))
    per_key = (steps.groupBy("key")
               .agg(F.sort_array(F.collect_list(F.struct("slice", "upto", "leave"))).alias("steps"))
               .filter(F.size("steps") > 1))
    chain = _entry_states(slice_us, cooldown_us, rate_us)
    entries = (per_key.select("key", F.explode(F.arrays_zip(
        F.col("steps.slice").alias("slice"), chain("steps").alias("quiet_until"))).alias("e"))
        .select("key", "e.slice", "e.quiet_until").filter(F.col("quiet_until").isNotNull()))
    marked = packed.join(entries, ["key", "slice"], "left").mapInArrow(
        _replay(*args, lists, marks_quiet),
        T.StructType([key_field] + [T.StructField(c, T.LongType()) for c in lists]
                     + [T.StructField("ts_us", T.LongType()), T.StructField("mark", T.IntegerType())]))
    return marked.select("key.*", *lists, "ts_us", "mark")


def first_per_window(df: DataFrame, keys, window_us: int, inclusive: bool, slice_us: int = None,
                     carry=()) -> DataFrame:
    """Rows that open a window per key; later rows within it are dropped and do not extend it.

    inclusive: a row exactly window_us after the opener still belongs to it.
    """
    quiet = window_us + (1 if inclusive else 0)
    return cooldown_scan(df, keys, quiet, slice_us=slice_us, carry=carry).drop("mark")


def flood(events: DataFrame, key: str = "source_ip", cfg=DEFAULTS, slice_us: int = None) -> DataFrame:
    """Flood detection per source: dos_flood_detected, then dos_flood_ongoing until the cooldown ends."""
    window, quiet = micros(cfg.flood_window_s), micros(cfg.flood_cooldown_s)
    need = max(1, int(np.ceil(cfg.flood_rate * cfg.flood_window_s - 1e-9)))
    slice_us = slice_us or max(60 * SECOND_US, quiet, window)
    # A rate window lies in two neighbouring cells, so only slices next to two full enough cells matter.
    cells = (events.groupBy(key, F.floor(F.col("ts_us") / window).alias("cell"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")))
    pairs = (cells.withColumn("c", F.explode(F.array("cell", F.col("cell") + 1)))
             .groupBy(key, "c").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
             .filter(F.col("n") >= need))
    reach = F.sequence(F.floor(F.col("lo") / slice_us), F.floor((F.col("hi") + quiet) / slice_us))
    hot = pairs.select(F.col(key), F.explode(reach).alias("_slice")).distinct()
    kept = (events.select(key, "event_id", "ts_us").withColumn("_slice", F.floor(F.col("ts_us") / slice_us))
            .join(hot, [key, "_slice"], "left_semi").drop("_slice"))
    marked = cooldown_scan(kept, [key], quiet, need=need, rate_us=window, slice_us=slice_us, marks_quiet=True)
    flag = F.when(F.col("mark") == FIRED, "dos_flood_detected").otherwise("dos_flood_ongoing")
    return marked.select(key, "event_id", "ts_us", flag.alias("flag"))
