"""Trust scores when every event also pushes a penalty onto the neighbours of its source, exactly in event order.

An event moves the score of its source and clamps it to [0, 1]; if the score is below the initial one then, each neighbour loses a
share of the shortfall, at least down to 0. Pushes go no further. So a score depends on earlier events of its own and of its
neighbours, and events of different connected components never meet.

A component's events are cut into stretches of consecutive time slices. A stretch needs the scores of the nodes that it touches
(its sources and their neighbours) as they are when it begins; it is run as if they were the initial ones, all stretches at once,
and leaves the scores at its end. Then every touched node's entry is compared with what the stretch before it that touches the
node has left: stretches begun with a wrong score are rolled back and run again, the others stand. A round settles at least
one more stretch of every component, and usually nearly all, since scores that reach 0 or 1 forget where they came from. The
result is that of one loop over all events, whatever the stretches.

A task holds one stretch: its events, the scores it touches and the neighbours of its sources. A slice with too many events is cut
into finer ones, down to a microsecond, so a burst is no single task's work. A source with many neighbours does not visit them: it
logs its shortfalls, and a neighbour takes the ones it has not seen, in event order, before its score is next needed. Pushes only
lower a score, so one that has reached 0 skips what is left. Sums are made in the same order, so scores are the same doubles.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULTS
from ..ship import ship
from ..storage import checkpointed, written
from .graph import components
from .sliced import SLICE_US

EVENTS = 50_000
#: Sources with more neighbours log their pushes.
LOGGED = 32


def _weighted(edges: DataFrame, strategy: str, clusters: DataFrame, cfg) -> DataFrame:
    """(src, dst, weight) in both directions; clusters (ip, cluster_id) matter to the clustered strategy only."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src is not null and dst is not null").distinct()
    if strategy == "nbtd":
        return both.withColumn("weight", F.lit(cfg.trust_neighbour_weight))
    if strategy != "cntd":
        raise ValueError("strategy must be 'nbtd' or 'cntd'")
    if clusters is None:
        return both.withColumn("weight", F.lit(cfg.trust_outside_weight))
    a, b = (clusters.select(F.col("ip").alias(i), F.col("cluster_id").alias(c)) for i, c in (("src", "c"), ("dst", "e")))
    same = (F.coalesce("c", F.lit("")) != "") & (F.col("c") == F.col("e"))
    weight = F.when(same, cfg.trust_cluster_weight).otherwise(cfg.trust_outside_weight)
    return both.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", weight.alias("weight"))


def _pieces(events: DataFrame, size: int, slice_us: int):
    """(events with `low` and `width` of their piece of time, (root, low, width, n)): time slices, cut while they hold over `size` events."""
    events = events.withColumn("low", F.floor(F.col("ts_us") / slice_us) * slice_us).withColumn("width", F.lit(slice_us).cast("long"))
    while True:
        counts = checkpointed(events.groupBy("root", "low", "width").agg(F.count(F.lit(1)).alias("n")))
        large = counts.where((F.col("n") > size) & (F.col("width") > 1))  # at most a row for every `size` events
        if large.isEmpty():
            return events, counts
        narrow = F.greatest(F.floor(F.col("width") * size / (16 * F.col("n"))), F.lit(1))
        cut = large.select(F.col("root").alias("r"), F.col("low").alias("l"), F.col("width").alias("w"), narrow.alias("to"))
        events = events.join(F.broadcast(cut), (F.col("root") == F.col("r")) & (F.col("low") == F.col("l")) & (F.col("width") == F.col("w")), "left")
        events = events.withColumn("low", F.when(F.col("to").isNull(), F.col("low")).otherwise(
            F.col("low") + F.expr("(ts_us - low) div to") * F.col("to"))).withColumn("width", F.coalesce("to", "width")).drop("r", "l", "w", "to")


def _stretches(events: DataFrame, size: int, slice_us: int) -> DataFrame:
    """Events with `stretch`: whole pieces of time of a component, begun anew after about `size` events."""
    events, counts = _pieces(events, size, slice_us)
    before = F.sum("n").over(Window.partitionBy("root").orderBy("low")) - F.col("n")
    cut = counts.select(F.col("root").alias("r"), F.col("low").alias("l"), F.floor(before / size).alias("stretch"))
    return events.join(cut, (F.col("root") == F.col("r")) & (F.col("low") == F.col("l"))).drop("r", "l", "low", "width")


class _Scores:
    """Scores of a stretch's nodes and what its sources push onto their neighbours, in event order."""

    def __init__(self, score, pushes, initial, logged):
        """pushes: for each node its (neighbour, weight) pairs."""
        self.score, self.initial = score, initial
        self.near = [p if len(p) <= logged else None for p in pushes]
        self.log = [None if near is not None else [] for near in self.near]  # (event number, shortfall)
        self.heard = [[] for _ in score]  # [log, weight, entries seen] of the logging neighbours of each node
        for i, to in enumerate(pushes):
            if self.log[i] is not None:
                for j, weight in to:
                    self.heard[j].append([self.log[i], weight, 0])

    def settle(self, j):
        """Takes the logged pushes onto j that it has not seen."""
        x = self.score[j]
        waiting = [h for h in self.heard[j] if h[2] < len(h[0])]
        if x > 0 and waiting:
            for _, low in self._merged(waiting):
                x -= low
                if x <= 0:
                    x = 0.0
                    break
            self.score[j] = x
        for h in waiting:
            h[2] = len(h[0])

    @staticmethod
    def _merged(waiting):
        def entries(log, weight, seen):
            for k in range(seen, len(log)):
                yield log[k][0], log[k][1] * weight

        if len(waiting) == 1:
            return entries(*waiting[0])
        return heapq.merge(*[entries(*h) for h in waiting], key=lambda e: e[0])

    def event(self, number, i, move):
        """The score of source i after its event."""
        score = self.score
        if self.heard[i]:
            self.settle(i)
        x = score[i] = min(1.0, max(0.0, score[i] + move))
        if x < self.initial:
            short = self.initial - x
            if self.near[i] is None:
                self.log[i].append((number, short))
                return x
            for j, weight in self.near[i]:
                if score[j] > 0:
                    if self.heard[j]:
                        self.settle(j)
                    score[j] = max(0.0, score[j] - short * weight)
        return x


def _fold(initial: float, trace: bool):
    """Runs the events of one stretch; rows of kind 0 are scores at its start, 1 neighbours, 2 events."""
    found = [("root", pa.string()), ("stretch", pa.int64()), ("ip", pa.string())]
    schema = pa.schema(found + ([("event_id", pa.int64()), ("ts_us", pa.int64()), ("score", pa.float64())] if trace else
                                [("entry", pa.float64()), ("exit", pa.float64())]))
    logged = LOGGED

    def run(table):
        kind = table.column("kind").to_numpy()
        part = [table.filter(pa.array(kind == k)) for k in range(3)]
        ips = part[0].column("ip").to_pylist()
        index = {ip: i for i, ip in enumerate(ips)}
        entry = part[0].column("x").to_numpy()
        near = [[] for _ in ips]
        for src, dst, weight in zip(*(part[1].column(c).to_pylist() for c in ("ip", "other", "x"))):
            near[index[src]].append((index[dst], weight))
        scores = _Scores(entry.tolist(), near, initial, logged)
        ts, ids = part[2].column("ts_us").to_numpy(), part[2].column("event_id").to_numpy()
        order = np.lexsort((ids, ts))
        source = np.array([index[ip] for ip in part[2].column("ip").to_pylist()], np.int64)[order]
        moves = part[2].column("x").to_numpy()[order].tolist()
        path = [scores.event(n, i, move) for n, (i, move) in enumerate(zip(source.tolist(), moves))]
        for j in range(len(ips)):
            scores.settle(j)
        n = len(path) if trace else len(ips)
        key = [pa.array([table.column("root")[0].as_py()] * n, pa.string()), pa.array([table.column("stretch")[0].as_py()] * n, pa.int64())]
        if trace:
            return pa.Table.from_arrays([*key, part[2].column("ip").take(pa.array(order)).combine_chunks(), pa.array(ids[order]),
                                         pa.array(ts[order]), pa.array(path, pa.float64())], schema=schema)
        return pa.Table.from_arrays([*key, pa.array(ips, pa.string()), pa.array(entry), pa.array(scores.score, pa.float64())], schema=schema)

    ddl = "root string, stretch long, ip string, " + ("event_id long, ts_us long, score double" if trace else "entry double, exit double")
    return run, ddl


def _run(events, near, entries, initial, trace=False):
    none = F.lit(None)
    rows = entries.select("root", "stretch", F.lit(0).alias("kind"), "ip", none.cast("string").alias("other"),
                          F.col("want").alias("x"), none.cast("long").alias("ts_us"), none.cast("long").alias("event_id"))
    rows = rows.union(near.select("root", "stretch", F.lit(1), "src", "dst", "weight", none.cast("long"), none.cast("long")))
    rows = rows.union(events.select("root", "stretch", F.lit(2), "ip", none.cast("string"), "move", "ts_us", "event_id"))
    run, ddl = _fold(initial, trace)
    return rows.groupBy("root", "stretch").applyInArrow(run, ddl)


def _settled(detections, edges, strategy, clusters, cfg, events_each, slice_us):
    """(events, neighbours, states): the stored inputs and the entry and exit of every touched node of every stretch."""
    ship(detections.sparkSession)
    label = F.col("predicted_label")
    move = F.when(label == "malicious", cfg.trust_malicious).when(label == "suspicious", cfg.trust_suspicious).otherwise(cfg.trust_benign)
    moves = detections.where("source_ip is not null").select(F.col("source_ip").alias("ip"), "ts_us", "event_id", move.alias("move"))
    weighted = written(_weighted(edges, strategy, clusters, cfg), "neighbours")
    roots = components(weighted).withColumnRenamed("node", "ip")
    events = moves.join(roots, "ip", "left").withColumn("root", F.coalesce("root", "ip"))
    events = written(_stretches(events, events_each, slice_us), "stretches")
    active = events.select("root", "stretch", F.col("ip").alias("src")).distinct()
    near = written(active.join(weighted, "src"), "active")
    touched = written(active.withColumnRenamed("src", "ip").union(near.select("root", "stretch", "dst")).distinct(), "touched")
    initial = F.lit(cfg.trust_initial)
    states = written(_run(events, near, touched.withColumn("want", initial), cfg.trust_initial), "states")
    order = Window.partitionBy("ip").orderBy("stretch")  # a row for each stretch that touches the node
    while True:
        wanted = states.withColumn("want", F.coalesce(F.lag("exit").over(order), initial))
        wrong = checkpointed(wanted.where("want <> entry").select("root", "stretch").distinct())
        if wrong.isEmpty():
            return events, near, states, weighted
        key = ["root", "stretch"]
        again = _run(events.join(wrong, key, "left_semi"), near.join(wrong, key, "left_semi"),
                     wanted.join(wrong, key, "left_semi"), cfg.trust_initial)
        states = written(states.join(wrong, key, "left_anti").unionByName(again), "states")


def trust_with_neighbours(detections: DataFrame, edges: DataFrame, strategy: str = "nbtd", clusters: DataFrame = None, cfg=DEFAULTS,
                          events_each: int = EVENTS, slice_us: int = SLICE_US) -> DataFrame:
    """(ip, score) of all sources and all neighbours after the last event.

    detections(source_ip, ts_us, event_id, predicted_label); edges(src, dst) in any direction; `strategy` is 'nbtd' (one weight) or
    'cntd' (more inside a cluster). Scores are doubles, added in event order.
    """
    _, _, states, weighted = _settled(detections, edges, strategy, clusters, cfg, events_each, slice_us)
    last = states.groupBy("ip").agg(F.max_by("exit", "stretch").alias("score"))
    nodes = weighted.select(F.col("src").alias("ip")).union(last.select("ip")).distinct()
    return nodes.join(last, "ip", "left").select("ip", F.coalesce("score", F.lit(cfg.trust_initial)).alias("score"))


def trust_path_with_neighbours(detections: DataFrame, edges: DataFrame, strategy: str = "nbtd", clusters: DataFrame = None,
                               cfg=DEFAULTS, events_each: int = EVENTS, slice_us: int = SLICE_US) -> DataFrame:
    """(source_ip, event_id, ts_us, score): the score of the source after each of its events."""
    events, near, states, _ = _settled(detections, edges, strategy, clusters, cfg, events_each, slice_us)
    path = _run(events, near, states.withColumn("want", F.col("entry")), cfg.trust_initial, trace=True)
    return path.select(F.col("ip").alias("source_ip"), "event_id", "ts_us", "score")
