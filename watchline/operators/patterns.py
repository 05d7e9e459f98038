"""Complex-event patterns over one source: thresholds in a sliding window, sequences, alert cooldown."""

from dataclasses import dataclass, field
from typing import Optional

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULTS, SECOND_US, micros
from ..functions import text as X
from ..storage import checkpointed
from .cooldown import first_per_window
from .sliding import Sliding, sliding_counts


@dataclass(frozen=True)
class Pattern:
    """A named threshold. `candidate` and `distinct` are columns over event fields (Python UDF columns work too);
    `requires` names patterns that must have alerted for the same source within this window, in any order; with `strict_order`
    they must have alerted one after the other in the order given, all before the event."""
    name: str
    candidate: Column = field(compare=False)
    window_s: float = 60.0
    min_count: int = 1
    severity: str = "high"
    description: str = ""
    distinct: Optional[Column] = field(default=None, compare=False)
    requires: tuple = ()
    strict_order: bool = False


def builtin_patterns() -> list:
    msg, service = F.col("message"), F.col("service")
    # Windows, thresholds, tiers and texts of the built-in patterns.
    return [
        Pattern("brute_force", X.is_failed_login(msg), 60.0, 5, "high",
                "5+ failed login attempts from the same IP within 60 seconds"),
        Pattern("port_scan", X.has_dst_port(msg), 10.0, 5, "high",
                "5+ distinct destination ports contacted within 10 seconds", distinct=X.dst_port(msg)),
        Pattern("lateral_movement", X.has_dst_ip(msg), 30.0, 4, "critical",
                "4+ distinct destination hosts contacted within 30 seconds", distinct=X.dst_host(msg)),
        Pattern("login_after_scan", X.is_successful_login(msg), 120.0, 1, "critical",
                "Successful login following a port scan from the same IP", requires=("port_scan",)),
        Pattern("data_exfil_burst", X.is_high_volume(service, msg), 5.0, 20, "high",
                "20+ high-volume TCP/UDP events within 5 seconds (possible data exfiltration)"),
    ]


class PatternSet:
    """Registered patterns; alerts() evaluates all of them over an event table."""

    def __init__(self, patterns=None, cfg=DEFAULTS):
        self.patterns = {p.name: p for p in (builtin_patterns() if patterns is None else patterns)}
        self.cfg = cfg

    def register(self, pattern: Pattern):
        self.patterns[pattern.name] = pattern
        return self

    def unregister(self, name: str):
        self.patterns.pop(name, None)
        return self

    def names(self) -> list:
        return list(self.patterns)

    def alerts(self, events: DataFrame, key: str = "source_ip") -> DataFrame:
        """(key, pattern_name, event_id, ts_us, matched_count, window_seconds, severity, description)"""
        done, out, waiting = {}, [], list(self.patterns.values())
        while waiting:
            # A requirement that is not registered never fires, nor does what needs it.
            ready = [p for p in waiting if all(r in done for r in p.requires)]
            if not ready:
                break
            waiting = [p for p in waiting if p not in ready]
            fired = self._stage(events, ready, done, key)
            if any(r in {p.name for p in ready} for w in waiting for r in w.requires):
                # Later patterns read these few alerts too; without a checkpoint the events would be scanned again.
                fired = checkpointed(fired)
            for p in ready:
                done[p.name] = fired.filter(F.col("pattern_name") == p.name)
            out.append(fired)
        if not out:
            raise ValueError("no pattern can be evaluated")
        alerts = out[0]
        for more in out[1:]:
            alerts = alerts.unionByName(more)
        names = F.col("pattern_name")
        pick = [F.lit(None), F.lit(None), F.lit(None)]
        for p in self.patterns.values():
            values = (F.lit(float(p.window_s)), F.lit(p.severity), F.lit(p.description))
            pick = [F.when(names == p.name, v).otherwise(rest) for v, rest in zip(values, pick)]
        return alerts.select(key, "pattern_name", "event_id", "ts_us", "matched_count",
                             pick[0].alias("window_seconds"), pick[1].alias("severity"), pick[2].alias("description"))

    def _stage(self, events, ready, done, key):
        specs, work = {}, events
        for p in ready:
            specs[p.name] = Sliding(p.candidate, micros(p.window_s), p.distinct)
            for r in () if p.strict_order else p.requires:
                flag = f"_fired_{r}"
                if flag not in work.columns:
                    work = work.join(done[r].select("event_id", F.lit(True).alias(flag)), "event_id", "left")
                specs[f"{p.name}~{r}"] = Sliding(F.col(flag), micros(p.window_s))
        counted = sliding_counts(work, specs, key)
        hits = []
        for p in ready:
            ok = F.col(f"`{p.name}`") >= p.min_count
            for r in () if p.strict_order else p.requires:
                ok = ok & (F.col(f"`{p.name}~{r}`") > 0)
            hits.append(F.when(ok, F.struct(F.lit(p.name).alias("pattern_name"),
                                            F.col(f"`{p.name}`").alias("matched_count"))))
        long = (counted.select(key, "event_id", "ts_us", F.explode(F.array(*hits)).alias("h"))
                .filter("h is not null").select(key, "event_id", "ts_us", "h.*"))
        for p in ready:
            if p.strict_order and p.requires:
                long = long.filter(F.col("pattern_name") != p.name).unionByName(
                    _after_chain(long.filter(F.col("pattern_name") == p.name), chains(p, done, key), micros(p.window_s), key))
        return first_per_window(long, [key, "pattern_name"], micros(self.cfg.pattern_cooldown_s),
                                inclusive=False, carry=("matched_count",))


def chains(pattern: Pattern, done: dict, key: str) -> DataFrame:
    """(key, start_us, end_us): alerts of the last required pattern with the latest start of a chain through all of them.

    Step i of a chain is an alert of requirement i after one of requirement i - 1. The latest start that has reached a step
    is a running maximum over the alerts of a source, which cooldowns keep few.
    """
    fires = None
    for i, name in enumerate(pattern.requires):
        part = done[name].select(key, "ts_us", F.lit(i).alias("step"))
        fires = part if fires is None else fires.unionByName(part)
    earlier = Window.partitionBy(key).orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -1)
    fires = fires.withColumn("reached", F.when(F.col("step") == 0, F.col("ts_us")))
    for i in range(1, len(pattern.requires)):
        best = F.max(F.when(F.col("step") == i - 1, F.col("reached"))).over(earlier)
        fires = fires.withColumn("best", best).withColumn(
            "reached", F.when(F.col("step") == i, F.col("best")).otherwise(F.col("reached"))).drop("best")
    return fires.filter((F.col("step") == len(pattern.requires) - 1) & F.col("reached").isNotNull()).select(
        key, F.col("reached").alias("start_us"), F.col("ts_us").alias("end_us"))


def _after_chain(hits: DataFrame, found: DataFrame, window: int, key: str) -> DataFrame:
    """Hits after a chain that began at most a window before them; they meet by source and time bucket."""
    first, last = F.floor(F.col("end_us") / window), F.floor((F.col("start_us") + window) / window)
    there = found.filter(F.col("end_us") - F.col("start_us") <= window).select(
        F.col(key).alias("_k"), "start_us", "end_us", F.explode(F.sequence(first, last)).alias("_b"))
    return hits.join(there, (F.col(key) == F.col("_k")) & (F.floor(F.col("ts_us") / window) == F.col("_b"))
                     & (F.col("ts_us") > F.col("end_us")) & (F.col("ts_us") - F.col("start_us") <= window), "left_semi")


def recent_matches(events: DataFrame, alerts: DataFrame, pattern: Pattern, k: int = 10,
                   key: str = "source_ip") -> DataFrame:
    """Each alert of one pattern with its last k candidate events as an array."""
    window = micros(pattern.window_s)
    bucket = max(window, 60 * SECOND_US)
    cand = events.filter(pattern.candidate).select(
        key, "event_id", "ts_us", "service", "hostname", "message",
        F.floor(F.col("ts_us") / bucket).alias("_b"))
    fired = (alerts.filter(F.col("pattern_name") == pattern.name)
             .select(F.col(key).alias("_k"), F.col("event_id").alias("alert_id"), F.col("ts_us").alias("alert_ts"))
             .withColumn("_ab", F.explode(F.array(
                 F.floor(F.col("alert_ts") / bucket) - 1, F.floor(F.col("alert_ts") / bucket)))))
    near = cand.join(fired, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_ab"))
                     & (F.col("ts_us") <= F.col("alert_ts")) & (F.col("ts_us") >= F.col("alert_ts") - window))
    newest = Window.partitionBy("alert_id").orderBy(F.col("ts_us").desc(), F.col("event_id").desc())
    # The rank filter is applied before the shuffle as well, so at most k rows per alert and task move.
    top = near.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= k)
    row = F.struct("ts_us", "event_id", "hostname", "service", "message")
    return top.groupBy("alert_id", F.col("_k").alias(key), "alert_ts").agg(
        F.sort_array(F.collect_list(row)).alias("matched_events"))


def pattern_window_stats(events: DataFrame, alerts: DataFrame, cfg=DEFAULTS, key: str = "source_ip") -> DataFrame:
    """Per source: its events (at most pattern_buffer, where that is set) and the last alert time of each pattern."""
    # least() skips a null limit
    buffered = events.groupBy(key).agg(
        F.least(F.count(F.lit(1)), F.lit(cfg.pattern_buffer).cast("long")).alias("buffered_events"))
    last = alerts.groupBy(key, "pattern_name").agg(F.max("ts_us").alias("last_us"))
    fired = last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        "pattern_name", F.round(F.col("last_us") / 1e6, 1))))).alias("fired_patterns"))
    return buffered.join(fired, key, "left")
