"""Protocol automata: flag messages that claim a transition the protocol does not allow."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import sliced
from ..ship import ship

# Allowed transitions per protocol.
DEFAULT_TRANSITIONS = (
    ("coap", "CON", "ACK"), ("coap", "CON", "RST"), ("coap", "NON", "TERMINAL"), ("coap", "ACK", "TERMINAL"),
    ("coap", "RST", "TERMINAL"),
    ("rpl", "DIS", "DIO"), ("rpl", "DIO", "DAO"), ("rpl", "DAO", "DAO_ACK"), ("rpl", "DAO_ACK", "TERMINAL"),
    ("rpl", "DIO", "TERMINAL"),
    ("tcp", "CLOSED", "SYN_SENT"), ("tcp", "SYN_SENT", "SYN_RCVD"), ("tcp", "SYN_RCVD", "ESTABLISHED"),
    ("tcp", "ESTABLISHED", "FIN_WAIT"), ("tcp", "FIN_WAIT", "CLOSED"),
)
# Entry states a slice is tried with besides the protocol's own: nothing seen yet, and any state no edge leaves.
UNSEEN, _STUCK = "", "\x01"
#: Messages worked on at once: a message takes a few hundred bytes then, and a batch may hold thousands of slices.
MESSAGES = 50_000


def edge_table(transitions) -> dict:
    table: dict = {}
    for proto, a, b in transitions:
        table.setdefault(proto.lower(), set()).add((a.upper(), b.upper()))
    return table


def bounded(lengths, most: int = MESSAGES):
    """(first, end) of the runs of slices that hold at most `most` messages together; a larger slice is a run of its own."""
    first, held = 0, 0
    for at, n in enumerate(lengths.tolist()):
        if at > first and held + n > most:
            yield first, at
            first, held = at, 0
        held += n
    yield first, len(lengths)


def follow(state, cur, nxt, allowed, reset_on_terminal=False):
    """(state after the message, state it was judged from or None when it is fine)"""
    if not nxt:
        return cur, None
    source = state or cur
    if allowed and (source, nxt) not in allowed:
        return state, source
    return (UNSEEN if reset_on_terminal and nxt == "TERMINAL" else nxt), None


class _Machine:
    """Automata of all protocols over integer states, run over many messages at once.

    A state is unseen, one that some edge leaves, or any other (from which nothing with edges is allowed). A message maps
    every state to the state after it; maps of a slice's messages are composed in steps of doubling length.
    """

    def __init__(self, edges, reset_on_terminal):
        self.edges, self.reset = edges, reset_on_terminal
        sources = sorted({a for pairs in edges.values() for a, _ in pairs} - {UNSEEN})
        self.states = [UNSEEN, *sources, _STUCK]
        self.number = {s: i for i, s in enumerate(self.states)}

    def flat(self, protocol, cur, nxt, lengths):
        proto = np.repeat(np.array(protocol.to_pylist(), object), lengths)
        return proto, *(np.array(x.flatten().to_pylist(), object) for x in (cur, nxt))

    def _map(self, key):
        """(state after, allowed) for every state, for one kind of message."""
        proto, cur, nxt = key
        allowed, after, fine = self.edges.get(proto, set()), [], []
        for i, state in enumerate(self.states):
            end, bad = follow(state, cur, nxt, allowed, self.reset)
            after.append(i if bad is not None else self.number.get(end or UNSEEN, len(self.states) - 1))
            fine.append(bad is None)
        return after, fine

    def _maps(self, proto, cur, nxt):
        kinds, kind = {}, np.empty(len(cur), np.int64)
        for i, key in enumerate(zip(proto, cur, nxt)):
            kind[i] = kinds.setdefault(key, len(kinds))
        made = [self._map(k) for k in kinds]
        width = len(self.states)
        return (np.array([m[0] for m in made], np.int64).reshape(-1, width)[kind],
                np.array([m[1] for m in made], bool).reshape(-1, width)[kind])

    def scan(self, proto, cur, nxt, lengths):
        """[messages, states]: the state after each message for every state its slice may be entered with."""
        after, _ = self._maps(proto, cur, nxt)
        place = np.arange(len(after)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        step = 1
        while step <= place.max(initial=0):
            at = np.flatnonzero(place >= step)
            after[at] = np.take_along_axis(after[at], after[at - step], axis=1)
            step *= 2
        return after

    def _sets(self, cur, nxt):
        """The state that each message sets when it is allowed."""
        out = np.where([bool(n) for n in nxt], nxt, cur)
        return np.where(nxt == "TERMINAL", UNSEEN, out) if self.reset else out

    def ends(self, proto, cur, nxt, lengths):
        """[slices, states]: the state after each slice (none is empty), or the entry state if no message was allowed."""
        if not len(cur):
            return np.zeros((0, len(self.states)), object)
        last, first = np.cumsum(lengths) - 1, np.cumsum(lengths) - lengths
        after = self.scan(proto, cur, nxt, lengths)
        before = np.concatenate([after[:1], after[:-1]])
        before[first] = np.arange(len(self.states))
        fine = np.take_along_axis(self._maps(proto, cur, nxt)[1], before, axis=1)
        setter = np.maximum.accumulate(np.where(fine, np.arange(len(cur))[:, None], -1))[last]
        return np.where(setter >= first[:, None], self._sets(cur, nxt)[setter], np.array(self.states, object))

    def judge(self, proto, cur, nxt, lengths, entry):
        """For each message the state it was refused from, or None."""
        if not len(cur):
            return []
        first = np.cumsum(lengths) - lengths
        start = np.repeat([self.number.get(e or UNSEEN, len(self.states) - 1) for e in entry], lengths)
        rows = np.arange(len(cur))
        ends = self.scan(proto, cur, nxt, lengths)[rows, start]
        before = np.concatenate([[0], ends[:-1]])
        full = lengths > 0
        before[first[full]] = start[first[full]]
        fine = self._maps(proto, cur, nxt)[1][rows, before]
        # The state's own name was set by the last allowed message of the slice, or came in with it.
        setter = np.where(fine, rows, -1)
        setter = np.concatenate([[-1], np.maximum.accumulate(setter)[:-1]])
        inside = setter >= np.repeat(first, lengths)
        state = np.where(inside, self._sets(cur, nxt)[setter], np.repeat(entry, lengths))
        return np.where(fine, None, np.where([bool(s) for s in state], state, cur))


def protocol_violations(messages: DataFrame, transitions=DEFAULT_TRANSITIONS, slice_us: int = sliced.SLICE_US,
                        reset_on_terminal: bool = False) -> DataFrame:
    """(source_ip, protocol, event_id, ts_us, from_state, to_state, message) for every disallowed transition.

    messages(source_ip, protocol, event_state, next_state or null, ts_us, event_id). A message without a next state
    sets the state; a disallowed one leaves it as it was; a protocol without edges allows everything.
    """
    ship(messages.sparkSession)
    edges = edge_table(transitions)

    machine = _Machine(edges, reset_on_terminal)

    def in_runs(work, cur, *columns):
        lengths = pc.list_value_length(cur).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.concat_arrays([work(lengths[a:b], *(c.slice(a, b - a) for c in columns)) for a, b in bounded(lengths)])

    def summarise(protocol: pa.Array, cur: pa.Array, nxt: pa.Array) -> pa.Array:
        return in_runs(summary, cur, protocol, cur, nxt)

    def summary(lengths, protocol, cur, nxt):
        proto, c, n = machine.flat(protocol, cur, nxt, lengths)
        ends, names = machine.ends(proto, c, n, lengths), machine.states
        rows = pa.StructArray.from_arrays([pa.array(names * len(lengths), pa.string()), pa.array(ends.ravel(), pa.string())],
                                          ["entry", "end"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1) * len(names), pa.int32()), rows)

    def entries(functions: pa.Array) -> pa.Array:
        out = []
        for key_functions in functions:  # one key's slices at a time
            state, seen = UNSEEN, []
            for f in key_functions.as_py():
                seen.append(state)
                ends = {e["entry"]: e["end"] for e in f}
                end = ends.get(state, ends[_STUCK])
                state = state if end == _STUCK else end
            out.append(seen)
        return pa.array(out, pa.list_(pa.string()))

    def judge(protocol: pa.Array, entry: pa.Array, cur: pa.Array, nxt: pa.Array) -> pa.Array:
        return in_runs(judged_run, cur, protocol, entry, cur, nxt)

    def judged_run(lengths, protocol, entry, cur, nxt):
        proto, c, n = machine.flat(protocol, cur, nxt, lengths)
        bad = machine.judge(proto, c, n, lengths, np.array(entry.to_pylist(), object))
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(bad, pa.string()))

    keys = ["source_ip", "protocol"]
    tidy = messages.select(
        "source_ip", F.lower("protocol").alias("protocol"), "ts_us", "event_id",
        F.upper("event_state").alias("cur"), F.upper("next_state").alias("nxt"))
    packed = sliced.pack(tidy, keys, ["cur", "nxt"], slice_us)
    f_type = "array<struct<entry:string,end:string>>"
    functions = packed.select(*keys, "slice", F.arrow_udf(summarise, f_type)(
        "protocol", "rows.cur", "rows.nxt").alias("f"))
    entry = sliced.walk(functions, keys, "f", F.arrow_udf(entries, "array<string>"))
    judged = packed.join(entry, keys + ["slice"]).select(*keys, F.explode(F.arrays_zip(
        "rows", F.arrow_udf(judge, "array<string>")("protocol", "entry", "rows.cur", "rows.nxt").alias("bad"))).alias("r"))
    text = F.format_string("Invalid %s transition %s → %s from %s", F.upper("protocol"), F.col("from_state"),
                           F.col("to_state"), F.col("source_ip"))
    return (judged.filter(F.col("r.bad").isNotNull())
            .select(*keys, "r.rows.event_id", "r.rows.ts_us", F.col("r.bad").alias("from_state"),
                    F.col("r.rows.nxt").alias("to_state"))
            .withColumn("message", text))
