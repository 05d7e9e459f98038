"""Best-fit packing of token pieces into sequences by linear grouping.

A document is its ids and one closing id; only one longer than the capacity is cut, into full pieces and a last one that may
be shorter. Every piece of the capacity fills a sequence. The plan for the others needs only how many pieces have each length:

1. Long pieces (over a share of the capacity) are put in order and cut into groups of equal cardinality; each length is
   rounded up to the longest of its group, so only a few sizes are left.
2. The best mix of configurations (sizes that fit one sequence together) for these sizes is found by column generation:
   a linear programme over the configurations known, and a knapsack that prices new ones. Whole numbers of each are used.
3. Actual pieces take the places of their group's size, which leaves room; what rounding the numbers down has left over
   and all short pieces then go, longest first, where they fit best.

Few groups leave more room to the short pieces, many waste less on rounding, so several numbers are tried and the plan of
fewest sequences is kept. A plan is a list of runs: pieces of one length with consecutive ranks in consecutive sequences at one offset. Its size
depends on the capacity and not on the number of documents, so it is made on the driver and sent to all tasks. Ranks among
equal lengths come from counts per (length, part), where the number of parts follows the rows: a length that a third of all
pieces share is dealt over all of them. Ids stay out of the shuffle unless they are asked for.

Edge cases: null and empty texts are the closing id alone; a very long text is many pieces; a repeated row is packed again;
a null doc_id stays null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..ship import ship
from .tables import partitions, stored
from .tokens import tokenizer_path, word_tokens
from .words import record_batch, slices

CAPACITY, CLOSING = 4096, 1
#: (groups, share) tried in this order until a plan is within a NEAR-th of the least number possible; the best one counts.
TRIES = ((16, 8), (8, 8), (32, 8), (16, 4), (32, 3), (32, 2), (64, 8))
NEAR = 5000
ROWS_A_PART = 100_000


def configurations(sizes, demands, capacity, rounds=2000):
    """(patterns, amounts): how often to use which numbers of each size, from the linear programme of least sequences."""
    k = len(sizes)
    sizes, demands = np.asarray(sizes, np.int64), np.asarray(demands, float)
    basis = np.diag(capacity // sizes).astype(float)  # a column is a configuration
    amounts = demands / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        column, value = dearest(sizes, price, capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        up = step > 1e-9
        ratio = np.full(k, np.inf)
        ratio[up] = amounts[up] / step[up]
        out = int(ratio.argmin())
        theta = ratio[out]
        amounts = amounts - theta * step
        amounts[out] = theta
        basis[:, out] = column
    return basis.T.round().astype(np.int64), np.maximum(amounts, 0)


def dearest(sizes, price, capacity):
    """The configuration of highest total price that fits (numbers of each size) and that price."""
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(int(capacity // sizes.min())):
        pick = np.full(capacity + 1, -1)
        new = best.copy()
        for i, s in enumerate(sizes):
            better = best[:-s] + price[i]
            at = better > new[s:] + 1e-12
            new[s:][at] = better[at]
            pick[s:][at] = i
        picks.append(pick)
        if (pick < 0).all():
            break
        best = new
    column, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            column[pick[room]] += 1
            room -= sizes[pick[room]]
    return column, float(column @ price)


class Plan:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset of the first)."""

    def __init__(self, capacity):
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self.open, self.rooms = {}, []  # room -> [(first sequence, sequences)]; rooms in order

    def leave(self, room, first, n):
        if room and n:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first, n))

    def new(self, n):
        self.sequences += n
        return self.sequences - n

    def configured(self, pattern, n, queues):
        """n sequences of one configuration, each place of a group taken by the next pieces of its queue."""
        segments = [(self.new(n), n, 0)]
        for g in np.flatnonzero(pattern):
            for _ in range(pattern[g]):
                done = []
                for first, m, fill in segments:
                    while m and queues[g]:
                        length, rank, left = queues[g].pop()
                        took = min(m, left)
                        self.runs.append((length, rank, took, first, 1, fill))
                        done.append((first, took, fill + length))
                        first, m = first + took, m - took
                        if left > took:
                            queues[g].append((length, rank + took, left - took))
                    if m:
                        done.append((first, m, fill))
                segments = done
        for first, m, fill in segments:
            self.leave(self.capacity - fill, first, m)

    def best_fit(self, length, rank, n):
        """The tightest room first; equal pieces go on in the sequence they have begun, whose room is the tightest then."""
        while n:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                many = -(-n // (self.capacity // length))
                self.leave(self.capacity, self.new(many), many)
                at = bisect_left(self.rooms, length)
            room = self.rooms[at]
            first, m = self.open[room].pop()
            if not self.open[room]:
                del self.open[room], self.rooms[at]
            each = room // length
            full = min(m, n // each)
            if full:
                self.runs.append((length, rank, full * each, first, each, self.capacity - room))
                self.leave(room - each * length, first, full)
                first, m, rank, n = first + full, m - full, rank + full * each, n - full * each
            if m and n:
                self.runs.append((length, rank, n, first, n, self.capacity - room))
                self.leave(room - n * length, first, 1)
                first, m, n = first + 1, m - 1, 0
            self.leave(room, first, m)


def best_plan(counts, capacity=CAPACITY, tries=TRIES, near=NEAR):
    """The plan of fewest sequences among those tried."""
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    best = None
    for groups, share in tries:
        found = plan(counts, capacity, groups, share)
        if best is None or found[1] < best[1]:
            best = found
        if (best[1] - least) * near <= least:
            break
    return best


def plan(counts, capacity, groups, share):
    """The runs for counts[length] pieces of each length, sorted by (length, first rank), and the number of sequences."""
    p = Plan(capacity)
    if counts[capacity]:
        p.runs.append((capacity, 0, int(counts[capacity]), p.new(int(counts[capacity])), 1, 0))
    lengths = [x for x in range(capacity - 1, 0, -1) if counts[x]]
    long = [x for x in lengths if x * share > capacity]
    total = sum(int(counts[x]) for x in long)
    rest = []
    if total:
        each = -(-total // groups)
        cut, room = [[]], each
        for x in long:
            rank, left = 0, int(counts[x])
            while left:
                took = min(left, room)
                cut[-1].append((x, rank, took))
                rank, left, room = rank + took, left - took, room - took
                if not room:
                    cut.append([])
                    room = each
        of_size = {}
        for group in cut:
            if group:
                of_size.setdefault(group[0][0], []).extend(group)
        sizes = sorted(of_size, reverse=True)
        patterns, amounts = configurations(sizes, [sum(n for _, _, n in of_size[s]) for s in sizes], capacity)
        queues = [of_size[s][::-1] for s in sizes]
        whole = np.floor(amounts + 1e-6).astype(np.int64)
        left = np.array([sum(n for _, _, n in q) for q in queues]) - whole @ patterns
        for i in np.argsort(whole - amounts):  # one more of those cut most, while all its places can be taken
            if amounts[i] > whole[i] and (left >= patterns[i]).all():
                whole[i] += 1
                left -= patterns[i]
        for pattern, amount in zip(patterns, whole.tolist()):
            if amount:
                p.configured(pattern, amount, queues)
        rest = sorted((r for q in queues for r in q), key=lambda r: (-r[0], r[1]))
    for length, rank, n in rest:
        p.best_fit(length, rank, n)
    for x in lengths[len(long):]:
        p.best_fit(x, 0, int(counts[x]))
    return sorted(p.runs), p.sequences


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """row (a number of the piece), doc_id, piece, start, length, ids_crc32, and the ids if they are asked for."""
    ship(docs.sparkSession)
    names = ("row", "doc_id", "piece", "start", "length", "ids_crc32")
    fields = [(c, pa.int64()) for c in names] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                ids, ends = word_tokens(part.column("text"), path)
                n = part.num_rows
                ids = np.insert(ids, ends, CLOSING).astype("<u4")
                ends = ends + np.arange(1, n + 1)
                starts = np.concatenate([[0], ends[:-1]])
                many = -(-(ends - starts) // capacity)
                who = np.repeat(np.arange(n), many)
                piece = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                first = starts[who] + piece * capacity
                last = np.minimum(first + capacity, ends[who])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), last.tolist())]
                columns = [row + np.arange(len(who)), part.column("doc_id").take(pa.array(who)), piece, piece * capacity,
                           last - first, crc]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, ends[-1]), pa.int32()),
                                                            pa.array(ids.view(np.int32))))
                row += len(who)
                yield record_batch(schema, columns)

    ddl = ", ".join(f"{c} long" for c in names) + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def pack(docs: DataFrame, path: str = None, capacity: int = CAPACITY, tries=TRIES,
         with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and its ids if they are asked for."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path or tokenizer_path("word_bpe_49k.json"), capacity, with_ids), "pieces")
    parts = partitions(spark, cut.count(), ROWS_A_PART)
    cut = cut.withColumn("part", F.pmod(F.hash("row"), F.lit(parts)))
    found = stored(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[r.length] = r.n
    runs, _ = best_plan(counts, capacity, tries)
    table = np.array(runs, np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    before = found.select(F.col("length").alias("_length"), F.col("part").alias("_part"), (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("row"))
    ranked = cut.withColumn("nth", nth).join(before, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([(c, pa.int64()) for c in [*kept, "sequence_id", "offset"]] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def place(batches):
        runs = shared.value
        keys = (runs[:, 0] << 48) | runs[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            nth = rank - run[:, 1]
            columns = [batch.column(c) for c in kept] + [run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * length]
            yield record_batch(schema, columns + ([batch.column("ids")] if with_ids else []))

    ddl = ", ".join(f"{f.name} long" for f in list(schema)[:7]) + ", ids array<int>" * with_ids
    return ranked.select(*kept, "rank", *(["ids"] if with_ids else [])).mapInArrow(place, ddl)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and the pieces in it (doc_id, piece, offset, length) of pieces packed with their ids.

    A group is one sequence, so at most the capacity of ids.
    """
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id", F.flatten(F.transform("held", lambda x: x.ids)).alias("ids"),
        F.transform("held", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.offset.alias("offset"),
                                               x.length.alias("length"))).alias("pieces"))
