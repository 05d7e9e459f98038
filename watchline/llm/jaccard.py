"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the groups that its links connect.

A document's set holds the hashes of its distinct 5-word shingles (A-Z lower-cased; a shorter text is one shingle). Two
sets link when 100 * |intersection| >= 80 * |union|. Equal sets are one set with several documents, so copies cost one row.

Blocks. Linked sets share one of the first n - ceil(0.8 n) + 1 shingles of each under any common order. The order here
puts a fixed quarter of the hash space first, by rising document frequency inside it, then the rest by hash, and very
frequent shingles (a bounded list, counted over all documents) last. So only that quarter is shuffled, frequencies in it
are exact, and shared passages hardly ever reach a prefix. Sets that share a prefix shingle are connected into blocks;
every linked pair lies within one block. A large table chains most of them into one, so a block of more than PIECE shingles
is cut by its prefix shingles: each gets a label, near copies mostly the same one, and a set goes where its labels go, so a
linked pair meets under the label of a shingle that both have. What is still too large is cut into pieces by hash and every
pair of pieces meets, so a task holds at most about 2 * PIECE shingles. Texts are shuffled, half as large as their shingles.

Search. Inside a block, sets are looked up one by one in inverted lists: with T = required overlap, the L longest of the
query's lists are put aside, the others are merged on a heap (by counting where they are long), and candidates with T - L or
more occurrences are counted on by binary probes of the long lists (DivideSkip). Lists hold leaders only: a set within Jaccard distance 0.05 of a leader
joins it and is not indexed, searches go to distance 0.25, and by the triangle inequality a set linked to such a
follower finds its leader; followers are compared one by one where the leader itself is not linked. No link is lost and
a group of near copies costs about one lookup each instead of a comparison of every pair.

Edge cases: null and empty texts and texts without words have no shingles, link with nothing and are their own group;
rows that share a doc_id are linked by their own texts; a null doc_id joins groups but names none unless all its members
are null; ties go to the smaller doc_id; empty tables give empty results; other columns are ignored by `groups`.
"""

from array import array
from bisect import bisect_left
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..ship import ship
from .decontaminate import bloom, may_contain
from .graph import components
from .tables import join_small, partitions, same_row, stored, text_key
from .words import hash_words, record_batch, signed, slices, window_hashes, word_ids

SHINGLE = 5
LINK, NEAR, REACH = 80, 95, 75  # per cent of the union: linked; followers of a leader; searched (LINK - (100 - NEAR))
QUARTER = np.uint64(1 << 62)  # hashes below are ordered first
HOT_SHARE, HOT_LIMIT = 0.01, 65_536  # very frequent shingles: share of a task's documents; length of the list
ROWS, PIECE = 1_500_000, 2_000_000  # rows of a task; shingles of a piece of a block
HEAP = 512  # entries of short lists that a heap merges; more are merged by counting
FEW = 8  # candidates probed one by one
ROUNDS = 2  # how often labels of prefix shingles spread through the sets of a block that is too large
SKIP = 0.0085  # weight of the longest list in the number of lists put aside


def shingle_sets(texts: pa.Array):
    """Yield the sorted distinct shingle hashes of each text."""
    ids, ends, words = word_ids(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = hash_words(words)[ids]
    wide = window_hashes(hashes, SHINGLE)
    start = 0
    for end in ends:
        if end - start >= SHINGLE:
            s = np.sort(wide[start:end - SHINGLE + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            yield window_hashes(hashes[start:end], end - start) if end > start else hashes[:0]
        start = end


def _names(s):
    """The set's 128-bit name as two signed longs."""
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return np.frombuffer(digest, np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text")


def named_sets(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """Per document a row (hot 0, doc_id, n, k, k2), and rows (hot 1, n, k) counting a task's most frequent shingles.

    `keyed` adds the text's key.
    """
    extra = [("key", pa.string())] if keyed else []
    schema = pa.schema([("hot", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("k2", pa.int64()), *extra])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text")))
                names = [_names(s) if len(s) else (None, None) for s in sets]
                yield record_batch(schema, [np.zeros(len(sets), np.int32), part.column("doc_id"), [len(s) for s in sets],
                                            [a for a, _ in names], [b for _, b in names],
                                            *[part.column(c) for c, _ in extra]])
                if len(sets) >= 50:
                    every = np.sort(np.concatenate(sets))
                    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else []
                    times = np.diff(np.append(first, len(every)))
                    often = times >= max(8, HOT_SHARE * len(sets))
                    if often.any():
                        token = signed(every[first[often]])
                        yield record_batch(schema, [np.ones(len(token), np.int32), pa.nulls(len(token), pa.int64()),
                                                    times[often], token, pa.nulls(len(token), pa.int64()),
                                                    *[pa.nulls(len(token), t) for _, t in extra]])

    texts = _texts(docs).select("*", *[text_key().alias(c) for c, _ in extra])
    return texts.mapInArrow(run, "hot int, doc_id long, n long, k long, k2 long" + ", key string" * keyed)


def _prefix_length(n):
    return n - (LINK * n + 99) // 100 + 1


def order_rows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(token, k, n, first): all shingles of the first part of the order, and more where a prefix reaches further."""
    schema = pa.schema([("token", pa.int64()), ("k", pa.int64()), ("m", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                tokens, keys, sizes, seen = [], [], [], set()
                for s in shingle_sets(part.column("text")):
                    if not len(s):
                        continue
                    k = _names(s)
                    if tuple(k) in seen:
                        continue
                    seen.add(tuple(k))
                    frequent = np.isin(s, hot, assume_unique=True) if len(hot) else np.zeros(len(s), bool)
                    first = s[(s < QUARTER) & ~frequent]
                    lacking = _prefix_length(len(s)) - len(first)
                    if lacking > 0:
                        rest = np.concatenate([s[(s >= QUARTER) & ~frequent], s[frequent]])[:lacking]
                        tokens.append(np.concatenate([first, rest]))
                    else:
                        tokens.append(first)
                    keys.append(k[0])
                    sizes.append(len(s) << 32 | len(first))
                if tokens:
                    times = [len(t) for t in tokens]
                    yield record_batch(schema, [signed(np.concatenate(tokens)), np.repeat(np.array(keys, np.int64), times),
                                                np.repeat(np.array(sizes, np.int64), times)])

    return _texts(docs).mapInArrow(run, "token long, k long, m long")


def _whole(batches):
    """All columns of a task's rows."""
    batches = list(batches)
    return [c.to_numpy() for c in pa.Table.from_batches(batches).columns] if batches else None


def shared_rows(rows: DataFrame, tasks: int) -> DataFrame:
    """Add df, the number of sets with a shingle; shingles of one set go."""
    schema = pa.schema([("token", pa.int64()), ("k", pa.int64()), ("m", pa.int64()), ("df", pa.int64())])

    def run(batches):
        if (columns := _whole(batches)) is None:
            return
        token, k, m = columns
        at = np.lexsort((k, token))
        token, k, m = token[at], k[at], m[at]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (k[1:] != k[:-1])])
        token, k, m = token[new], k[new], m[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        times = np.diff(np.append(first, len(token)))
        df = np.repeat(times, times)
        more = df > 1
        yield record_batch(schema, [token[more], k[more], m[more], df[more]])

    return rows.repartition(tasks, "token").mapInArrow(run, "token long, k long, m long, df long")


def prefix_rows(shared: DataFrame, hot: np.ndarray, tasks: int) -> DataFrame:
    """(token, k): the shared shingles in each set's prefix."""
    schema = pa.schema([("token", pa.int64()), ("k", pa.int64())])

    def run(batches):
        if (columns := _whole(batches)) is None:
            return
        token, k, m, df = columns
        value = token.view(np.uint64)
        first = (value < QUARTER) & ~np.isin(value, hot)
        at = np.lexsort((value, df, ~first, k))
        token, k, m, first = token[at], k[at], m[at], first[at]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        length = np.diff(np.append(head, len(k)))
        place = np.arange(len(k)) - np.repeat(head, length)
        here = np.repeat(np.add.reduceat(first, head, dtype=np.int64), length) if len(k) else place
        alone = (m & 0xFFFFFFFF) - here  # shingles of no other set stand before the shared ones
        keep = ~first | (alone + place < _prefix_length(m >> 32))
        yield record_batch(schema, [token[keep], k[keep]])

    return shared.repartition(tasks, "k").mapInArrow(run, "token long, k long")


def block_edges(prefixes: DataFrame, tasks: int) -> DataFrame:
    """(a, b): every set with the smallest one that this task's shingles connect it to, over prefixes they share."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        if (columns := _whole(batches)) is None or not len(columns[0]):
            return
        token, k = columns
        at = np.lexsort((k, token))
        token, k = token[at], k[at]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        leader = np.repeat(k[head], np.diff(np.append(head, len(k))))
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for a, b in np.unique(np.stack([leader, k])[:, leader != k], axis=1).T.tolist():
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        pairs = [(r, x) for x in up if (r := root(x)) != x]
        if pairs:
            yield record_batch(schema, [list(c) for c in zip(*pairs)])

    return prefixes.repartition(tasks, "token").mapInArrow(run, "a long, b long")


def placements(inside: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(k, n, places of (block, pieces)): where each set is searched, and into how many pieces that block is cut."""
    def cut(rows):
        weight = rows.groupBy(F.col("block").alias("_b")).agg(F.ceil(F.sum("n") / PIECE).alias("pieces"))
        return rows.join(weight, F.col("block") == F.col("_b")).select("k", "n", "block", "pieces")

    whole = stored(cut(inside.select("k", "n", "block").distinct()), "placed")
    wide = whole.where("pieces > 1").select(F.col("k").alias("_k"), "n")
    if not wide.isEmpty():
        held = prefixes.join(wide, F.col("k") == F.col("_k")).select("token", "k", "n")
        many = held.groupBy(F.col("token").alias("_t")).agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        held = stored(held.join(many, F.col("token") == F.col("_t")).select("token", "k", "n"), "held")
        labels = held.select("token", F.col("token").alias("block")).distinct()
        for _ in range(ROUNDS):  # a shingle takes the least label of the sets that hold it, a set the least of its shingles
            home = held.join(labels, "token").groupBy("k").agg(F.min("block").alias("block"))
            labels = stored(held.join(home, "k").groupBy("token").agg(F.min("block").alias("block")), "labels")
        parts = cut(held.join(labels, "token").select("k", "n", "block").distinct())
        whole = whole.where("pieces = 1").unionByName(parts)
    return whole.groupBy("k").agg(F.max("n").alias("n"), F.collect_set(F.struct("block", "pieces")).alias("places"))


def set_rows(docs: DataFrame, ids: np.ndarray) -> DataFrame:
    """(k, k2, text) of the documents whose doc_id may be among those of the filter `ids`, or is null."""
    schema = pa.schema([("k", pa.int64()), ("k2", pa.int64()), ("text", pa.string())])
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        for batch in batches:
            wanted = may_contain(shared.value, batch.column("h").to_numpy().view(np.uint64))
            wanted |= batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for part in slices(batch.filter(pa.array(wanted))):
                first = {}
                for at, s in enumerate(shingle_sets(part.column("text"))):
                    if len(s):
                        first.setdefault(tuple(_names(s).tolist()), at)
                if first:
                    yield record_batch(schema, [*zip(*first), part.column("text").take(pa.array(first.values()))])

    return _texts(docs).withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "k long, k2 long, text string")


def merged(lists, needed):
    """DivideSkip, first half: the leaders on enough of the short lists, their occurrences, and the long lists put aside."""
    lists = sorted(lists, key=len, reverse=True)
    aside = min(needed - 1, int(needed / (SKIP * log2(max(2, len(lists[0]))) + 1)))
    long, short = lists[:aside], lists[aside:]
    if sum(map(len, short)) <= HEAP:
        runs = [(leader, sum(1 for _ in run)) for leader, run in groupby(merge(*short))]
        leaders, times = np.array([r[0] for r in runs], np.int64), np.array([r[1] for r in runs], np.int64)
        enough = times >= needed - aside
        return leaders[enough], times[enough], long
    # Many entries: leaders are small numbers, so the runs are merged by counting.
    times = np.bincount(np.concatenate([np.frombuffer(x, np.int64) for x in short]))
    leaders = np.flatnonzero(times >= needed - aside)
    return leaders, times[leaders], long


def probed(leaders, times, long, needed):
    """DivideSkip, second half: occurrences of those leaders that reach `needed` with binary probes of the long lists."""
    if len(leaders) <= FEW:
        kept = []
        for leader, n in zip(leaders.tolist(), times.tolist()):
            left = len(long)
            for run in reversed(long):  # the shorter of the long ones first
                if n + left < needed:
                    break
                place = bisect_left(run, leader)
                n += place < len(run) and run[place] == leader
                left -= 1
            if n >= needed:
                kept.append((leader, n))
        return (np.array([k[i] for k in kept], np.int64) for i in (0, 1))
    if long and 8 * len(leaders) > len(long[0]):  # most of the lists' leaders are candidates: merging beats probing
        more = np.bincount(np.concatenate([np.frombuffer(x, np.int64) for x in long]), minlength=int(leaders[-1]) + 1)
        times, long = times + more[leaders], []
    for i in range(len(long) - 1, -1, -1):
        run = np.frombuffer(long[i], np.int64)
        times = times + (run.take(run.searchsorted(leaders), mode="clip") == leaders)
        if i % 8 == 0:
            reach = times + i >= needed
            leaders, times = leaders[reach], times[reach]
            if not len(leaders):
                break
    reach = times >= needed
    return leaders[reach], times[reach]


def linked(sets):
    """The root (smallest index) of each of the sorted arrays under the links among them."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]  # by size; a leader's number is its place, so lists grow in order
    size = np.array([len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(size)
    label, lists, followers = np.arange(len(sets)), {}, {}

    def join(a, b):
        low, high = sorted((label[a], label[b]))
        if low != high:
            label[label == high] = low

    for q in range(len(sets)):
        own = token[ends[q] - size[q]:ends[q]]
        own = own[count[own] > 1].tolist()  # the others belong to one set only
        here = [lists[t] for t in own if t in lists]
        needed, near = int(REACH * size[q] + 99) // 100, None
        if len(here) >= needed:
            leaders, times, long = merged(here, needed)
            best = times.argmax() if len(times) else 0
            for part in (slice(best, best + 1), slice(None)):
                # The likeliest leader first; after it, groups that the set has joined need no more looking at.
                other = label[leaders[part]] != label[q]
                found, both = probed(leaders[part][other], times[part][other], long, needed)
                union = size[q] + size[found] - both
                for leader, share in zip(found.tolist(), (100 * both / union).tolist()):
                    if share >= LINK:
                        join(q, leader)
                        near = leader if near is None and share >= NEAR else near
                    elif share >= REACH and label[leader] != label[q]:
                        for f in followers.get(leader, ()):
                            common = len(np.intersect1d(sets[q], sets[f], assume_unique=True))
                            if 100 * common >= LINK * (size[q] + size[f] - common):
                                join(q, f)
                                break
        if near is None:
            for t in own:
                lists.setdefault(t, array("q")).append(q)
        else:
            followers.setdefault(near, []).append(q)
    least = {}
    for i, x in enumerate(label.tolist()):
        least[x] = min(least.get(x, order[i]), order[i])
    out = [0] * len(sets)
    for i, x in enumerate(label.tolist()):
        out[order[i]] = least[x]
    return out


def block_links(rows: DataFrame, tasks: int) -> DataFrame:
    """Edges (a, b) between linked sets, named (k, k2); rows are (block, i, j, k, k2, text)."""
    schema = pa.schema([(c, pa.int64()) for c in ("ak", "ak2", "bk", "bk2")])

    def run(batches):
        blocks = {}
        for batch in batches:
            for part in slices(batch):
                rows = zip(*(part.column(c).to_pylist() for c in ("block", "i", "j", "k", "k2")), shingle_sets(part.column("text")))
                for b, i, j, k, k2, s in rows:
                    blocks.setdefault((b, i, j), {})[k, k2] = s
        for members in blocks.values():
            names = sorted(members)
            if len(names) > 1:
                roots = linked([members[n] for n in names])
                edges = [(*names[r], *names[x]) for x, r in enumerate(roots) if r != x]
                if edges:
                    yield record_batch(schema, [np.array(c, np.int64) for c in zip(*edges)])

    out = rows.repartition(tasks, "block", "i", "j").mapInArrow(run, "ak long, ak2 long, bk long, bk2 long")
    return out.select(F.struct(F.col("ak").alias("k"), F.col("ak2").alias("k2")).alias("a"),
                      F.struct(F.col("bk").alias("k"), F.col("bk2").alias("k2")).alias("b"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every document."""
    return placed(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def placed(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, n, least (doc_id of the group), group (a set of it, null without shingles) and, if `keyed`, the text's key."""
    spark = docs.sparkSession
    named = stored(named_sets(docs, keyed), "sets")
    often = named.where("hot = 1").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(HOT_LIMIT)
    hot = np.sort(np.array([r["k"] for r in often.collect()], np.int64).view(np.uint64))
    own = named.where("hot = 0").drop("hot")
    sets = own.where("n > 0").groupBy("k", "k2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    total, rows = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = partitions(spark, total // 4, ROWS)
    shared = shared_rows(order_rows(docs, hot), tasks)
    # Every task names each of its sets once, so the edges grow with the tasks: no more of them than the rows need.
    few = max(spark.sparkContext.defaultParallelism, -(-(total // 4) // ROWS))
    prefixes = stored(prefix_rows(shared, hot, tasks), "prefixes")
    edges = block_edges(prefixes, few)
    blocks = components(edges, 4 * rows)
    blocks = blocks.unionByName(blocks.select(F.col("root").alias("node"), "root").distinct())
    inside = stored(sets.join(blocks, F.col("k") == F.col("node")).select("k", "k2", "rep", "n", F.col("root").alias("block")),
                    "blocks", rows)
    moved = stored(placements(inside, prefixes), "moved", rows)
    ids = bloom(inside.where("rep is not null").select(F.xxhash64("rep").alias("seed")))
    # Joined before they are made distinct, so that one shuffle by name serves both.
    found = set_rows(docs, ids).withColumnRenamed("k", "_k").join(moved, F.col("_k") == F.col("k")).drop("_k").dropDuplicates(["k", "k2"])
    piece = F.pmod(F.xxhash64("k"), F.col("pieces"))
    meet = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda o: F.struct(
        F.least(o, F.col("piece")).alias("i"), F.greatest(o, F.col("piece")).alias("j"))))
    spread = found.select("k", "k2", "text", F.inline("places")).withColumn("piece", piece).withColumn("_m", meet).select(
        "block", "_m.i", "_m.j", "k", "k2", "text")
    sent = F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["pieces"])
    size = moved.agg(F.sum(F.col("n") * sent)).first()[0] or 0
    found_links = components(block_links(spread, partitions(spark, size, 2 * ROWS)), 4 * rows)
    root = found_links.select(F.col("node.k").alias("nk"), F.col("node.k2").alias("nk2"), "root")
    tree = inside.join(root, (F.col("k") == F.col("nk")) & (F.col("k2") == F.col("nk2")), "left").select(
        F.col("k").alias("gk"), F.col("k2").alias("gk2"), "rep", F.coalesce("root", F.struct("k", "k2")).alias("group"))
    low = tree.groupBy(F.col("group").alias("_g")).agg(F.min("rep").alias("low"))
    of_set = tree.join(low, F.col("group") == F.col("_g")).select("gk", "gk2", "low", "group")
    reps = sets.join(of_set, (F.col("k") == F.col("gk")) & (F.col("k2") == F.col("gk2")), "left").select(
        F.col("k").alias("sk"), F.col("k2").alias("sk2"), F.coalesce("low", "rep").alias("least"),
        F.coalesce("group", F.struct("k", "k2")).alias("group"))
    return own.join(reps, (F.col("k") == F.col("sk")) & (F.col("k2") == F.col("sk2")), "left")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    Rows are told apart by doc_id and text: equal ones become one, each other row stands for its own text, and rows without
    a doc_id come after those with one. Ties go to the smaller key of the text; rows without words are groups of their own.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    rows = stored(placed(docs, True).groupBy("doc_id", "key", "group").agg(F.count(F.lit(1)).alias("rows")), "rows")
    heads = rows.where("group is not null").groupBy(F.col("group").alias("_g")).agg(F.min(place).alias("head"))
    found = stored(rows.join(heads, F.col("group") == F.col("_g"), "left").select(
        "doc_id", "key", "rows", (F.col("head").isNull() | place.eqNullSafe(F.col("head"))).alias("heads")), "heads")

    def named(which):
        return found.where(which).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"))

    same = same_row("_d", "_k")
    left = join_small(docs, named("not heads"), same, "left_anti", 250_000)
    again = named("heads and rows > 1")
    once = join_small(left, again, same, "left_anti", 250_000)
    return once.unionByName(join_small(left, again, same, "left_semi", 250_000).dropDuplicates(["doc_id", "text"]))
