"""How the sources of a language differ in their words, counted again through minimal perfect hashes.

First pass: for every language, in how many of its documents each term occurs, exactly; terms in LEAST documents or more are
kept. They are dealt to shards of about SHARD terms, and a task builds the perfect hash of each shard (`perfect.py`), with the
terms stored in the order of their slots. Second pass: the shards are broadcast, as many at a time as BROADCAST bytes hold (more
vocabulary means more passes, not a larger broadcast); a task looks its distinct words up, verifies each with the stored
term, and adds occurrences to dense arrays of one slot for each term, one array for each group (lang, source) and shard. When these
arrays reach DENSE bytes they are sent on. So what is shuffled is whole numbers by (group, slot), summed before and after.

A group gives a kept term p = 1 + floor(SCALE * (count + ADD) / (N + ADD * V)), its language q the same way. `pairs` compares the
groups of a language with each other: every task holds one shard of terms for all groups of a language and sums the distances
of each pair of them. `terms` ranks the terms that a group uses more than its language. All arithmetic is on whole numbers.

Edge cases: null text, lang and source count as ''; groups without terms still give p, and without kept terms every distance
is 0; a repeated row is a document of its own; terms of one value are ranked by their bytes; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..ship import ship
from .perfect import PerfectHash
from .tables import stored
from .words import hash_words, record_batch, slices

LEAST, SCALE, ADD, TOP = 30, 1_000_000_000, 5, 50
SHARD = 4096
BROADCAST, DENSE, TABLE = 64 << 20, 64 << 20, 300_000


def split_terms(texts):
    """(terms, ends): the runs of ASCII letters and other non-ASCII characters, A-Z lower-cased, and the index after each text's last."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")
    values = lists.flatten()
    real = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    return values.filter(real), before[offsets[1:]]


def _coded(column):
    coded = pc.fill_null(column, "").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _terms(part):
    """(code of each occurrence's term, its document, terms) of a slice."""
    terms, ends = split_terms(part.column("text"))
    coded = terms.dictionary_encode()
    document = np.repeat(np.arange(part.num_rows), np.diff(ends, prepend=0))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), document, coded.dictionary


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, n: rows that hold a term, counted in each task."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def run(batches):
        kept = {}

        def send():
            for lang, of in kept.items():
                yield record_batch(schema, [pa.array([lang] * len(of)), pa.array(list(of)), np.fromiter(of.values(), np.int64)])
            kept.clear()

        held = 0
        for batch in batches:
            for part in slices(batch):
                term, document, words = _terms(part)
                lang, langs = _coded(part.column("lang"))
                once = np.unique(document * max(len(words), 1) + term)
                key, n = np.unique(lang[once // max(len(words), 1)] * max(len(words), 1) + once % max(len(words), 1), return_counts=True)
                words, langs = words.to_pylist(), langs.to_pylist()
                for k, m in zip(key.tolist(), n.tolist()):
                    of = kept.setdefault(langs[k // len(words)], {})
                    word = words[k % len(words)]
                    if word in of:
                        of[word] += m
                    else:
                        of[word] = m
                        held += 1
                if held > TABLE:
                    yield from send()
                    held = 0
        yield from send()

    return docs.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, term string, n long")


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term of the terms in at least `least` documents of their language."""
    return document_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def _shard_of(hashes, shards):
    return ((hashes >> np.uint64(17)) % shards).astype(np.int64)


def shards(kept: DataFrame, size: int = SHARD) -> DataFrame:
    """lang, shards (of this language), shard, terms in the order of their slots, bits and levels of the perfect hash, bytes."""
    of_lang = kept.groupBy(F.col("lang").alias("l")).agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("shards"))
    rows = kept.join(of_lang, F.col("lang") == F.col("l")).select("lang", "shards", "term")
    named = pa.schema([("lang", pa.string()), ("shards", pa.int64()), ("shard", pa.int64()), ("term", pa.string())])

    def deal(batches):
        for batch in batches:
            number = batch.column("shards")
            shard = _shard_of(hash_words(batch.column("term")), number.to_numpy(zero_copy_only=False).astype(np.uint64))
            yield record_batch(named, [batch.column("lang"), number, shard, batch.column("term")])

    dealt = rows.mapInArrow(deal, "lang string, shards long, shard long, term string")
    built = pa.schema([("lang", pa.string()), ("shards", pa.int64()), ("shard", pa.int64()), ("terms", pa.list_(pa.string())),
                       ("bits", pa.binary()), ("levels", pa.list_(pa.int64())), ("bytes", pa.int64())])

    def build(group):
        table = PerfectHash.build(group.column("term").combine_chunks())
        bits, levels = table.packed()
        n = len(bits) + 8 * len(table) + pc.sum(pc.binary_length(table.keys)).as_py()
        return pa.Table.from_arrays([
            *[group.column(c).slice(0, 1) for c in ("lang", "shards", "shard")],
            pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.keys), pa.array([bits], pa.binary()),
            pa.array([levels], pa.list_(pa.int64())), pa.array([n], pa.int64())], schema=built)

    return dealt.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shards long, shard long, terms array<string>, bits binary, levels array<long>, bytes long")


class Slots:
    """The shards of one language that a task holds, as one run of slots."""

    def __init__(self, held):
        self.shards = held[0].shards
        self.tables = {r.shard: PerfectHash.unpacked(pa.array(r.terms, pa.string()), bytes(r.bits), list(r.levels)) for r in held}
        sizes = [len(t) for t in self.tables.values()]
        self.n = sum(sizes)
        self.base = dict(zip(self.tables, (np.cumsum(sizes) - sizes).tolist()))
        self.shard = np.repeat(list(self.tables), sizes)
        self.slot = np.concatenate([np.arange(n) for n in sizes])

    def of(self, words, hashes):
        """Place of every word in the run, -1 for those that are not kept or in none of the shards held."""
        out = np.full(len(words), -1)
        shard = _shard_of(hashes, np.uint64(self.shards))
        for s in np.unique(shard).tolist():
            if s in self.tables:
                mine = np.flatnonzero(shard == s)
                slot = self.tables[s].slots(words.take(pa.array(mine)), hashes[mine])
                out[mine] = np.where(slot < 0, -1, slot + self.base[s])
        return out


def group_counts(docs: DataFrame, held: list) -> DataFrame:
    """lang, source, shard, slot, n: occurrences of the terms in the given shards, counted in each task."""
    by_lang = {}
    for r in held:
        by_lang.setdefault(r.lang, []).append(r)
    shared = docs.sparkSession.sparkContext.broadcast(by_lang)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("shard", pa.int64()), ("slot", pa.int64()), ("n", pa.int64())])

    def run(batches):
        slots = {lang: Slots(rows) for lang, rows in shared.value.items()}
        dense = {}

        def send():
            for (lang, source), counts in dense.items():
                at = np.flatnonzero(counts)
                yield record_batch(schema, [pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()),
                                            slots[lang].shard[at], slots[lang].slot[at], counts[at]])
            dense.clear()

        for batch in batches:
            for part in slices(batch):
                term, document, words = _terms(part)
                if not len(words):
                    continue
                (lang, langs), (source, sources) = _coded(part.column("lang")), _coded(part.column("source"))
                group = lang * len(sources) + source
                key, n = np.unique(group[document] * len(words) + term, return_counts=True)
                hashes, places = hash_words(words), {}
                groups, starts = np.unique(key // len(words), return_index=True)
                for g, a, b in zip(groups.tolist(), starts.tolist(), [*starts[1:].tolist(), len(key)]):
                    name = langs[g // len(sources)].as_py(), sources[g % len(sources)].as_py()
                    if name[0] not in slots:
                        continue
                    if name[0] not in places:
                        places[name[0]] = slots[name[0]].of(words, hashes)
                    place = places[name[0]][key[a:b] % len(words)]
                    if name not in dense:
                        dense[name] = np.zeros(slots[name[0]].n, np.int64)
                    dense[name][place[place >= 0]] += n[a:b][place >= 0]
                    if sum(8 * len(x) for x in dense.values()) > DENSE:
                        yield from send()
        yield from send()

    out = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, shard long, slot long, n long")
    return out.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


class Audit:
    """The stored tables that both parts read: groups with N and V, counts by slot, terms by slot."""

    def __init__(self, docs: DataFrame, least: int = LEAST, size: int = SHARD, room: int = BROADCAST):
        ship(docs.sparkSession)
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        docs = docs.select(blank("lang"), blank("source"), "text")
        self.shards = stored(shards(stored(vocabulary(docs, least), "vocabulary"), size), "shards")
        passes = max(1, -(-(self.shards.agg(F.sum("bytes")).first()[0] or 0) // room))
        held = self.shards.withColumn("pass", F.pmod(F.hash("lang", "shard"), F.lit(passes)))
        found = [stored(group_counts(docs, held.where(F.col("pass") == i).collect()), "counts") for i in range(passes)]
        self.counts = found[0]
        for more in found[1:]:
            self.counts = self.counts.union(more)
        size_of = self.shards.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
        total = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        every = docs.select("lang", "source").distinct()
        self.groups = stored(every.join(total, ["lang", "source"], "left").join(size_of, "lang", "left").select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "groups")


def share(count, total, v):
    """1 + floor(SCALE * (count + ADD) / (total + ADD * v)), three digits at a time so that nothing overflows."""
    step, whole = 1000, total + ADD * v
    out, left = 0, count + ADD
    for _ in range(3):
        left = left * step
        out, left = out * step + left // whole, left % whole
    return out + 1


def share_column(count, total, v):
    """The same as a column."""
    whole = total + F.lit(ADD).cast("long") * v
    div = lambda a, b: F.call_function("div", a, b)
    out, left = F.lit(0).cast("long"), count + F.lit(ADD)
    for _ in range(3):
        left = left * F.lit(1000)
        out, left = out * F.lit(1000) + div(left, whole), left % whole
    return out + F.lit(1)


def pairs(audit: Audit) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum of |p - q| over all kept terms."""
    sizes = audit.shards.select(F.col("lang").alias("l"), "shard", F.size("terms").cast("long").alias("slots"))
    headers = audit.groups.join(sizes, F.col("lang") == F.col("l"), "left").select(
        "lang", F.coalesce("shard", F.lit(-1)).alias("shard"), "source", "total", "v", F.coalesce("slots", F.lit(0)).alias("slots"))
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])

    def compare(counts, header):
        names = header.column("source").to_pylist()
        total, v = (header.column(c).to_numpy() for c in ("total", "v"))
        slots = header.column("slots")[0].as_py() if names else 0
        n = np.zeros((len(names), slots), np.int64)
        index = {s: i for i, s in enumerate(names)}
        codes = counts.column("source").combine_chunks().dictionary_encode()
        rows = np.array([index[s] for s in codes.dictionary.to_pylist()], np.int64)
        if len(codes):
            n[rows[codes.indices.to_numpy()], counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
        p = share(n, total[:, None], v[:, None]) if slots else n
        a, b, value = [], [], []
        for i in range(len(names) - 1):
            a.extend([names[i]] * (len(names) - 1 - i))
            b.extend(names[i + 1:])
            value.append(np.abs(p[i + 1:] - p[i]).sum(axis=1))
        lang = header.column("lang")[0].as_py() if names else None
        return pa.Table.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()),
                                     pa.array(np.concatenate(value) if value else np.zeros(0, np.int64))], schema=schema)

    met = audit.counts.groupBy("lang", "shard").cogroup(headers.groupBy("lang", "shard")).applyInArrow(
        compare, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return met.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("pair"), "value").select("lang", "pair.*", "value")


def terms(audit: Audit) -> DataFrame:
    """lang, source, item (a term that the group uses more than its language), value: p - q."""
    key = ["lang", "shard", "slot"]
    lexicon = audit.shards.select("lang", "shard", F.posexplode("terms").alias("slot", "item")).withColumn("slot", F.col("slot").cast("long"))
    whole = audit.counts.groupBy(*key).agg(F.sum("n").alias("n_lang"))
    total = audit.groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    lexicon = lexicon.join(whole, key).join(total, "lang")
    used = audit.counts.where("n > 0").join(audit.groups, ["lang", "source"]).join(lexicon, key)
    value = share_column(F.col("n"), F.col("total"), F.col("v")) - share_column(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    return used.select("lang", "source", "item", value.alias("value")).where("value > 0")


def ranked(values: DataFrame, part: str, top: int = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = values.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return out if top is None else out.where(F.col("rank") <= top)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, size: int = SHARD, room: int = BROADCAST) -> DataFrame:
    """lang, source, part (`pair`: all other sources; `term`: the top terms), item, value, rank."""
    audit = Audit(docs, least, size, room)
    return ranked(pairs(audit), "pair").union(ranked(terms(audit), "term", top))
