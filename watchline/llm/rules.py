"""Rule bitmask ledger: every quality rule is evaluated once per document; policies and ablations only read bits.

`measure` takes whole texts to measurements, `ledger` turns each rule into one bit of `failed`. A policy is a dated set
of rules with a number of failures it tolerates; `judge` applies one by masking bits, `ablate` counts for each rule of a
policy the documents that come back without it. Both can be rerun over a stored ledger without reading any text.

Words are `[^\\x20\\x09-\\x0D]+`. Edge cases: a null or empty text has measurements 0 and fails `few_words`; rows are
judged one by one, so repeated rows and ids give repeated results; empty tables give empty results (an ablation has
counts 0); further columns of the input are ignored. Texts are measured in pieces of about 2 MB, one long text at once.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..ship import ship
from .words import mixed, record_batch, slices, window_hashes, word_ids

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps_words")


@dataclass(frozen=True)
class Rule:
    """A document fails when 100 * measure lies outside [low, high] * per (a measure, or 1)."""
    name: str
    measure: str
    per: str | None = None
    low: int | None = None
    high: int | None = None

    def failed(self) -> Column:
        value, unit = 100 * F.col(self.measure), F.col(self.per) if self.per else F.lit(1)
        out = []
        if self.low is not None:
            out.append(value < self.low * unit)
        if self.high is not None:
            out.append(value > self.high * unit)
        return reduce(lambda a, b: a | b, out)


# A rule's place in this tuple is its bit; new rules go to the end, so that stored ledgers stay valid.
RULES = (
    Rule("few_words", "n_words", low=1000),
    Rule("repeated_words", "n_repeat_words", per="n_words", high=20),
    Rule("many_symbols", "n_symbols", per="n_words", high=10),
    Rule("word_length", "word_chars", per="n_words", low=200, high=1500),
    Rule("repeated_lines", "n_dup_lines", per="n_lines", high=30),
    Rule("shouting", "n_caps_words", per="n_words", high=40),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """Reject a document that fails any required rule, or more than `tolerated` of the others."""
    required: tuple = BASE
    others: tuple = ()
    tolerated: int = 0


POLICIES = {
    "1": Policy(),
    "2": Policy(others=("many_symbols", "word_length")),
    "3": Policy(others=("many_symbols", "word_length", "shouting")),
    "strict": Policy(others=("many_symbols", "word_length", "repeated_lines", "shouting")),
}
CURRENT = "3"


def bits(names, rules=RULES) -> int:
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[n] for n in names)


def _sums(values, ends):
    """Per-text sums of per-item values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    starts = np.concatenate([[0], ends[:-1]])
    return total[ends] - total[starts]


def _repeats(ids, ends):
    """Words per text that lie in a window of WINDOW words found twice or more in it."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(ends), np.int64)
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1:])
    key = window_hashes(mixed(ids.astype(np.uint64)), WINDOW)[at] ^ mixed(owner[at].astype(np.uint64))
    at = at[np.argsort(key)]
    a, b = at[:-1], at[1:]
    same = owner[a] == owner[b]
    for i in range(WINDOW):
        same &= ids[a + i] == ids[b + i]
    hit = np.unique(np.concatenate([a[same], b[same]]))
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[hit] += 1
    np.subtract.at(edge, hit + WINDOW, 1)
    return _sums(np.cumsum(edge[:-1]) > 0, ends)


def _duplicate_lines(texts):
    """(lines with a word, those equal to an earlier line) per text."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, line = owner[worded[line]], line[worded[line]]
    distinct = np.unique(owner * (len(worded) + 1) + line) // (len(worded) + 1)
    lines = np.bincount(owner, minlength=len(texts))
    return lines, lines - np.bincount(distinct, minlength=len(texts))


def measurements(texts: pa.Array) -> list:
    """The MEASURES of an Arrow column of texts, as arrays."""
    ids, ends, words = word_ids(texts)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    symbols = pc.count_substring_regex(words, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)
    caps = pc.and_not(pc.match_substring_regex(words, r"\p{Lu}"), pc.match_substring_regex(words, r"\p{Ll}"))
    caps = caps.to_numpy(zero_copy_only=False)
    lines, doubled = _duplicate_lines(texts)
    return [np.diff(ends, prepend=0), _sums(chars[ids], ends), _sums(symbols[ids], ends), lines, doubled,
            _repeats(ids, ends), _sums(caps[ids], ends)]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the MEASURES of every text."""
    schema = pa.schema([("doc_id", pa.int64())] + [(m, pa.int64()) for m in MEASURES])

    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                if part.num_rows:
                    yield record_batch(schema, [part.column("doc_id"), *measurements(part.column("text"))])

    fields = ", ".join(f"{m} long" for m in MEASURES)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {fields}")


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measurements, and `failed`: bit i is set when rule i fails."""
    failed = reduce(lambda a, b: a.bitwiseOR(b),
                    [F.when(r.failed(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)])
    return measure(docs).withColumn("failed", failed)


def judge(entries: DataFrame, policy: Policy, rules=RULES) -> Column:
    """Whether the policy keeps a ledger row."""
    kept = F.col("failed").bitwiseAND(F.lit(bits(policy.required, rules))) == 0
    return kept & (F.bit_count(F.col("failed").bitwiseAND(F.lit(bits(policy.others, rules)))) <= policy.tolerated)


def ablate(entries: DataFrame, policy: Policy, rules=RULES) -> DataFrame:
    """rule, failed, rejected, returned: documents that fail the rule, that the policy rejects among them, and that it
    would keep without the rule. Works on counts per bit pattern, at most 2 to the number of rules."""
    patterns = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", judge(entries, policy, rules))
    counts = []
    for name in (*policy.required, *policy.others):
        bit = bits([name], rules)
        without = Policy(tuple(n for n in policy.required if n != name), tuple(n for n in policy.others if n != name),
                         policy.tolerated)
        fails = F.col("failed").bitwiseAND(F.lit(bit)) != 0
        counts += [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"{name}:{what}") for what, c in (
            ("failed", fails), ("rejected", fails & ~F.col("kept")),
            ("returned", ~F.col("kept") & judge(entries, without, rules)))]
    one = patterns.agg(*counts)
    rows = [F.struct(F.lit(n).alias("rule"), *[F.coalesce(F.col(f"`{n}:{w}`"), F.lit(0)).alias(w)
                                               for w in ("failed", "rejected", "returned")])
            for n in (*policy.required, *policy.others)]
    return one.select(F.inline(F.array(*rows)))
