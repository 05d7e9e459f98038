"""Perfect hashes, and the audit of sources against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from watchline.llm import divergence, perfect
from watchline.llm.words import hash_words


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_perfect_hash_has_a_slot_for_every_key_and_none_for_others(n):
    keys = pa.array([f"kéy{i}" for i in range(n)], pa.string())
    table = perfect.PerfectHash.build(keys)
    assert sorted(table.slots(keys, hash_words(keys)).tolist()) == list(range(n))
    others = pa.array([f"other{i}" for i in range(3000)] + ["", "kéy"], pa.string())
    assert (table.slots(others, hash_words(others)) == -1).all()
    data, sizes = table.packed()
    again = perfect.PerfectHash.unpacked(table.keys, data, sizes)
    assert (again.slots(keys, hash_words(keys)) == table.slots(keys, hash_words(keys))).all()


def test_keys_of_one_hash_are_told_apart(monkeypatch):
    same = lambda words: np.array([1 if str(w) in ("a", "b", "z") else 2 + len(str(w)) for w in words.to_pylist()], np.uint64)
    monkeypatch.setattr(perfect, "hash_words", same)
    keys = pa.array(["a", "b", "ccc", "dddd"])
    table = perfect.PerfectHash.build(keys)
    asked = pa.array(["b", "a", "z", "ccc", "dddd", "eeee"])
    slots = table.slots(asked, same(asked)).tolist()
    assert sorted(slots[i] for i in (0, 1, 3, 4)) == [0, 1, 2, 3] and slots[2] == slots[5] == -1


def plain(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(lang or "", source or "", term.findall((text or "").translate(small))) for text, lang, source in rows]
    held = defaultdict(Counter)
    for lang, _, w in rows:
        held[lang].update(set(w))
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        groups = {s: Counter() for la, s, _ in rows if la == lang}
        for la, s, w in rows:
            if la == lang:
                groups[s].update(x for x in w if x in set(kept))
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731,B023
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            more = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, cut in (("pair", pairs, None), ("term", more, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:cut])]
    return sorted(out)


def corpus():
    rng = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Ünder", "été", "CAPS", "a1b", "don't", "日本"]
    rows = [(" ".join(rng.choice(words[:rng.choice([20, 96])]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]),
             rng.choice(["s1", "s2", "é", "Z", None])) for _ in range(400)]
    return rows + [(None, "en", "s1"), ("", "xx", "only"), ("nothing kept here", "yy", "a"), ("", "yy", "b"), (None, None, None)] + rows[:3]


@pytest.mark.parametrize("size,room,dense", [(4096, 64 << 20, 64 << 20), (7, 300, 500)])
def test_audit_is_that_of_a_plain_count(spark, monkeypatch, size, room, dense):
    """Also with many small shards, several passes and dense counts that are sent often."""
    monkeypatch.setattr(divergence, "DENSE", dense)
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, "z", 1) for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, term string, n int").repartition(3)
    got = sorted(tuple(r) for r in divergence.divergence(docs, least=5, top=8, size=size, room=room).collect())
    assert got == plain(rows, 5, 8) and len(got) > 100


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.divergence(docs).count() == 0


def test_shares_do_not_overflow():
    n, total, v = 3 * 10**13, 9 * 10**13, 10**9
    assert int(divergence.share(np.array([n]), np.array([total]), np.array([v]))[0]) == 1 + 10**9 * (n + 5) // (total + 5 * v)
