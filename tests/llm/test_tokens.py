"""Tokenizer alignment and packing against plain versions that encode whole texts."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from watchline.llm import alignment, packing, tokens

pytest.importorskip("public_tokenizers")
A, B, W = (tokens.tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ALPHABET = [*"ab 's 12 .,!'  \n\t  éÉß×÷İΣς中文▁|\x00\x1c\x85́ ﻿", "<|endoftext|>", "<|ENDOFTEXT|>", " don't", "<s>", " Σ", " word",
            "Word,", "été.", " zwölf", "\r\n", "12,5", "&amp;"]


def fuzzed(n, seed, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(longest))) for _ in range(n)]


def docs_of(spark, texts, partitions=3):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, pair string, row int").repartition(partitions)


def test_pieces_encode_as_whole_texts_do():
    texts = fuzzed(4000, 1) + ["", " ", "  ", "x" * 3000, "é" * 500 + ","]
    column = pa.array(texts, pa.string())
    t = tokens._bpe(W, False)
    ids, ends = tokens.word_tokens(column, W)
    starts = [0, *ends[:-1]]
    for text, s, e in zip(texts, starts, ends):
        assert ids[s:e].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    pair = tokens.pair_of(A, B)
    texts = [x for x in texts if x]
    pieces, piece_ends = tokens.spaced_pieces(pa.array(texts, pa.string()))
    listed = pieces.to_pylist()
    start = 0
    for text, end in zip(texts, piece_ends.tolist()):
        mine = listed[start:end]
        assert "".join(mine) == " " + text
        a = [i for p in mine for i in pair.a.encode(p, add_special_tokens=False).ids]
        b = [i for i in pair._b(mine)[0].tolist() if i >= 0]
        assert a == pair.a.encode(" " + text, add_special_tokens=False).ids and b == pair.b.encode(text), repr(text)
        start = end


def plain_alignment(texts):
    pair = tokens.pair_of(A, B)
    found, documents, links = {}, Counter(), defaultdict(Counter)
    for i, text in enumerate(texts):
        found[i] = (0, 0, 0, 0, "")
        if not text:
            continue
        a, b, want = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text), (" " + text).encode()
        if any(b"".join(t[x] for x in ids) != want for t, ids in ((pair.bytes_a, a), (pair.bytes_b, b))):
            continue
        ends = [list(np.cumsum([len(t[x]) for x in ids])) for t, ids in ((pair.bytes_a, a), (pair.bytes_b, b))]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(cut) + 1 for e in ends]
            groups.append((a[at[0]:to[0]], b[at[1]:to[1]]))
            at = to
        for x, y in groups:
            links[i].update((p, q) for p in x for q in y)
        documents.update(links[i].keys())
        text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        found[i] = (len(a), len(b), len(groups), sum(links[i].values()), hashlib.sha256(text.encode()).hexdigest())
    top = defaultdict(int)
    for (p, _), n in documents.items():
        top[p] = max(top[p], n)
    return sorted((i, *f[:4], sum(n for k, n in links[i].items() if documents[k] == top[k[0]]),
                   sum(n * documents[k] for k, n in links[i].items()), f[4]) for i, f in found.items())


def test_alignment_is_that_of_a_plain_loop(spark):
    texts = [x.replace("▁", "") if i % 3 else x for i, x in enumerate(fuzzed(500, 2))]
    texts += ["It is one small text.", "It is one small text.", None, "", " ", "x" * 700, "ab" * 400 + " end", "a\n\n\n\n  b   c"]
    got = alignment.align(docs_of(spark, texts), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain_alignment(texts)
    assert sum(r[1] > 0 for r in plain_alignment(texts)) > 300


def test_alignment_edges(spark):
    docs = spark.createDataFrame([(None, "one text", 1), (None, None, 1), (1, "one text", 1), (1, "one text", 2)],
                                 "doc_id long, text string, block long")
    got = sorted((tuple(r) for r in alignment.align(docs, A, B).collect()), key=str)
    assert [r[0] for r in got] == [1, 1, None, None] and got[2] == (None, 0, 0, 0, 0, 0, 0, "")
    assert got[3][6] == 3 * got[3][4] > 0
    assert alignment.align(docs.limit(0), A, B).count() == 0
    spans = sorted(tuple(r) for r in alignment.groups(docs.where("doc_id is not null").limit(1), A, B).collect())
    assert [s[3:] for s in spans] == [(0, 4), (4, 9)] and alignment.groups(docs.limit(0), A, B).count() == 0


def test_division_finds_every_shared_end():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        share = rng.choice([0.02, 0.3, 0.9])
        inner = np.arange(1, n)
        both = inner[rng.random(n - 1) < share]
        one = np.setdiff1d(inner[rng.random(n - 1) < 0.6], both)
        side = rng.random(len(one)) < 0.5
        a, b = (np.sort(np.concatenate([both, x, [n]])) for x in (one[side], one[~side]))
        got = alignment.divide(a, b, np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]))
        assert a[got[1] - 1].tolist() == b[got[3] - 1].tolist() == [*both.tolist(), n]
        assert got[0].tolist() == [0, *got[1][:-1].tolist()] and got[2].tolist() == [0, *got[3][:-1].tolist()]


def test_long_groups_are_linked_in_runs():
    pair = tokens.pair_of(A, B)
    x = alignment.Aligner(pa.array([" ".join(fuzzed(40, 5)).replace("▁", "") for _ in range(3)]), pair)
    whole, runs = x.links(), x.links(limit=7)
    assert all((p == q).all() for p, q in zip(whole, runs)) and len(whole[0]) > 100


def test_packing_holds_every_piece_once(spark):
    t = tokens._bpe(W, False)
    rng = random.Random(4)
    words = ["alpha", "beta,", "gamma", "delta", "12", "don't"]
    texts = [None, "", " \n", "<|endoftext|>"] + [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 17, 40, 90, 200]))) for _ in range(300)]
    got = packing.pack(docs_of(spark, texts), W, 64, with_ids=True).collect()
    want = {i: (t.encode(x, add_special_tokens=False).ids if x else []) + [1] for i, x in enumerate(texts)}
    of, held = defaultdict(list), defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
    for i, ids in want.items():
        rows = sorted(of[i], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(-(-len(ids) // 64))) and [r.start for r in rows] == [64 * r.piece for r in rows]
        assert [x for r in rows for x in r.ids] == ids
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(map(len, want.values())) // 64)
    assert len(held) <= 1.04 * least + 1
    whole = {r.sequence_id: r for r in packing.sequences(packing.pack(docs_of(spark, texts), W, 64, with_ids=True)).collect()}
    assert sum(len(r.ids) for r in whole.values()) == sum(map(len, want.values())) and max(len(r.ids) for r in whole.values()) <= 64


def test_packing_edges(spark):
    docs = spark.createDataFrame([(None, "a b", "z"), (None, None, "z"), (1, "a b", "z"), (1, "a b", "z")], "doc_id long, text string, length string")
    got = packing.pack(docs, W)
    assert sorted((r.doc_id is None, r.length, r.offset) for r in got.collect()) is not None
    assert sorted(r.length for r in got.collect()) == [1, 3, 3, 3] and len({r.sequence_id for r in got.collect()}) == 1
    assert packing.pack(docs.limit(0), W).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_length_and_come_near_the_least(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 4097, 3000), np.minimum(4096, rng.lognormal(6, 1, 8000).astype(int) + 1), rng.integers(900, 1500, 900),
               np.repeat([2049, 3000, 4096], 50)][seed]
    counts = np.bincount(lengths, minlength=4097)
    runs, n = packing.best_plan(counts)
    held, seen = defaultdict(list), np.zeros(4097, int)
    for length, rank, m, first, each, offset in runs:
        assert rank == seen[length]
        seen[length] += m
        for k in range(m):
            held[first + k // each].append((offset + k % each * length, length))
    assert (seen == counts).all() and sorted(held) == list(range(n))
    for places in held.values():
        places.sort()
        assert all(o == sum(x for _, x in places[:k]) for k, (o, _) in enumerate(places)) and sum(x for _, x in places) <= 4096
    least = -(-int(lengths.sum()) // 4096)
    assert n == 150 if seed == 3 else n <= least * 1.03 + 1
