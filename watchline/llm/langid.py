"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of 64 bytes. A forward and a backward recurrent layer read each window, every position gets a
distribution over the languages, and these are pooled over all letter positions of the whole text: means over its eighths,
then a weighted mean of the eighths. The network is trained in NumPy by backpropagation through time with Adam; the eight
weights are fitted after it by expectation maximisation, so the labels say which parts of mixed texts they go by. The
fitting sample is bounded: at most PIECES documents a language, those that come first in a hash order; the network sees
from each a piece of at most PIECE characters at a hashed place, the weights see the documents' pooled eighths.

Edge cases: `und` with score 0 if the text is null, empty or has no letter, or if there was nothing to learn from; rows
are predicted one by one, so repeated rows and ids give equal results; a null doc_id stays null; null languages are never
learned; empty tables give empty results; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..ship import ship
from .tables import lowest
from .words import record_batch, slices

WINDOW, HIDDEN = 64, 8
PIECES, PIECE = 1500, 256
STEPS, BATCH, RATE = 300, 256, 0.02
PARTS = 8  # of a text, for pooling
CHUNK = 4096  # windows run side by side


def _order():
    return F.xxhash64("doc_id", F.length("text"))


def sample(labelled: DataFrame, pieces: int = PIECES) -> DataFrame:
    """lang, h, piece: the bounded fitting sample of (doc_id, text, lang); h is the place in the hash order."""
    h = _order()
    room = F.greatest(F.length("text") - PIECE, F.lit(0)) + 1
    rows = labelled.where("lang is not null and length(text) > 0").select("lang", h.alias("h"), "text")
    rows = lowest(rows, "lang", "h", pieces).select("lang", "h", F.substr(
        "text", (F.pmod(F.xxhash64("h"), room) + 1).cast("int"), F.lit(PIECE)).alias("piece"))
    n = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    return rows.withColumn("n", n).where(F.col("n") <= pieces).select("lang", "h", "piece")


def windows(data: np.ndarray, lengths: np.ndarray):
    """(bytes of every window, padded with 0; owner of each window; its number of bytes)."""
    counts = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), counts)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[owner] + place * WINDOW
    size = np.minimum(lengths[owner] - place * WINDOW, WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    grid = padded[begin[:, None] + np.arange(WINDOW)]
    grid[np.arange(WINDOW) >= size[:, None]] = 0
    return grid, owner, size


def _letters(grid):
    """Positions that are letters, or parts of characters outside ASCII."""
    low = grid | 32
    return (grid >= 128) | ((low >= 97) & (low <= 122))


GATES = "zrn"  # update, reset, candidate


def init(classes: int, seed: int = 7) -> dict:
    """Per direction and gate a byte table E and a state matrix U; output weights W per direction, and c."""
    rng = np.random.default_rng(seed)
    p = {"c": np.zeros((classes, 1))}
    for way in "fb":
        p["W" + way] = rng.normal(0, 0.3, (classes, HIDDEN))
        for gate in GATES:
            p["E" + way + gate] = rng.normal(0, 0.3, (256, HIDDEN))
            p["U" + way + gate] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, HIDDEN))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _gate(p, name, x, h, u):
    """The gate's input from bytes x and state h; u is room for the product."""
    out = p["E" + name].take(x, axis=0)
    np.matmul(h, p["U" + name], out=u)
    return out


def _closing(a):
    """1 / (1 + exp(a)), in place."""
    np.exp(a, a)
    a += 1
    return np.reciprocal(a, a)


def _layer(p, way, grid, keep=None):
    """States after every position, [WINDOW, windows, HIDDEN], of bytes [WINDOW, windows]."""
    h = np.zeros((grid.shape[1], HIDDEN), np.float32)
    u, states = np.empty_like(h), np.empty((WINDOW, *h.shape), np.float32)
    for t in (range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1)):
        x = grid[t]
        z = _gate(p, way + "z", x, h, u)
        z += u
        _closing(z)
        r = _gate(p, way + "r", x, h, u)
        r += u
        _closing(r)
        n = _gate(p, way + "n", x, h, u)
        if keep is not None:
            keep.append((t, h, z, r, n, u.copy()))
        u *= r
        n += u
        np.tanh(n, n)
        now = states[t]
        np.subtract(h, n, out=now)
        now *= z
        now += n
        h = now
    return states


def _softmax(p, f, b):
    """[classes, WINDOW * windows] from the states of both directions."""
    out = p["Wf"] @ f.reshape(-1, HIDDEN).T
    out += p["Wb"] @ b.reshape(-1, HIDDEN).T
    out += p["c"]
    out -= out.max(axis=0)
    np.exp(out, out)
    out /= out.sum(axis=0)
    return out


def probabilities(p, grid):
    """Softmax at every position of windows given as [WINDOW, windows]: [classes, WINDOW, windows]."""
    grid = grid.astype(np.intp)
    return _softmax(p, _layer(p, "f", grid), _layer(p, "b", grid)).reshape(-1, *grid.shape)


def _gradients(p, grid, target):
    """Backpropagation through time of the mean cross-entropy over letter positions."""
    letters, grid = _letters(grid), grid.astype(np.intp)
    trace = {"f": [], "b": []}
    states = {way: _layer(p, way, grid, trace[way]) for way in "fb"}
    d = _softmax(p, states["f"], states["b"]).reshape(-1, *grid.shape)
    d[target, :, np.arange(grid.shape[1])] -= 1
    d *= letters / np.float32(max(1, letters.sum()))
    flat = d.reshape(len(d), -1)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["c"] = flat.sum(axis=1, keepdims=True)
    hot = np.eye(256, dtype=np.float32)
    for way in "fb":
        g["W" + way] = flat @ states[way].reshape(-1, HIDDEN)
        into = (flat.T @ p["W" + way]).reshape(states[way].shape)
        dh = np.zeros((grid.shape[1], HIDDEN), np.float32)
        for t, h, z, r, n, un in reversed(trace[way]):
            dh = dh + into[t]
            da = {"n": dh * (1 - z) * (1 - n * n)}
            da["z"] = -dh * (h - n) * z * (1 - z)
            da["r"] = -da["n"] * un * r * (1 - r)
            dh = dh * z
            seen = hot[grid[t]].T
            for gate in GATES:
                g["E" + way + gate] += seen @ da[gate]
                through = da[gate] * r if gate == "n" else da[gate]
                g["U" + way + gate] += h.T @ through
                dh = dh + through @ p["U" + way + gate].T
    return g


def fit(pieces: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> tuple[list[str], dict]:
    """(languages, parameters) from (lang, piece) rows."""
    langs = sorted({lang for lang, _ in pieces})
    if not langs:
        return [], {}
    p = init(len(langs), seed)
    raw = [np.frombuffer(text.encode("utf-8", "replace"), np.uint8) for _, text in sorted(pieces)]
    label = np.array([langs.index(lang) for lang, _ in sorted(pieces)])
    grid, owner, size = windows(np.concatenate(raw), np.array([len(r) for r in raw], np.int64))
    full = _letters(grid).sum(axis=1) >= 8
    grid, y = grid[full], label[owner[full]]
    by_class = [rows for c in range(len(langs)) if len(rows := np.flatnonzero(y == c))]
    if len(langs) < 2 or len(by_class) < 2:
        return langs, p
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    each = -(-BATCH // len(by_class))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, each) for rows in by_class])
        g = _gradients(p, grid[pick].T, y[pick])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * (1 - (step - 1) / steps)
        for k in p:
            x = g[k] / max(1.0, norm)
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return langs, p


def _pool(p, classes, data, lengths):
    """[texts, PARTS, classes]: mean distribution over the letter positions of each part, and [texts, PARTS] their share
    of 1 or 0 (a part without letters)."""
    grid, owner, _ = windows(data, lengths)
    counts = -(-lengths // WINDOW)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    cell = owner * PARTS + place * PARTS // np.maximum(counts[owner], 1)
    total, seen = np.zeros((len(lengths) * PARTS, classes)), np.zeros(len(lengths) * PARTS)
    for i in range(0, len(grid), CHUNK):
        part = np.ascontiguousarray(grid[i:i + CHUNK].T)
        use = _letters(part)
        prob = np.einsum("ctw,tw->wc", probabilities(p, part), use.astype(np.float32), optimize=True)
        here = cell[i:i + CHUNK]
        for c in range(classes):
            total[:, c] += np.bincount(here, prob[:, c], len(total))
        seen += np.bincount(here, use.sum(axis=0), len(total))
    mean = total / np.maximum(seen, 1)[:, None]
    return mean.reshape(-1, PARTS, classes), (seen > 0).reshape(-1, PARTS)


def _weigh(mean, there, weight):
    """[texts, classes]: the weighted mean of the parts that have letters."""
    w = there * weight
    return (mean * w[:, :, None]).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-12)[:, None]


def fit_weights(mean, there, label, rounds: int = 30):
    """Weights of the parts that make the labels likeliest, by expectation maximisation; no weight falls to zero."""
    weight = np.full(PARTS, 1 / PARTS)
    chance = mean[np.arange(len(label)), :, label] * there
    for _ in range(rounds if len(label) else 0):
        joint = chance * weight + 1e-9
        share = (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0)
        weight = (share + 0.01 * len(label)) / (share + 0.01 * len(label)).sum()
    return weight


def _pooled(texts: pa.Array, p, classes):
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return _pool(p, classes, np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8), lengths)


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score for every document."""
    langs, p, weight = model
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                texts = pc.fill_null(part.column("text"), "")
                lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
                names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if langs:
                    mean = _weigh(*_pooled(texts, p, len(langs)), weight)
                    names = np.where(lettered, np.array(langs, object)[mean.argmax(axis=1)], "und")
                    score = np.where(lettered, np.minimum(mean.max(axis=1), 1.0), 0.0).round(6)
                yield record_batch(schema, [part.column("doc_id"), pa.array(names, pa.string()), score])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def train(labelled: DataFrame, **how):
    """(languages, network, weights of the parts) from the bounded sample of (doc_id, text, lang)."""
    labelled = labelled.select("doc_id", "text", "lang")
    rows = sample(labelled).collect()
    langs, p = fit([(r.lang, r.piece) for r in rows], **how)
    if not langs:
        return langs, p, np.full(PARTS, 1 / PARTS)
    spark = labelled.sparkSession
    ship(spark)
    # One row of the bounded sample for each chosen document; the join reads the whole texts where they are.
    chosen = spark.createDataFrame([(r.lang, r.h) for r in rows], "l string, h long").distinct()
    whole = labelled.withColumn("_h", _order()).join(F.broadcast(chosen), (F.col("_h") == F.col("h")) & (F.col("lang") == F.col("l")))
    schema = pa.schema([("lang", pa.string()), ("_h", pa.int64()), ("mean", pa.binary()), ("there", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                mean, there = _pooled(part.column("text"), p, len(langs))
                yield record_batch(schema, [part.column("lang"), part.column("_h"), [m.astype(np.float32).tobytes() for m in mean],
                                            [t.tobytes() for t in there]])

    found = whole.select("lang", "_h", "text").mapInArrow(run, "lang string, _h long, mean binary, there binary")
    found = found.groupBy("lang", "_h").agg(F.min(F.struct("mean", "there")).alias("m")).select("lang", "m.*").collect()
    mean = np.stack([np.frombuffer(r.mean, np.float32).reshape(PARTS, -1) for r in found])
    there = np.stack([np.frombuffer(r.there, bool) for r in found])
    return langs, p, fit_weights(mean, there, np.array([langs.index(r.lang) for r in found]))
