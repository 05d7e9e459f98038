"""Quality classifier: naive Bayes support vectors (NB-SVM).

Indicators of n-grams (bytes 3, words 1 and 2, word shapes 3) are hashed to a fixed number of features, scaled by the
classes' log-count ratios, brought to unit length, and separated by a linear hinge-loss model that dual coordinate descent
fits. Four in five sampled rows fit the model, the fifth calibrates its margin to a probability (logistic, by Newton).

The fitting sample is bounded: per class the SAMPLE labelled documents that come first in a hash order; labels whose
quality is null or contradicts another label of the same doc_id do not count. Scores use whole texts.

Edge cases: null and empty texts have no features and get the calibrated intercept; repeated rows and ids are scored row
by row; with fewer than two classes in the sample every score is that class's (0.5 without any); empty tables give empty
results; further columns are ignored by `scores` and kept by `accepted`.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..ship import ship
from .tables import lowest
from .words import hash_words, mixed, record_batch, slices, window_hashes, word_ids

SAMPLE = 1500  # labelled documents of each class
SPACE = 1 << 16  # hashed features of each of the three kinds
PASSES, COST, SMOOTH = 12, 1.0, 1.0


def shapes(words: pa.Array) -> np.ndarray:
    """A small number for the look of each word: case, digits, last character."""
    def has(pattern):
        return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(np.uint64)
    return (has(r"\p{Lu}") + 2 * has(r"\p{Ll}") + 4 * has(r"[0-9]") + 8 * has(r"[.,;:]$") + 16 * has(r"[!?]$")
            + 32 * has(r"[^\p{L}0-9.,;:!?]$") + 64 * has(r"^\p{Lu}") + 128 * has(r"^[^\p{L}]"))


def features(texts: pa.Array):
    """Yield the sorted distinct feature numbers of each text of a column."""
    texts = pc.fill_null(texts, "")
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint32)
    ids, ends, words = word_ids(texts)
    grams = (((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32) \
        if len(data) > 2 else np.zeros(0, np.int32)
    word = hash_words(words)[ids]
    shape = shapes(words)[ids] * np.uint64(2)
    shape[1:] += ids[1:] == ids[:-1]  # the same word again
    at = lambda h, kind: (h % np.uint64(SPACE // 2)).astype(np.int32) + np.int32(SPACE + kind * (SPACE // 2))
    one, two, three = at(mixed(word), 0), at(window_hashes(word, 2), 1), at(window_hashes(mixed(shape), 3), 2)
    start = 0
    for i, end in enumerate(ends):
        yield np.unique(np.concatenate([grams[sizes[i]:max(sizes[i], sizes[i + 1] - 2)], one[start:end],
                                        two[start:max(start, end - 1)], three[start:max(start, end - 2)]]))
        start = end


SIZE = SPACE + 3 * (SPACE // 2)


def sampled(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> list:
    """(doc_id, quality, features as bytes) of the bounded sample."""
    clear = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("_high")).where("quality = _high")
    n = F.row_number().over(Window.partitionBy("quality").orderBy("_h", "doc_id"))
    clear = lowest(clear.select("doc_id", "quality", F.xxhash64("doc_id").alias("_h")), "quality", "_h", per_class)
    chosen = clear.withColumn("_n", n).where(F.col("_n") <= per_class).select(F.col("doc_id").alias("id"), "quality")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("found", pa.binary())])
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [f.astype(np.int32).tobytes() for f in features(part.column("text"))]
                yield record_batch(schema, [part.column("doc_id"), part.column("quality"), found])

    out = rows.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(run, "doc_id long, quality int, found binary")
    return out.groupBy("doc_id").agg(F.min(F.struct("quality", "found")).alias("m")).select("doc_id", "m.*").collect()


def _hinge(rows, y, size, passes=PASSES, cost=COST, seed=5):
    """Weights (the last one is the intercept) by dual coordinate descent; rows are (ids, values) of unit length."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    limit = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i]
            gradient = y[i] * (w[ids] @ x + w[size]) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), limit[i])  # the row's squared length is 1, its intercept adds 1
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[ids] += step * x
                w[size] += step
                alpha[i] = new
    return w


def _calibrated(margin, y):
    """(a, b) of the logistic 1 / (1 + exp(-(a * margin + b))), with the targets drawn in by one row a class."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, x.T @ (p - t) + 1e-3 * ab), -2, 2)
    return max(ab[0], 1e-3), ab[1]


def fit(sample: list):
    """(ratio, weights, intercept, a, b), or the constant score of a sample without two classes."""
    sample = sorted((r[0], r[1], np.frombuffer(r[2], np.int32)) for r in sample)
    y = np.array([1 if r[1] == 1 else -1 for r in sample])
    if len(set(y.tolist())) < 2:
        return 0.5 if not len(y) else float(y[0] > 0)
    counts = {}
    for c in (1, -1):
        n = np.full(SIZE, SMOOTH)
        for r, k in zip(sample, y):
            if k == c:
                n[r[2]] += 1
        counts[c] = n / ((y == c).sum() + 2 * SMOOTH)
    ratio = np.log(counts[1] / counts[-1])
    rows = [(r[2], ratio[r[2]] / max(1e-9, np.sqrt((ratio[r[2]] ** 2).sum()))) for r in sample]
    last = np.zeros(len(y), bool)
    for c in (1, -1):
        last[np.flatnonzero(y == c)[::5]] = True
    if len(set(y[last].tolist())) < 2 or len(set(y[~last].tolist())) < 2:
        last[:] = True
    learn = ~last if not last.all() else last
    w = _hinge([r for r, k in zip(rows, learn) if k], y[learn], SIZE)
    margin = np.array([w[ids] @ x + w[SIZE] for (ids, x), k in zip(rows, last) if k])
    a, b = _calibrated(margin, y[last])
    return ratio, w[:SIZE] * ratio, float(w[SIZE]), float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE):
    return fit(sampled(docs, labels, per_class))


def text_scores(texts: pa.Array, model) -> np.ndarray:
    """Probability of quality 1 for each text of a column."""
    if isinstance(model, float):
        return np.full(len(texts), model)
    ratio, weight, intercept, a, b = model
    square, out = ratio ** 2, np.empty(len(texts))
    for i, ids in enumerate(features(texts)):
        length = np.sqrt(square[ids].sum())
        out[i] = weight[ids].sum() / max(length, 1e-9) + intercept
    return 1 / (1 + np.exp(-np.clip(a * out + b, -30, 30)))


def scores(docs: DataFrame, model) -> DataFrame:
    """doc_id, score, predicted for every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = text_scores(part.column("text"), model)
                yield record_batch(schema, [part.column("doc_id"), s, (s >= 0.5).astype(np.int32)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model) -> DataFrame:
    """The documents that the model predicts as quality 1, with all their columns."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(text_scores(part.column("text"), model) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
