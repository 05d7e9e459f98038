"""A text classifier that learns batch by batch: one-vs-rest logistic regression with a stored optimiser state.

Features are the hashed words and word pairs of `classify`. A step on a batch is one distributed pass: every task sums the gradient of
its rows per feature it has seen, sums are combined by feature, and the driver moves those weights. What reaches the driver is
a row for each feature that occurs, never more than `dims`, whatever the batch. Step sizes follow each feature's own history
(AdaGrad), so early and late batches count alike, and a batch can come at any time: the state is weights, squared-gradient
sums and the number of the last batch, written to a folder and read again.

Batches are DataFrames of training rows, from `learn` in a loop or from a stream through `learn_from_batches`, where a batch
that is repeated after a failure is recognised by its number and not learnt twice.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import LABELS
from ..ship import ship
from ..storage import written
from .classify import feature_stages, training_text
from .tree import entries as _entries

RATE, REG, PASSES = 0.5, 1e-6, 5


class OnlineModel:
    """weights and squared-gradient sums: a row for each class, a column for each hashed feature and one for the constant."""

    def __init__(self, dims: int = 2 ** 20, rate: float = RATE, reg: float = REG, passes: int = PASSES):
        self.dims, self.rate, self.reg, self.passes, self.batch = dims, rate, reg, passes, -1
        self.weights = np.zeros((len(LABELS), dims + 1))
        self.squares = np.zeros((len(LABELS), dims + 1))

    def step(self, places, gradient):
        """Move the weights of the given features along the mean gradient (a column for each of them)."""
        g = gradient + self.reg * self.weights[:, places]
        self.squares[:, places] += g ** 2
        self.weights[:, places] -= self.rate * g / (np.sqrt(self.squares[:, places]) + 1e-8)

    def save(self, spark: SparkSession, path: str) -> None:
        """Features that have moved, a row each; folders are named by batch, so the one before stays until this is whole."""
        used = np.flatnonzero(self.squares.any(axis=0))
        table = pa.table({"place": pa.array(used, pa.int32()),
                          "weights": pa.array(self.weights[:, used].T.tolist(), pa.list_(pa.float64())),
                          "squares": pa.array(self.squares[:, used].T.tolist(), pa.list_(pa.float64()))})
        folder = f"{path}/batch={self.batch:012d}"
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{folder}/features")
        spark.createDataFrame([(self.dims, self.rate, self.reg, self.passes)], "dims int, rate double, reg double, passes int").write.mode(
            "overwrite").parquet(f"{folder}/settings")  # written last: a folder without it does not count

    @staticmethod
    def load(spark: SparkSession, path: str):
        """The state after the last whole batch, or None."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        found = place.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(place, "batch=*/settings/_SUCCESS"))
        names = sorted(f.getPath().getParent().getParent().toString() for f in found or [])
        if not names:
            return None
        s = spark.read.parquet(f"{names[-1]}/settings").first()
        model = OnlineModel(s.dims, s.rate, s.reg, s.passes)
        model.batch = int(names[-1].rsplit("=", 1)[1])
        t = spark.read.parquet(f"{names[-1]}/features").toArrow()
        places = t.column("place").to_numpy()
        for name in ("weights", "squares"):
            getattr(model, name)[:, places] = np.array(t.column(name).to_pylist(), float).reshape(-1, len(LABELS)).T
        return model


def _probabilities(weights, row, place, value, n):
    """One-vs-rest probabilities of n vectors given by entries; the last weight of a class is its constant."""
    scores = np.stack([np.bincount(row, weights=value * w[place], minlength=n) + w[-1] for w in weights])
    return 1 / (1 + np.exp(-np.clip(scores, -50, 50)))


def _gradient(vectors: DataFrame, model: OnlineModel):
    """(places, mean gradient by class, rows) over (features, label)."""
    shared = vectors.sparkSession.sparkContext.broadcast(model.weights)  # as many numbers as dims and classes
    dims, classes = model.dims, len(LABELS)
    index = {c: i for i, c in enumerate(LABELS)}
    schema = pa.schema([("place", pa.int32())] + [(f"g{i}", pa.float64()) for i in range(classes)])

    def run(batches):
        weights, total, seen = shared.value, np.zeros((classes, dims + 1)), np.zeros(dims + 1, bool)
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row, place, value = _entries(batch.column("features"))
            label = np.array([index[c] for c in batch.column("label").to_pylist()])
            p = _probabilities(weights, row, place, value, batch.num_rows)
            error = p - (label == np.arange(classes)[:, None])
            for i in range(classes):
                total[i] += np.bincount(place, weights=value * error[i][row], minlength=dims + 1)
                total[i, -1] += error[i].sum()
            seen[place] = True
            rows += batch.num_rows
        if rows:
            at = np.append(np.flatnonzero(seen[:-1]), dims)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(t[at]) for t in total]], schema=schema)
            # The number of rows travels as a place of its own.
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[pa.array([float(rows)])] * classes], schema=schema)

    ddl = "place int, " + ", ".join(f"g{i} double" for i in range(classes))
    sums = vectors.mapInArrow(run, ddl).groupBy("place").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(classes)]).toArrow()
    places = sums.column("place").to_numpy()
    g = np.stack([sums.column(f"g{i}").to_numpy() for i in range(classes)])
    rows = g[0][places < 0].sum()
    kept = places >= 0
    return places[kept], g[:, kept] / max(rows, 1), int(rows)


def learn(model: OnlineModel, rows: DataFrame, batch: int = None) -> OnlineModel:
    """Learn one batch of training rows (text, label, …), in `passes` steps over the whole batch."""
    ship(rows.sparkSession)
    texts = training_text(rows).where(F.col("label").isin(*LABELS)).select("text", "label")
    vectors = written(Pipeline(stages=feature_stages(model.dims)).fit(texts).transform(texts).select("features", "label"), "batch")
    for _ in range(model.passes):
        places, gradient, n = _gradient(vectors, model)
        if n:
            model.step(places, gradient)
    model.batch = model.batch + 1 if batch is None else batch
    return model


def learn_in_batches(rows: DataFrame, batches: int, model: OnlineModel = None) -> OnlineModel:
    """Deal the rows to so many batches by hash and learn them one after the other."""
    model = model or OnlineModel()
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(batches))
    dealt = written(rows.withColumn("_batch", part), "dealt")
    for i in range(batches):
        learn(model, dealt.where(F.col("_batch") == i).drop("_batch"))
    return model


def learn_from_batches(path: str, dims: int = 2 ** 20, **settings):
    """foreachBatch body: goes on from the state under `path` and writes it again; a batch learnt before is passed over."""
    def run(rows: DataFrame, batch_id: int) -> None:
        model = OnlineModel.load(rows.sparkSession, path) or OnlineModel(dims, **settings)
        if batch_id > model.batch:
            learn(model, rows, batch_id).save(rows.sparkSession, path)
    return run


def predict(rows: DataFrame, model: OnlineModel) -> DataFrame:
    """Adds predicted_label and confidence (the class probabilities scaled to one) to rows with a text column."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)
    names = np.array(LABELS, dtype=object)
    kind = pa.struct([("label", pa.string()), ("p", pa.float64())])

    def run(vectors: pa.Array) -> pa.Array:
        p = _probabilities(shared.value, *_entries(vectors), len(vectors))
        p = p / p.sum(axis=0)
        return pa.StructArray.from_arrays([pa.array(names[p.argmax(axis=0)], pa.string()), pa.array(p.max(axis=0))], fields=list(kind))

    vectors = Pipeline(stages=feature_stages(model.dims)).fit(rows).transform(rows).select(*rows.columns, "features")
    out = vectors.withColumn("_p", F.arrow_udf(run, "struct<label: string, p: double>")("features"))
    return out.select(*rows.columns, F.col("_p.label").alias("predicted_label"), F.col("_p.p").alias("confidence"))
