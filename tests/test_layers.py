"""Layers and what surrounds a fit, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import layers, training
from tallyfold.operators.networks import Sequential


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "row_id long, values array<double>").repartition(3)


def values(df):
    return np.array([r["values"] for r in df.orderBy("row_id").collect()])


def test_normalisation(spark):
    x = np.random.default_rng(1).normal(3, 2, (20, 5))
    a = frame(spark, x)
    n = layers.BatchNorm().fit(a)
    assert np.allclose(values(n.transform(a)), (x - x.mean(0)) / np.sqrt(x.var(0) + 1e-5))
    assert np.allclose(values(layers.layer_norm(a, 2, 1)), 2 * (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) + 1)
    n.fit(frame(spark, x + 10))
    assert np.allclose(n.mean, x.mean(0) + 1)


def test_dropout(spark):
    x = np.ones((200, 10))
    a = frame(spark, x)
    y = values(layers.dropout(a, 0.4))
    assert set(np.round(np.unique(y), 6)) == {0.0, round(1 / 0.6, 6)} and abs((y == 0).mean() - 0.4) < 0.05
    assert (values(layers.dropout(a.repartition(7), 0.4)) == y).all()
    assert (values(layers.dropout(a, 0.4, training=False)) == x).all()
    with pytest.raises(ValueError):
        layers.dropout(a, 1.0)


def test_pools_and_convolution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 30))
    a = frame(spark, x)
    assert np.allclose(values(layers.max_pool(a, 4)), x[:, :28].reshape(4, 7, 4).max(2))
    assert layers.max_pool(frame(spark, x[:, :3]), 4).where(F.size("values") > 0).count() == 0
    want = [[max(r[y * 6 + i] for y in (2 * p, 2 * p + 1) for i in (2 * q, 2 * q + 1)) for p in range(2) for q in range(3)] for r in x]
    assert np.allclose(values(layers.max_pool2d(a, 5, 6)), want)
    x, k, b = rng.normal(size=(3, 2 * 5 * 4)), rng.normal(size=(3, 2, 3, 3)), rng.normal(size=3)
    image = np.pad(x.reshape(3, 2, 5, 4), ((0, 0), (0, 0), (1, 1), (1, 1)))
    want = [[(image[n, :, y : y + 3, z : z + 3] * k[f]).sum() + b[f] for f in range(3) for y in (0, 2, 4) for z in (0, 2)] for n in range(3)]
    assert np.allclose(values(layers.conv2d(frame(spark, x), k, b, 5, 4, stride=2, pad=1)), want)


def sig(z):
    return 1 / (1 + math.exp(-z))


def test_recurrent(spark):
    x, n = np.random.default_rng(3).normal(size=(3, 4 * 2)), 3
    p = layers.gates(n, 2, 4)
    want = []
    for row in x.reshape(3, 4, 2):
        h, c = [0.0] * n, [0.0] * n
        for v in row:
            z = [sum(v[i] * p["w"][i, k] for i in range(2)) + sum(h[i] * p["u"][i, k] for i in range(n)) for k in range(4 * n)]
            c = [sig(z[n + k]) * c[k] + sig(z[k]) * math.tanh(z[2 * n + k]) for k in range(n)]
            h = [sig(z[3 * n + k]) * math.tanh(c[k]) for k in range(n)]
        want.append(h)
    assert np.allclose(values(layers.recurrent(frame(spark, x), 4, p)), want)
    p, want = layers.gates(n, 2, 3), []
    for row in x.reshape(3, 4, 2):
        h = [0.0] * n
        for v in row:
            g = [sum(v[i] * p["w"][i, k] for i in range(2)) for k in range(3 * n)]
            z = [sig(g[k] + sum(h[i] * p["u"][i, k] for i in range(n))) for k in range(n)]
            r = [sig(g[n + k] + sum(h[i] * p["u"][i, n + k] for i in range(n))) for k in range(n)]
            new = [math.tanh(g[2 * n + k] + sum(r[i] * h[i] * p["u"][i, 2 * n + k] for i in range(n))) for k in range(n)]
            h = [(1 - z[k]) * new[k] + z[k] * h[k] for k in range(n)]
        want.append(h)
    assert np.allclose(values(layers.recurrent(frame(spark, x), 4, p, "gru")), want)


def test_attention(spark):
    x, p = np.random.default_rng(4).normal(size=(2, 3, 4)), layers.transformer_weights(4, 6)
    want = np.zeros_like(x)
    for n in range(2):
        q, k, v = (x[n] @ p[w] for w in "qkv")
        for h in (slice(0, 2), slice(2, 4)):
            for s in range(3):
                e = [math.exp(q[s, h] @ k[t, h] / math.sqrt(2)) for t in range(3)]
                want[n, s, h] = sum(w * v[t, h] for t, w in enumerate(e)) / sum(e)
    assert np.allclose(layers.attention(x, p, 2), want @ p["o"])
    out = values(layers.transformer(frame(spark, x.reshape(2, 12)), 3, [p, p], 2)).reshape(2, 3, 4)
    assert np.allclose(out.mean(-1), 0) and np.allclose(out.std(-1), 1, atol=1e-3)


def test_initial():
    assert (layers.initial((2, 3), "zeros") == 0).all()
    assert abs(layers.initial((100, 100), "he_normal").std() - math.sqrt(0.02)) < 0.005
    assert np.abs(layers.initial((100, 100), "other")).max() <= math.sqrt(0.03) + 1e-9


def test_gradient_control():
    assert [training.cosine_rate(1, e, 10) for e in (0, 5, 10)] == pytest.approx([1, 0.5, 0])
    g = {"w": np.array([[-5.0, 1.0]])}
    assert training.clip_value(g, 2)["w"].tolist() == [[-2.0, 1.0]]
    assert training.clip_percentile(g, 50)["w"].tolist() == [[-3.0, 1.0]]
    with pytest.raises(ValueError):
        training.check_gradients(g, {"w": np.array([[1.0, np.nan]])})
    acc = training.Accumulator(2)
    assert acc.add(g) is None and acc.add({"w": g["w"] * 3})["w"].tolist() == [[-10.0, 2.0]]
    s = training.LossScaler(4.0, every=2)
    assert s.unscaled({"w": np.array([np.inf])}) is None and s.scale == 2
    assert s.unscaled(g)["w"].tolist() == [[-2.5, 0.5]] and s.unscaled(g) and s.scale == 4


def test_callbacks(spark, tmp_path):
    losses = [3.0, 2.0, 2.5, 2.4, 1.0]
    history, saved = training.History(), []
    calls = [history, training.Stopping(patience=2), training.Checkpoint(saved.append, "p"), training.Progress(5)]
    assert training.train(lambda e: {"loss": losses[e]}, 5, calls) == 4
    assert saved == ["p", "p"] and [r["value"] for r in history.table(spark).orderBy("epoch").collect()] == losses[:4]
    with pytest.raises(ValueError):
        training.Stopping("val_loss").epoch_end(0, {"loss": 1.0})
    assert training.train(lambda e: {"accuracy": losses[e]}, 5, [training.Stopping("accuracy", "max", patience=3)]) == 4
    model = Sequential([(2, "relu"), (1, "linear")]).build(3)
    assert {r["name"]: r["parameters"] for r in training.model_summary(spark, model.weights).collect()} == {"w0": 6, "b0": 2, "w1": 2, "b1": 1}


def test_evaluate_and_search(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.1)], "y int, p double")
    r = training.evaluate(df, "y", "p").first()
    assert (r["accuracy"], r["mae"]) == pytest.approx((2 / 3, (0.1 + 0.2 + 0.9) / 3))
    assert tuple(training.evaluate(df.limit(0), "y", "p").first()) == (0, 0, 0, 0)
    best, score, tried = training.random_search({"a": [1, 2, 3], "b": [0.5]}, 30, lambda c: c["a"] * c["b"])
    assert best == {"a": 3, "b": 0.5} and score == 1.5 and len(tried) == 30


def test_augmentations(spark):
    x = np.arange(60.0).reshape(10, 6)
    a = frame(spark, x)
    assert (values(training.flip(3, 1.0)(a)) == x.reshape(10, 2, 3)[:, :, ::-1].reshape(10, 6)).all()
    assert (values(training.flip(3, 0.0)(a)) == x).all()
    assert (values(training.rotate(2, 3, 0.0)(a)) == x).all()
    n = values(layers.chain(frame(spark, np.zeros((300, 4))), training.noise(2.0)))
    assert abs(n.mean()) < 0.25 and abs(n.std() - 2) < 0.2


def test_recovery(spark):
    seen = []

    def fails(kind, times):
        def call():
            seen.append(1)
            if len(seen) <= times:
                raise kind("x")
            return 7

        return call

    assert training.retried(fails(OSError, 2), wait=0) == 7 and len(seen) == 3
    seen.clear()
    with pytest.raises(ValueError):
        training.retried(fails(ValueError, 2), wait=0)
    assert len(seen) == 1
    breaker = training.Breaker(least=2)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker(lambda: 1 / 0)
    with pytest.raises(training.EngineError):
        breaker(lambda: 1)
    p = training.Profiler()
    assert p.run("a", lambda: 1) == 1 and p.table(spark).first()["calls"] == 1
