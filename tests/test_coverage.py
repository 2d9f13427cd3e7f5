"""Checks, mini-batches, validation, votes and bands on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import checks, estimators, metrics
from tallyfold.operators.networks import SGD, Adam, RMSprop, Sequential
from tallyfold.operators.prep import Loader, SplitOptions, train_test_split
from tallyfold.sources import matrices


def test_checks(spark):
    a = matrices.from_rows(spark, [[1, 2], [3, 4]])
    assert checks.shape(a) == (2, 2) and checks.is_square(a) and not checks.is_vector(a) and not checks.is_empty(a)
    assert checks.check_input(a, 2) == (2, 2)
    checks.check_dimensions((2, 3), (3, 4), "mul")
    checks.check_dimensions((2, 3), (9, 9), "anything")
    checks.check_state("fit", True, False)
    checks.check_training({"rate": 0.1, "epochs": 3, "beta1": 0.9, "other": "x"})
    bad = [
        lambda: checks.check_input(a, 3), lambda: checks.check_input(None), lambda: checks.check_dimensions((2, 3), (2, 4), "add"), lambda: checks.check_dimensions((2, 3), (2, 3), "mul"),
        lambda: checks.check_vector(a), lambda: checks.check_scalar(float("nan")), lambda: checks.check_between(2, 0, 1), lambda: checks.check_positive(0), lambda: checks.check_not_negative(-1),
        lambda: checks.check_whole(1.5, 0, 2), lambda: checks.check_one_of("x", ["y"]), lambda: checks.check_not_empty([]), lambda: checks.check_state("predict", True, False),
        lambda: checks.check_not_fitted(True), lambda: checks.check_training({"epochs": 0}), lambda: checks.check_memory([(20_000, 20_000)], "mul"), lambda: SGD(-1), lambda: RMSprop(rho=1),
        lambda: SplitOptions(train_size=1.0).check(9), lambda: SplitOptions(stratify="y").check(3),
    ]
    for f in bad:
        with pytest.raises(ValueError):
            f()


def test_batches_and_validation(spark):
    df = spark.createDataFrame([(k, k / 20, 2.0 * k / 20 + 1) for k in range(20)], "id long, x double, y double")
    seen = []

    class Watch:
        def __getattr__(self, name):
            return lambda *a: seen.append((name, *a)) and None

    net = Sequential([]).add(1, "linear").compile(SGD(0.1), "mse")
    net.weights = {"w0": np.zeros((1, 1)), "b0": np.zeros(1)}
    net.fit(df, ["x"], ["y"], epochs=2, key="id", batch_size=8, validation=0.2, callbacks=(Watch(),))
    w, b = 0.0, 0.0
    for _ in range(2):
        for part in (range(8), range(8, 16)):
            x = np.array([k / 20 for k in part])
            d = w * x + b - (2 * x + 1)
            w, b = w - 0.1 * (d * x).mean(), b - 0.1 * d.mean()
    assert net.weights["w0"][0, 0] == pytest.approx(w) and net.weights["b0"][0] == pytest.approx(b)
    x = np.arange(16, 20) / 20
    assert net.val_history[-1] == pytest.approx(((w * x + b - 2 * x - 1) ** 2).mean() / 2)
    assert [s[0] for s in seen].count("batch_end") == 4
    assert [p.count() for p in Loader(df, "id", 8, seed=1)] == [8, 8, 4]
    train, test = train_test_split(df, "id", SplitOptions(test_size=0.25, shuffle=False))
    assert sorted(r["id"] for r in test.collect()) == [15, 16, 17, 18, 19] and train.count() == 15


def test_optimizers_with_momentum_and_apart_decay():
    w, g = np.array([2.0]), np.array([0.5])
    a = Adam(0.1, decay=0.1, decoupled=True)
    assert a.step("w", w, g)[0] == pytest.approx(2 - 0.1 * 0.5 / (0.5 + 1e-8) - 0.1 * 0.1 * 2)
    r = RMSprop(0.1, rho=0.5, momentum=0.9)
    first = r.step("w", w, g)
    v1 = 0.5 / (np.sqrt(0.125) + 1e-8)
    assert first[0] == pytest.approx(2 - 0.1 * v1)
    v2 = 0.9 * v1 + 0.5 / (np.sqrt(0.5 * 0.125 + 0.125) + 1e-8)
    assert r.step("w", first, g)[0] == pytest.approx(first[0] - 0.1 * v2)


def test_votes_and_bands(spark):
    df = spark.createDataFrame([(k, float(k % 2), float(k), k % 2) for k in range(40)], "id long, a double, b double, y int")
    m = estimators.RandomForest(n_trees=5, max_depth=3).fit(df, ["a", "b"], "y")
    p = m.probabilities(df.select("id", "a", "b")).collect()
    assert all(abs(r["p_0"] + r["p_1"] - 1) < 1e-9 for r in p) and m.score(df, "y").first()[0] > 0.9
    assert metrics.band(0.6) == "reasonable" and metrics.calinski_band(120) == "strong" and metrics.davies_band(0.4) == "excellent"
    one = df.withColumn("z", F.lit(1))
    assert metrics.auc(one, "z", "b").first()[0] == 0 and metrics.calinski_harabasz(one, ["b"], "z").first()[0] == 0
    assert metrics.roc(one, "z", "b").agg(F.max("fpr")).first()[0] == 0
