"""Known values of small inputs, inverses, and agreement with numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import scalars
from tallyfold.operators import arrays, estimators, metrics, prep, stats
from tallyfold.operators.networks import Adam, EarlyStopping, RMSprop, SGD, Sequential, clipped
from tallyfold.sources import matrices


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first()[0]


def test_standard_scaler(spark):
    df = frame(spark, [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0), (7.0, 8.0, 9.0), (10.0, 11.0, 12.0)], "a double, b double, c double")
    m = prep.StandardScaler.fit(df, ["a", "b", "c"])
    assert m.mean == (5.5, 6.5, 7.5) and m.std[0] == pytest.approx(3.354101966249685)
    back = m.inverse(m.transform(df)).collect()
    assert np.allclose(np.array(back), np.array(df.collect()))
    assert prep.StandardScaler.fit(df.select(F.lit(3.0).alias("a")), ["a"]).std == (1.0,)


def test_encoders(spark):
    df = frame(spark, [("cat",), ("dog",), ("bird",), ("cat",), ("dog",)], "c string")
    m = prep.LabelEncoder.fit(df, "c")
    assert m.classes == ("bird", "cat", "dog")
    assert [r["code"] for r in m.transform(df).collect()] == [1, 2, 0, 1, 2]
    with pytest.raises(Exception, match="unknown category"):
        m.transform(frame(spark, [("cow",)], "c string")).collect()
    hot = prep.OneHotEncoder.fit(df, "c").transform(df).first()
    assert (hot["c_bird"], hot["c_cat"], hot["c_dog"]) == (0.0, 1.0, 0.0)


def test_splits(spark):
    df = spark.range(10)
    assert sorted(r["id"] for r in prep.split(df, "id", 0.3).where("is_test").collect()) == [7, 8, 9]
    assert prep.split(df, "id", 0.25, 7).where("is_test").count() == 2
    with pytest.raises(ValueError):
        prep.split(df, "id", 1.5)
    two = df.withColumn("y", F.pmod("id", F.lit(2)))
    assert {tuple(r) for r in prep.stratified(two, "id", "y", 0.2).where("is_test").groupBy("y").count().collect()} == {(0, 1), (1, 1)}
    parts = dict(prep.three_way(spark.range(100), "id", 0.2, 0.1).groupBy("part").count().collect())
    assert parts == {"train": 70, "test": 20, "val": 10}


def test_classification(spark):
    m = frame(spark, [(0, 0), (1, 1), (2, 1), (0, 1), (1, 1), (2, 2)], "y int, p int")
    assert {tuple(r) for r in metrics.confusion(m, "y", "p").collect()} == {(0, 0, 1), (0, 1, 1), (1, 1, 2), (2, 1, 1), (2, 2, 1)}
    h = metrics.headline(frame(spark, [(1, 1), (0, 1), (1, 1), (0, 0)], "y int, p int"), "y", "p").first()
    assert h["precision"] == pytest.approx(2 / 3)
    s = frame(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert one(metrics.auc(s, "y", "s")) == 0.75
    assert metrics.roc(s, "y", "s").where("threshold = double('inf')").select("tpr", "fpr").first() == (0.0, 0.0)


def test_regression(spark):
    def of(pairs):
        return metrics.regression(frame(spark, [(float(a), float(b)) for a, b in pairs], "y double, p double"), "y", "p").first()

    assert of([(1, 2.5), (2, 2.5), (3, 2.5), (4, 2.5)])["r2"] == pytest.approx(0)
    assert of([(1, 4), (2, 3), (3, 2), (4, 1)])["r2"] == pytest.approx(-3)
    assert of([(5, 4), (5, 5)])["r2"] == 1
    assert of([(1, 1.1), (2, 1.8), (4, 4.4)])["mape"] == pytest.approx(10)
    assert of([(1, 1.5), (2, 2), (3, 2.5), (4, 3.5)])["explained_variance"] == pytest.approx(0.85)
    assert [r["value"] for r in stats.percentiles(frame(spark, [(float(i),) for i in range(1, 9)], "v double"), "v", [25, 50, 75]).orderBy("k").collect()] == [2.75, 4.5, 6.25]


def test_clustering_metrics(spark):
    df = frame(spark, [(0, 0.0, 0.0, 0), (1, 1.0, 1.0, 0), (2, 5.0, 5.0, 1), (3, 6.0, 6.0, 1)], "id long, a double, b double, label int")
    assert one(metrics.inertia(df, ["a", "b"], "label")) == pytest.approx(2.0)
    assert one(metrics.silhouette(df, "id", ["a", "b"], "label")) > 0.7
    assert one(metrics.calinski_harabasz(df, ["a", "b"], "label")) == pytest.approx(50.0)
    assert metrics.band(0.8) == "strong" and metrics.gap(0.9, 0.5) == "overfit"


def test_cleaning_and_quality(spark):
    df = frame(spark, [(1.0,), (3.0,), (math.nan,), (math.inf,)], "v double")
    assert [r[0] for r in stats.clean(df, ["v"], "mean").collect()] == [1.0, 3.0, 2.0, 2.0]
    assert [r[0] for r in stats.clean(df, ["v"], "clamp").collect()] == [1.0, 3.0, 0.0, 1e6]
    with pytest.raises(ValueError):
        stats.clean(df, ["v"], "other")
    with pytest.raises(Exception, match="not finite"):
        stats.check_finite(df, ["v"]).collect()
    assert one(arrays.gini(frame(spark, [(0,), (0,), (1,), (1,)], "y int"), "y")) == 0.5


def test_scalars(spark):
    df = frame(spark, [(-4.0, 0.0), (math.nan, -1e-12)], "x double, y double")
    got = df.select(scalars.safe_sqrt(F.col("x")), scalars.safe_div(F.lit(1.0), F.col("y")), scalars.clamp(F.col("x"), -1.0, 1.0), scalars.round_to(F.lit(-2.5), 0)).collect()
    assert got[0] == (0.0, 1e8, -1.0, -3.0) and got[1][1] == -1e8 and math.isnan(got[1][2])
    known = scalars.Activations()
    known.register("double", lambda x: 2 * x, lambda x: F.lit(2.0))
    assert one(spark.range(1).select(known.apply("double", F.lit(4.0)))) == 8.0
    with pytest.raises(KeyError):
        known.get("none")


def test_matrices(spark, tmp_path):
    a = matrices.from_rows(spark, [[1, 2], [3, 4]])
    c = matrices.to_coo(a)
    assert {tuple(r) for r in arrays.matmul(c, c).collect()} == {(0, 0, 7.0), (0, 1, 10.0), (1, 0, 15.0), (1, 1, 22.0)}
    assert one(arrays.equal(a, matrices.from_coo(c))) is True
    assert one(arrays.equal(a, arrays.scalar(a, "add", 1))) is False
    with pytest.raises(ValueError):
        matrices.from_rows(spark, [[1], [1, 2]])
    with pytest.raises(ZeroDivisionError):
        arrays.scalar(a, "div", 0)
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n3,x\n")
    with pytest.raises(Exception):
        matrices.read_csv(spark, str(path), ["a", "b"]).collect()
    matrices.Settings(seed=3).save(str(tmp_path / "s.json"))
    assert matrices.Settings.load(str(tmp_path / "s.json")).seed == 3


def test_estimators(spark):
    rows = [(i, *p) for i, p in enumerate([(1.0, 1.0), (1.5, 2.0), (3.0, 4.0), (5.0, 7.0), (3.5, 5.0), (4.5, 5.0), (3.5, 4.5), (2.0, 2.0), (1.0, 2.0)])]
    df = frame(spark, rows, "id long, a double, b double")
    m = estimators.KMeans(2).fit(df, ["a", "b"])
    assert m.inertia > 0 and {r["cluster"] for r in m.predict(df).collect()} == {0, 1}
    line = frame(spark, [(float(i), 2.0 * i + 1) for i in range(1, 6)], "x double, y double")
    fit = estimators.LinearRegression().fit(line, ["x"], "y")
    assert fit.intercept == pytest.approx(1) and fit.weights[0] == pytest.approx(2)
    p = estimators.PCA().fit(df, ["a", "b"])
    assert p.ratio.sum() == pytest.approx(1)
    back = p.inverse(p.transform(df).drop("a", "b")).orderBy("id").select("a", "b").collect()
    assert np.allclose(np.array(back), np.array([r[1:] for r in rows]))
    two = [(x + 0.1 * k, y + 0.1 * k, c) for c, (x, y) in enumerate([(0.0, 0.0), (2.0, 2.0), (-2.0, 2.0)]) for k in range(6)]
    labelled = frame(spark, two, "a double, b double, y int").repartition(2)
    for model in (estimators.LogisticRegression(rate=0.5, max_iter=40), estimators.RandomForest(n_trees=10, max_depth=5)):
        out = model.fit(labelled, ["a", "b"], "y").predict(labelled)
        assert out.where("prediction = y").count() >= 17


def test_density_clusters(spark):
    points = [(0.1 * k, 0.0) for k in range(4)] + [(5 + 0.1 * k, 5.0) for k in range(4)] + [(10.0, 10.0), (0.0, 10.0)]
    df = frame(spark, [(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    got = {r["id"]: r["label"] for r in estimators.dbscan(df, "id", ["x", "y"], 0.5, 3).collect()}
    assert [got[i] for i in range(10)] == [0] * 4 + [1] * 4 + [-1, -1]


def test_network(spark, tmp_path):
    rng = np.random.default_rng(0)
    net = Sequential([(3, "tanh"), (1, "sigmoid")], "bce").build(2)
    x, y = rng.normal(size=(5, 2)), rng.integers(0, 2, (5, 1)).astype(float)
    _, g = net.gradients(x, y, net.weights)
    w = dict(net.weights)
    w["w0"] = w["w0"].copy()
    w["w0"][0, 1] += 1e-6
    assert (net.gradients(x, y, w)[0] - net.gradients(x, y, net.weights)[0]) / 1e-6 == pytest.approx(g["w0"][0, 1], rel=1e-3)
    xor = frame(spark, [(0.0, 0.0, 0.0), (0.0, 1.0, 1.0), (1.0, 0.0, 1.0), (1.0, 1.0, 0.0)], "a double, b double, y double").coalesce(1)
    net = Sequential([(8, "tanh"), (1, "sigmoid")], "bce", seed=1).fit(xor, ["a", "b"], ["y"], epochs=60, optimizer=Adam(0.2))
    assert net.history[-1] < 0.2 * net.history[0]
    net.save(spark, str(tmp_path / "w"))
    other = Sequential(net.layers, "bce").load(spark, str(tmp_path / "w"))
    assert all(np.allclose(net.weights[k], other.weights[k]) for k in net.weights)
    g = {"w": np.array([3.0, 4.0])}
    assert np.linalg.norm(clipped(g, 1.0)["w"]) == pytest.approx(1)
    for o in (SGD(0.1, 0.9, True), RMSprop(0.1, centred=True), Adam(0.1, amsgrad=True)):
        assert o.step("w", np.array([1.0]), np.array([2.0]))[0] < 1
    stop = EarlyStopping(patience=2)
    assert [stop(v) for v in (1.0, 1.0, 1.0)] == [False, False, True]


def test_streaming(spark, tmp_path):
    from tallyfold.streaming.drift import drift, score

    src = str(tmp_path / "in")
    spark.createDataFrame([(f"2024-01-01 0{h}:{m}0:00", float(h)) for h in (1, 2) for m in (1, 2)], "ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, value double").parquet(src)
    q = drift(stream, "ts", "value").writeStream.outputMode("complete").format("memory").queryName("drift").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("drift").count() == 2
    score(stream, lambda df: df.withColumn("p", F.col("value") * 2), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("p")).first()[0] == 12.0
