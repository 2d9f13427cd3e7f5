"""Density clusters by cells and of copies, pairs by blocks, silhouettes by blocks, labels of a fit, signs of zeros."""

import math
import time
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import arrays, estimators, metrics, pairs
from tallyfold.plans import registry

BIG = "/root/testdata/sf0.1"


def brute_clusters(x: np.ndarray, eps: float, least: int) -> list[tuple[int, bool]]:
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core, root = near.sum(1) >= least, np.arange(len(x))
    while True:
        after = np.array([min(root[near[k] & core]) if core[k] else k for k in range(len(x))])
        if (after == root).all():
            break
        root = after
    number = {r: k for k, r in enumerate(sorted(set(root[core])))}
    label = [number[root[k]] if core[k] else min((number[r] for r in root[near[k] & core]), default=-1) for k in range(len(x))]
    return [(int(a), bool(b)) for a, b in zip(label, core, strict=True)]


def clusters(spark, x: np.ndarray, eps: float, least: int) -> list[tuple[int, bool]]:
    names = [f"f{k}" for k in range(x.shape[1])]
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names))
    return [(r["label"], r["is_core"]) for r in estimators.dbscan(df, "id", names, eps, least).orderBy("id").collect()]


@pytest.fixture
def sizes(monkeypatch):
    """Rows of each table that the clusters wrote."""
    out = []

    def spy(df, put=estimators.written):
        found = put(df)
        out.append(found.count())
        return found

    monkeypatch.setattr(estimators, "written", spy)
    return out


def test_density_clusters_write_no_pairs_of_a_crowd(spark, sizes):
    x = np.random.default_rng(1).uniform(0, 1, (400, 2)).round(3) * [0.6, 0.6]
    assert set(clusters(spark, x, 1.0, 4)) == {(0, True)}
    assert max(sizes) <= 2 * len(x)  # 160,000 pairs are within eps


@pytest.mark.parametrize(("width", "eps", "least", "spread"), [(1, 0.02, 3, 10.0), (2, 0.5, 4, 10.0), (3, 1.0, 5, 8.0), (2, 0.5, 4, 1e8)])
def test_density_clusters_by_cells_equal_brute_force(spark, width, eps, least, spread):
    rng = np.random.default_rng(width)
    x = rng.uniform(-spread, spread, (240, width)) if spread < 1e8 else spread + rng.uniform(-8, 8, (240, width))
    x = np.concatenate([x, x[:20], np.zeros((5, width)), -np.zeros((2, width))])
    assert clusters(spark, x, eps, least) == brute_clusters(x, eps, least)


def test_density_clusters_of_a_chain_in_any_order(spark):
    order = np.random.default_rng(3).permutation(160)
    x = np.stack([order * 1.0, np.zeros(160)], 1)
    assert set(clusters(spark, x, 1.0, 2)) == {(0, True)}


def test_touching():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x, y = rng.uniform(0, 1, (300, 2)), rng.uniform(0, 1, (400, 2)) + [rng.uniform(0.9, 1.3), 0]
        eps = float(rng.uniform(0.001, 0.3))
        assert pairs.touching(x, y, eps) == bool((np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)) <= eps).any())


def test_silhouette_by_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6)) + 100
    label = rng.integers(-1, 4, 700)
    x[:40], label[:20], label[20:40], label[699] = x[0], 0, 1, 9
    names = [f"f{k}" for k in range(6)]
    df = spark.createDataFrame([(k, int(c), *map(float, v)) for k, (c, v) in enumerate(zip(label, x, strict=True))], "id long, label int, " + ", ".join(f"{n} double" for n in names))
    own, c = x[label >= 0], label[label >= 0]
    d = np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1))
    a = np.array([d[k, c == v].sum() / max((c == v).sum() - 1, 1) for k, v in enumerate(c)])
    b = np.array([min(d[k, c == o].mean() for o in set(c) if o != v) for k, v in enumerate(c)])
    for blocks in (None, 1, 5):
        got = metrics.silhouette(df, "id", names, "label", blocks)
        assert got.first()[0] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-9)
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # not a row a pair
    same = df.select("id", (F.col("id") % 2).alias("label"), *(F.lit(0.1).alias(n) for n in names))
    assert metrics.silhouette(same, "id", names, "label").first()[0] == 0
    assert metrics.silhouette(df.withColumn("label", F.lit(0)), "id", names, "label").first()[0] is None
    assert metrics.silhouette(df.where("id < 0"), "id", names, "label").first()[0] is None


def test_wide_density_clusters_keep_copies_together(spark, sizes):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 8))
    x = np.concatenate([x, np.repeat(x[:1], 300, 0)])
    assert clusters(spark, x, 2.2, 4) == brute_clusters(x, 2.2, 4)
    assert max(sizes) < 300 * 300  # pairs of the copies


def test_range_pairs_by_blocks(spark):
    rng = np.random.default_rng(7)
    for x, eps in ((rng.normal(size=(600, 16)), 4.0), (rng.normal(size=(600, 16)) + 1e6, 4.0), (rng.integers(0, 3, (600, 12)) * 1.0, 3.0), (np.full((3, 4), 1e200), 1.0)):
        near = np.zeros((len(x), len(x)))
        for k in range(x.shape[1]):
            near += (x[:, None, k] - x[None, :, k]) ** 2
        df = spark.createDataFrame([(str(k), list(map(float, v))) for k, v in enumerate(x)], "row_id string, values array<double>")
        want = {(str(a), str(b)) for a, b in zip(*np.nonzero(np.sqrt(near) <= eps), strict=True)}
        for blocks in (1, 3):
            got = [tuple(r) for r in pairs.range_pairs(df, eps, len(x), blocks).collect()]
            assert len(got) == len(want) and set(got) == want
    odd = [(0, [0.0] * 4), (1, [0.0] * 3), (2, [0.0, 0.0, 0.0, None]), (3, [math.nan] * 4), (4, None), (5, [0.0] * 4), (6, []), (7, [math.inf] * 4)]
    got = pairs.range_pairs(spark.createDataFrame(odd, "row_id long, values array<double>"), 1.0, 8, 2)
    assert {tuple(r) for r in got.collect()} == {(0, 0), (5, 5), (0, 5), (5, 0), (1, 1), (6, 6)}


def test_range_join_of_cells_that_part_little_goes_by_blocks(spark):
    x = np.random.default_rng(8).normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    wide = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "row_id long, values array<double>")
    plan = lambda df: arrays.range_join_wide(df, 1.1)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan(wide)
    assert "MapInArrow" not in plan(wide.select("row_id", F.transform("values", lambda v: v * 1000).alias("values")))


def test_labels_of_a_fit_that_runs_out_of_iterations(spark):
    """At sf0.1 the centres still move in the 20th iteration."""
    if not Path(BIG).is_dir():
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.sql(f"create view customer as select * from '{BIG}/customer.parquet'")
    want = sorted(c.sql(registry.oracle_sql()["kmeans_fit"]).fetchall())
    assert sorted(map(tuple, registry.queries()["kmeans_fit"](spark, BIG).collect())) == want
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate((0, 1, 2, 10))], "id long, x double")
    m = estimators.KMeans(2, max_iter=1, tol=0.0, centres=[[0.0], [1.0]])
    assert [r["cluster"] for r in m.fit_predict(df, ["x"]).orderBy("id").collect()] == [0, 1, 1, 1]
    assert m.centres == [[0.0], [pytest.approx(13 / 3)]] and [r["cluster"] for r in m.predict(df).orderBy("id").collect()] == [0, 0, 0, 1]


def test_small_negative_cells_keep_their_sign(spark, tmp_path):
    v = [-1e-7, 1e-7, -0.0, 0.0, 0.25, -0.25] + [0.125] * 58
    spark.createDataFrame([(0, v, 1)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()["matrix_difference"]).fetchall()[0][1]
    got = registry.queries()["matrix_difference"](spark, str(tmp_path)).first()["values"]
    assert list(map(repr, got)) == list(map(repr, want)) and repr(got[0]) == "-0.0"


def test_single_precision_leaves_no_pair_out():
    """The product is never above the squared distance, so pairs at the very limit stay, and where it would be too coarse doubles are used."""
    rng = np.random.default_rng(9)
    for width, scale, offset, eps in ((1, 1.0, 0.0, 0.5), (3, 1.0, 0.0, 1.0), (64, 0.2, 0.0, 1.1), (64, 0.2, 1e3, 1.1), (16, 1e9, 0.0, 5e9), (16, 1e-9, 0.0, 5e-9), (400, 1.0, -7.0, 28.0)):
        x = rng.normal(size=(500, width)) * scale + offset
        y = x + (far := rng.normal(size=x.shape)) * (eps / np.sqrt((far * far).sum(1)))[:, None]  # each at about eps from its own
        one, two, limit = pairs.single(x, y, eps)
        exact = pairs.summed_squares(x[:, None], y[None])
        assert one.dtype == two.dtype == np.float32
        assert (exact - (one.astype(float) @ two.astype(float).T) >= 0).all() and (one @ two.T <= limit)[np.sqrt(exact) <= eps].all()
        got = [k for p, q in pairs.within(x, y, False, eps) for k in zip(p.tolist(), q.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == set(zip(*(k.tolist() for k in np.nonzero(np.sqrt(exact) <= eps)), strict=True))
    x = rng.normal(size=(50, 8))
    assert pairs.single(x, np.concatenate([x, [[1e6] * 8]]), 1.0) is None and pairs.single(x, x, 0.0) is None
    with np.errstate(over="ignore", invalid="ignore"):
        assert pairs.single(x * 1e308, x, 1.0) is None


def test_pairs_of_unit_rows_take_a_part_of_the_time_of_doubles():
    x = np.random.default_rng(10).normal(size=(8192, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def doubles():
        for r in range(0, 8192, 1024):
            for c in range(r, 8192, 1024):
                g = x[r : r + 1024] @ x[c : c + 1024].T
                g *= -2
                g += 1
                g += 1
                np.nonzero(~(g > 1.21))

    def least(f):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            f()
            took.append(time.perf_counter() - began)
        return min(took)

    assert least(lambda: sum(len(p) for p, _ in pairs.within(x, x, True, 0.9))) < 0.7 * least(doubles)


def test_copies_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(40, 6)), np.zeros((300, 6)), -np.zeros((3, 6))])[rng.permutation(343)]
    seen, given = [], pairs.summed_squares
    monkeypatch.setattr(pairs, "summed_squares", lambda a, b: seen.append(len(a)) or given(a, b))
    monkeypatch.setattr(pairs, "GIVEN", 1000)
    keys = pa.array(range(343))
    for same, parts in ((True, [(0, 343)] * 2), (False, [(0, 200), (200, 343)])):
        left, right = ((keys[a:b], keys[a:b], x[a:b]) for a, b in parts)
        got = [k for b in pairs.block_range(left, right, same, 2.0) for k in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
        near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 2.0
        if not same:
            near[:200, :200] = near[200:, 200:] = False
        assert len(got) == near.sum() and set(got) == set(zip(*(k.tolist() for k in np.nonzero(near)), strict=True))
    assert sum(seen) < 2 * 42 * 42  # there are 90,000 pairs of copies
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "row_id long, values array<double>")
    assert pairs.range_pairs(df, 2.0, len(x), 2).count() == (np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 2.0).sum()


def test_cells_that_fit_single_precision_are_moved_in_it(spark):
    short = np.float32([[0.1, -0.0], [3.5, 1e30]]).astype(float)
    assert len(pairs.exact_bytes(short)) == 16 and np.array_equal(np.frombuffer(pairs.exact_bytes(short), np.float32).reshape(2, 2), short)
    for wide in ([[0.1, 1.0]], [[1e200, 1.0]], [[1e-60, 1.0]]):
        assert np.array_equal(np.frombuffer(pairs.exact_bytes(np.array(wide))), wide[0])
    step = 1.0 + 2.0**-40  # 0 and 1 are within 1, 0 and this are not
    df = spark.createDataFrame([(k, [v, 0.0]) for k, v in enumerate([0.0, 1.0, step] + [9.0] * 20)], "row_id long, values array<double>").repartition(8, "row_id")
    assert {tuple(r) for r in pairs.range_pairs(df, 1.0, 23, 1).where("a < 3").collect()} == {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0), (1, 2), (2, 1)}
