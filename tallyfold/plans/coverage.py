"""Registered queries, continued: arithmetic, access, shapes, generators, samples, gradients, metrics of a class, fits in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import losses, scalars
from ..operators import arrays, checks, estimators, metrics, networks, prep, stats, training
from ..sources import generators, matrices
from .registry import EMB, flat, listed, query, r, rounded, t, vectors


def lists(expr: str) -> str:
    return f"WITH e AS ({EMB}) SELECT row_id, [round({expr}, 6) + 0.0 for x in v] AS values FROM e"


def one(a: DataFrame) -> DataFrame:
    return a.select("row_id", "values")


ARITHMETIC = {
    "add": "a + b", "sub": "a - b", "mul": "a * b",
    "div": "a / CASE WHEN abs(b) < 1e-8 THEN CASE WHEN b >= 0 THEN 1e-8 ELSE -1e-8 END ELSE b END",
}


def _arithmetic(name: str, expr: str) -> None:
    sql = f"""WITH e AS ({EMB}), u AS (SELECT row_id, unnest(v) AS a, unnest(list_reverse(v)) AS b, generate_subscripts(v, 1) AS j FROM e)
SELECT row_id, list(round({expr}, 3) + 0.0 ORDER BY j) AS values FROM u GROUP BY row_id"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        v = one(vectors(spark, d))
        return listed(arrays.elementwise(v, v.select("row_id", F.reverse("values").alias("values")), name), 3)

    run.__name__ = f"cells_{name}"
    query(sql)(run)


for _name, _expr in ARITHMETIC.items():
    _arithmetic(_name, _expr)


@query(f"WITH e AS ({EMB}) SELECT row_id, [round(pow((v[k] + 3) * 2 / 4 - 1, 2.0) + (k - 1) * 0.001 + row_id % 7, 6) + 0.0 for k in range(1, 65)] AS values FROM e")
def scalar_chain(spark: SparkSession, d: str) -> DataFrame:
    """Add, scale, divide, subtract and raise by scalars, then a map with position."""
    a = one(vectors(spark, d))
    for op, k in (("add", 3.0), ("mul", 2.0), ("div", 4.0), ("add", -1.0), ("pow", 2.0)):
        a = arrays.scalar(a, op, k)
    return listed(arrays.apply(a, lambda i, j, v: v + j * 0.001 + i % 7))


@query(lists("abs(x)"))
def absolute_values(spark: SparkSession, d: str) -> DataFrame:
    return listed(arrays.absolute(vectors(spark, d)))


@query(f"""WITH e AS ({EMB}) SELECT row_id, CASE WHEN row_id = 3 THEN [2.5::DOUBLE for x in v] WHEN row_id = 5 THEN [CASE WHEN k = 8 THEN -1.0 ELSE round(v[k], 6) END + 0.0 for k in range(1, 65)]
ELSE [CASE WHEN k = 2 THEN row_id * 0.5 ELSE round(v[k], 6) END + 0.0 for k in range(1, 65)] END AS values FROM e""")
def written_cells(spark: SparkSession, d: str) -> DataFrame:
    """A column, then a row and a cell replaced."""
    a = one(vectors(spark, d))
    whole = a
    a = arrays.set_column(a, 1, a.select("row_id", (F.col("row_id") * 0.5).alias("value")))
    a = arrays.set_row(a, 3, [2.5] * 64)
    kept = arrays.set_cell(whole, 5, 7, -1.0).where("row_id = 5")
    return listed(a.where("row_id <> 5").unionByName(kept))


@query(f"WITH e AS ({EMB}) SELECT row_id, [CASE WHEN row_id % 2 = 0 THEN 7.0 ELSE 0 END for x in v] AS values FROM e")
def filled_rows(spark: SparkSession, d: str) -> DataFrame:
    a = one(vectors(spark, d))
    return arrays.fill(a.where("row_id % 2 = 0"), 7.0).unionByName(arrays.fill(a.where("row_id % 2 <> 0")))


@query(f"WITH e AS ({EMB}) SELECT round((SELECT v[4] FROM e WHERE row_id = 2), 6) AS value, round((SELECT sum(v[row_id + 1]) FROM e WHERE row_id < 64), 6) AS trace")
def cell_and_trace(spark: SparkSession, d: str) -> DataFrame:
    """A cell, and the trace of the matrix of the first 64 rows (it must be square)."""
    a = one(vectors(spark, d))
    return rounded(arrays.cell(a, 2, 3).join(F.broadcast(arrays.trace(a.where("row_id < 64")))))


@query("SELECT count(*) AS n_rows, max(len(embedding)) AS n_cols, count(*) = 0 AS is_empty, count(*) = max(len(embedding)) AS is_square, count(*) = 1 AS is_vector FROM embeddings")
def matrix_shape(spark: SparkSession, d: str) -> DataFrame:
    return checks.shape_report(vectors(spark, d))


@query("SELECT CAST(0 AS BIGINT) AS i, CAST(vec_id * 64 + k AS BIGINT) AS j, CAST(embedding[k + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(k)")
def flat_matrix(spark: SparkSession, d: str) -> DataFrame:
    return arrays.flatten(matrices.to_coo(one(vectors(spark, d))), 64)


@query(f"""WITH e AS ({EMB}), p AS (SELECT a.label, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2))) AS d FROM e a JOIN e b ON a.label = b.label AND a.row_id < b.row_id)
SELECT label, count(*) AS pairs, round(avg(d), 6) AS mean, round(min(d), 6) AS low, round(max(d), 6) AS high FROM p GROUP BY label""")
def cluster_pair_distances(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arrays.pair_distances(vectors(spark, d), "label"))


WIDE = f"""WITH RECURSIVE e AS ({EMB}), n AS (SELECT a.row_id AS a, b.row_id AS b FROM e a, e b WHERE sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2))) <= 1.1)"""


@query(f"{WIDE} SELECT a, b FROM n")
def range_neighbours_wide(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of whole vectors within a distance."""
    return arrays.range_join_wide(vectors(spark, d), 1.1)


@query(f"""{WIDE}, k AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 3), l AS (SELECT a, b FROM n WHERE a IN (SELECT a FROM k) AND b IN (SELECT a FROM k)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a), c AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
lab AS (SELECT a, coalesce(c.root, (SELECT min(c2.root) FROM n n2 JOIN c c2 ON n2.b = c2.a WHERE n2.a = e0.a)) AS root, c.root IS NOT NULL AS core FROM (SELECT row_id AS a FROM e) e0 LEFT JOIN c USING (a))
SELECT count(DISTINCT root) AS n_clusters, count(*) FILTER (root IS NULL) AS n_noise, count(*) FILTER (core) AS n_core FROM lab""")
def density_counts_wide(spark: SparkSession, d: str) -> DataFrame:
    """Counts of density clusters of whole vectors."""
    df, names = flat(spark, d)
    return estimators.dbscan_counts(estimators.dbscan(df, "vec_id", names, 1.1, 3))


@query("SELECT vec_id, CAST(-1 AS BIGINT) AS label FROM embeddings")
def density_predict(spark: SparkSession, d: str) -> DataFrame:
    return estimators.dbscan_predict(t(spark, d, "embeddings"), "vec_id")


def U(stream: str, key: str = "k") -> str:
    return f"(CAST('0x' || substr(md5('42-{stream}-' || {key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def N(stream: str, key: str = "k") -> str:
    return f"(sqrt(-2 * ln(greatest({U(stream + 'a', key)}, pow(2, -33)))) * cos(2 * pi() * {U(stream + 'b', key)}))"


@query(f"""SELECT k AS row_id, round(2 * {U('x')} - 1 + 0.1 * {N('xn')}, 6) AS f0, round(2 * {U('y')} - 1 + 0.1 * {N('yn')}, 6) AS f1,
CAST((2 * {U('x')} - 1 + 0.1 * {N('xn')} > 0) <> (2 * {U('y')} - 1 + 0.1 * {N('yn')} > 0) AS INTEGER) AS label FROM range(1000) t(k)""")
def xor_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(generators.xor(spark, 1000, 0.1))


@query(f"""WITH a AS (SELECT k, k >= 500 AS inner_, 2 * pi() * CASE WHEN k >= 500 THEN (k - 500) / 501 ELSE k / 500 END AS t FROM range(1001) t(k))
SELECT k AS row_id, round(CASE WHEN inner_ THEN 0.5 ELSE 1 END * cos(t) + 0.05 * {N('x')}, 6) + 0.0 AS f0, round(CASE WHEN inner_ THEN 0.5 ELSE 1 END * sin(t) + 0.05 * {N('y')}, 6) + 0.0 AS f1, CAST(inner_ AS INTEGER) AS label FROM a""")
def circle_points(spark: SparkSession, d: str) -> DataFrame:
    g = generators.circles(spark, 1001, 0.05)
    return g.select("row_id", (r("f0") + 0.0).alias("f0"), (r("f1") + 0.0).alias("f1"), "label")


@query(f"""WITH b AS (SELECT k, CASE WHEN k < 999 THEN CAST(floor(k / 333) AS INTEGER) ELSE 0 END AS label FROM range(1000) t(k))
SELECT k AS row_id, [{", ".join(f"CASE WHEN k < 999 THEN round(20 * {U(f'm{j}', 'label')} - 10 + 0.8 * {N(f'p{j}')}, 6) ELSE 0 END" for j in range(4))}] AS values, label FROM b""")
def blob_points(spark: SparkSession, d: str) -> DataFrame:
    return generators.blobs(spark, 1000, 4, 3, 0.8).select("row_id", F.transform("values", lambda v: F.round(v, 6)).alias("values"), "label")


@query(f"""WITH s AS (SELECT k, CAST(floor(k / 300) AS INTEGER) AS label, (k % 300) / 300 AS step FROM range(900) t(k)), a AS (SELECT *, 4 * (label + step) + 0.2 * {N('t')} AS angle FROM s)
SELECT k AS row_id, round(step * sin(angle), 6) + 0.0 AS f0, round(step * cos(angle), 6) + 0.0 AS f1, label FROM a""")
def spiral_points(spark: SparkSession, d: str) -> DataFrame:
    g = generators.spiral(spark, 900, 3, 0.2)
    return g.select("row_id", (r("f0") + 0.0).alias("f0"), (r("f1") + 0.0).alias("f1"), "label")


@query(f"""SELECT 'uniform' AS kind, k AS row_id, round(-2 + 5 * {U('u')}, 9) AS value FROM range(500) t(k) UNION ALL SELECT 'normal', k, round(10 + 2 * {N('n')}, 6) FROM range(500) t(k)
UNION ALL SELECT 'integer', k, CAST(5 + floor(15 * {U('i')}) AS DOUBLE) FROM range(500) t(k)""")
def samples(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        generators.uniform_sample(spark, 500, -2, 3).select(F.lit("uniform").alias("kind"), "row_id", r("value", 9).alias("value")),
        generators.normal_sample(spark, 500, 10, 2).select(F.lit("normal").alias("kind"), "row_id", r("value").alias("value")),
        generators.integer_sample(spark, 500, 5, 20).select(F.lit("integer").alias("kind"), "row_id", F.col("value").cast("double").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""SELECT k AS row_id, [{", ".join(f"round({U(f'c{j}')}, 9)" for j in range(3))}] AS uniform, [CAST(k * 3 + j + 1 AS DOUBLE) for j in range(3)] AS counted FROM range(200) t(k)""")
def sample_matrices(spark: SparkSession, d: str) -> DataFrame:
    a = generators.matrix_sample(spark, 200, 3).select("row_id", F.transform("values", lambda v: F.round(v, 9)).alias("uniform"))
    return a.join(generators.sequence_matrix(spark, 200, 3).withColumnRenamed("values", "counted"), "row_id")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42-' || o_orderkey), o_orderkey LIMIT 100")
def chosen_rows(spark: SparkSession, d: str) -> DataFrame:
    return generators.choice(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('42-' || o_orderkey), o_orderkey) - 1 AS position FROM orders")
def shuffled_rows(spark: SparkSession, d: str) -> DataFrame:
    return generators.shuffled(t(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT event_id, CAST(floor((row_number() OVER (ORDER BY md5('44-' || event_id), event_id) - 1) / 64) AS BIGINT) AS batch FROM events")
def shuffled_batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Batches of the third epoch, dealt anew."""
    return prep.Loader(t(spark, d, "events").select("event_id"), "event_id", 64).next_epoch().next_epoch().dealt


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('42-' || o_orderkey), o_orderkey) <= CAST(floor(0.3 * count(*) OVER ()) AS BIGINT) AS is_test FROM orders")
def head_split(spark: SparkSession, d: str) -> DataFrame:
    return prep.head_split(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.3)


@query("""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42-' || o_orderkey), o_orderkey) AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN k > n - CAST(round(n * (1 - 0.7)) AS BIGINT) THEN 'test' ELSE 'train' END AS part FROM k""")
def sized_split(spark: SparkSession, d: str) -> DataFrame:
    """By the size of the training part."""
    train, test = prep.train_test_split(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", prep.SplitOptions(train_size=0.7))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _three() -> str:
    order = "md5('{s}-' || o_orderkey), o_orderkey"
    return f"""WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY {order.format(s=42)}) AS k, count(*) OVER () AS n FROM orders),
x AS (SELECT o_orderkey, k > n - CAST(round(n * 0.3) AS BIGINT) AS held FROM h), i AS (SELECT o_orderkey, row_number() OVER (ORDER BY {order.format(s=43)}) AS k, count(*) OVER () AS n FROM x WHERE held)
SELECT x.o_orderkey, CASE WHEN i.k > i.n - CAST(round(i.n * (0.1 / 0.3)) AS BIGINT) THEN 'test' WHEN held THEN 'val' ELSE 'train' END AS part FROM x LEFT JOIN i USING (o_orderkey)"""


@query(_three())
def three_parts(spark: SparkSession, d: str) -> DataFrame:
    return prep.three_way(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.1, 0.2)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - 25) / 14, 6) AS l_quantity, round((l_discount - 0.05) / 0.03, 6) AS l_discount FROM lineitem")
def given_normalise(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(prep.normalised(df, ["l_quantity", "l_discount"], [25.0, 0.05], [14.0, 0.03]))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / sqrt(avg(l_quantity * l_quantity) OVER ()), 6) AS l_quantity, round(l_tax - avg(l_tax) OVER (), 6) AS l_tax FROM lineitem")
def scale_options(spark: SparkSession, d: str) -> DataFrame:
    """Scaled about 0, and centred without scaling."""
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    about = prep.StandardScaler.fit(df, ["l_quantity"], with_mean=False).transform(df)
    return rounded(prep.StandardScaler.fit(df, ["l_tax"], with_std=False).transform(about))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS DOUBLE) AS "l_returnflag_A", CAST(l_returnflag = 'N' AS DOUBLE) AS "l_returnflag_N", CAST(l_returnflag = 'R' AS DOUBLE) AS "l_returnflag_R",
CAST(l_linestatus = 'F' AS DOUBLE) AS "l_linestatus_F", CAST(l_linestatus = 'O' AS DOUBLE) AS "l_linestatus_O" FROM lineitem""")
def one_hot_columns(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return prep.one_hot_all(df, ["l_returnflag", "l_linestatus"])[0].drop("l_returnflag", "l_linestatus")


POSITIVE = "count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn"


@query(f"""WITH c AS (SELECT {POSITIVE}, avg(CAST(quality = toxic AS DOUBLE)) AS a FROM labels), p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c)
SELECT tp, fp, fn, tn, round(a, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM p""")
def positive_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.for_class(t(spark, d, "labels"), "quality", "toxic", 1))


@query("""WITH l AS (SELECT quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)), h AS (SELECT (SELECT count(DISTINCT quality) = 2 FROM l) AS is_binary, (SELECT avg(CAST(abs(quality - toxic) < 1e-8 AS DOUBLE)) FROM l) AS a),
g AS (SELECT avg(CAST((n_chars >= 1000) = (quality = 1) AS DOUBLE)) AS one, avg(CAST(CASE WHEN n_chars * 0.001 >= toxic + 0.5 THEN 0 ELSE 1 END = quality AS DOUBLE)) AS many FROM l)
SELECT is_binary, round(a, 6) AS accuracy, round(one, 6) AS at_half, round(many, 6) AS by_largest FROM h, g""")
def training_accuracies(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    p = (F.col("n_chars") >= 1000).cast("double")
    parts = [metrics.binary_check(df, "quality"), metrics.accuracy(df, "quality", "toxic"), metrics.training_accuracy(df, F.col("quality"), [p]).withColumnRenamed("accuracy", "at_half")]
    parts.append(metrics.training_accuracy(df, F.col("quality"), [F.col("n_chars") * 0.001, F.col("toxic") + 0.5]).withColumnRenamed("accuracy", "by_largest"))
    out = parts[0]
    for x in parts[1:]:
        out = out.join(F.broadcast(x))
    return rounded(out)


@query("""WITH g AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem) SELECT count(*) AS n_rows, round(avg((y - p) ** 2), 2) AS mse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
round(avg(y - p), 4) AS mean, round(stddev_pop(y - p), 4) AS std, round(min(y - p), 4) AS low, round(quantile_cont(y - p, 0.5), 4) AS q2, round(max(y - p), 4) AS high, round(1 - var_pop(y - p) / var_pop(y), 6) AS centred FROM g""")
def regression_summary(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    out = metrics.regression_report(df, "y", "p").join(F.broadcast(metrics.centred_explained_variance(df, "y", "p").withColumnRenamed("explained_variance", "centred")))
    return out.select("n_rows", r("mse", 2).alias("mse"), *(r(c, 4).alias(c) for c in ("mae", "mean", "std", "low", "q2", "high")), r("r2").alias("r2"), r("centred").alias("centred"))


@query("SELECT count(*) AS n, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, round(min(a), 6) AS low, round(max(a), 6) AS high FROM (SELECT avg(CAST(quality = toxic AS DOUBLE)) AS a FROM labels GROUP BY doc_id % 5)")
def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each of five folds, summed up."""
    folds = t(spark, d, "labels").groupBy(F.pmod("doc_id", F.lit(5)).alias("fold")).agg(F.avg((F.col("quality") == F.col("toxic")).cast("double")).alias("a"))
    return rounded(metrics.fold_summary(folds, "a"))


@query("SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(embedding[1] AS DOUBLE)), 6) AS std, min(vec_id) AS first_row FROM embeddings GROUP BY label HAVING label >= 0")
def cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that are no noise, with the sample deviation of a feature."""
    df, names = flat(spark, d)
    return df.where("label >= 0").groupBy("label").agg(r(F.avg(names[0])).alias("mean"), r(F.stddev_samp(names[0])).alias("std"), F.min("vec_id").alias("first_row"))


PQ = "WITH l AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, 0.1 + 0.8 * toxic AS p FROM labels)"


@query(f"""{PQ} SELECT doc_id, round((p - y) / (p * (1 - p) * 10), 6) AS bce, round((p - y) / 10, 6) AS cce, round((p - y) / 10, 6) AS mse,
round(CASE WHEN y > 0 THEN 0.25 * (2 * (1 - p) * ln(p) - (1 - p) ** 2 / p) ELSE 0.75 * (p ** 2 / (1 - p) - 2 * p * ln(1 - p)) END / 10, 6) AS focal FROM l""")
def loss_gradients(spark: SparkSession, d: str) -> DataFrame:
    y, p, n = F.col("y"), F.col("p"), F.lit(10)
    df = t(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y"), (0.1 + 0.8 * F.col("toxic")).alias("p"))
    slope = losses.difference_gradient(y, p, n)
    return df.select("doc_id", r(losses.bce_gradient(y, p, n)).alias("bce"), r(slope).alias("cce"), r(slope).alias("mse"), r(losses.focal_gradient(y, p, n)).alias("focal"))


@query("""SELECT event_id, round(value, 2) AS rounded, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.01 END AS leaky_relu, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE round(exp(value - 50), 6) END AS elu, 1.0::DOUBLE AS linear, round(value - 50, 6) AS same FROM events""")
def activation_more(spark: SparkSession, d: str) -> DataFrame:
    known, z = scalars.Activations(), F.col("value") - 50
    e = t(spark, d, "events")
    return e.select("event_id", scalars.round_to(F.col("value"), 2).alias("rounded"), *(r(known.slope(n, z)).alias(n) for n in ("leaky_relu", "elu", "linear")), r(known.apply("linear", z)).alias("same"))


@query(f"""WITH e AS ({EMB}), x AS (SELECT row_id, unnest(v) AS a, unnest([round(y, 9) for y in v]) AS b FROM e) SELECT count(*) FILTER (abs(a - b) > 1e-8) = 0 AS equal FROM x""")
def matrix_equality(spark: SparkSession, d: str) -> DataFrame:
    a = one(vectors(spark, d))
    return arrays.equal(a, a.select("row_id", F.transform("values", lambda v: F.round(v, 9)).alias("values")))


@query(f"""WITH e AS ({EMB}) SELECT event_id, coalesce(v[1:64], [0.0::DOUBLE for k in range(64)]) AS values FROM events LEFT JOIN e ON row_id = event_id % 300""")
def embedding_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each token, zeros where the table has none."""
    tokens = t(spark, d, "events").select("event_id", F.pmod("event_id", F.lit(300)).alias("token_id"))
    known = vectors(spark, d).select(F.col("row_id").alias("token_id"), "values")
    return arrays.lookup(tokens, known, 64).select("event_id", "values")


@query("SELECT k AS row_id, [1.0::DOUBLE for j in range(3)] AS ones, [0.0::DOUBLE for j in range(3)] AS zeros, CASE k WHEN 0 THEN [1.0::DOUBLE, 2.0, 3.0] ELSE [4.0::DOUBLE, 5.0, 6.0] END AS given FROM range(2) t(k)")
def made_matrices(spark: SparkSession, d: str) -> DataFrame:
    a, b = matrices.filled(spark, 2, 3, 1.0), matrices.filled(spark, 2, 3, 0.0)
    c = matrices.from_flat(spark, 2, 3, [1, 2, 3, 4, 5, 6])
    both = a.withColumnRenamed("values", "ones").join(b.withColumnRenamed("values", "zeros"), "row_id")
    return both.join(c.withColumnRenamed("values", "given"), "row_id")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_totalprice BETWEEN 0 AND 1e9")
def validated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that pass the checks of range and finiteness, aligned with themselves."""
    df = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    df = checks.check_then_clean(stats.check_range(df, "o_totalprice", 0, 1e9), ["o_totalprice"])
    return checks.check_aligned(df.select("o_orderkey"), df, "o_orderkey").select("o_orderkey", r("o_totalprice", 2).alias("o_totalprice"))


def ridge_sql() -> str:
    """Penalised least squares of one standardised feature, solved by hand."""
    return """WITH s AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, l_extendedprice AS y FROM lineitem)
SELECT round((avg(x * y) - avg(x) * avg(y)) / (avg(x * x) - avg(x) ** 2 + 0.5), 2) AS slope, round(avg(y), 1) AS intercept FROM s"""


@query(ridge_sql())
def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    df = prep.standard_scaled(t(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity"])
    m = estimators.LinearRegression(penalty="l2", strength=0.5).fit(df, ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(m.weights[0], 2), round(m.intercept, 1))], "slope double, intercept double")


@query("SELECT round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, l_linenumber FROM lineitem GROUP BY l_linenumber")
def linear_scores(spark: SparkSession, d: str) -> DataFrame:
    """R2 of a fit to each line number's rows."""
    df, out = t(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice"), None
    for n in sorted(x[0] for x in df.select("l_linenumber").distinct().collect()):  # seven numbers
        own = df.where(F.col("l_linenumber") == n)
        s = estimators.LinearRegression().fit(own, ["l_quantity"], "l_extendedprice").score(own, "l_extendedprice").withColumn("l_linenumber", F.lit(n).cast(dict(df.dtypes)["l_linenumber"]))
        out = s if out is None else out.unionByName(s)
    return rounded(out)


def _perceptron_sql(epochs: int = 5, rate: float = 0.1) -> str:
    """One sigmoid unit by full-batch gradient descent, from zero weights."""
    return f"""WITH RECURSIVE e AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, CAST(toxic AS DOUBLE) AS x FROM labels),
w(k, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k + 1, a - {rate} * avg((p - y) * x), b - {rate} * avg(p - y) FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS p FROM w, e WHERE k < {epochs}) GROUP BY k, a, b)
SELECT doc_id, round(1 / (1 + exp(-(a * x + b))), 6) AS p0 FROM w, e WHERE k = {epochs}"""


@query(_perceptron_sql())
def perceptron_fit(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    df = t(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y"), F.col("toxic").cast("double").alias("x"))
    net = networks.Sequential([(1, "sigmoid")], loss="bce", weights={"w0": np.zeros((1, 1)), "b0": np.zeros(1)})
    return net.fit(df, ["x"], ["y"], epochs=5, optimizer=networks.SGD(0.1)).predict(df).select("doc_id", r("p0").alias("p0"))


def _component_sql(steps: int = 200) -> str:
    """The first principal axis of three features by power iteration, and each row's place on it; the sign makes l_quantity's share positive."""
    c = ["l_quantity", "l_discount", "l_tax"]
    z = ", ".join(f"({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () AS z{k}" for k, x in enumerate(c))
    m = ", ".join(f"covar_samp(z{i}, z{j}) AS m{i}{j}" for i in range(3) for j in range(3))
    up = [f"(m{i}0 * a + m{i}1 * b + m{i}2 * c)" for i in range(3)]
    size = f"sqrt({' + '.join(f'{u} ** 2' for u in up)})"
    return f"""WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber, {z} FROM lineitem), g AS (SELECT {m} FROM s),
v(k, a, b, c) AS (SELECT 0, 1.0::DOUBLE, 0.3::DOUBLE, 0.1::DOUBLE UNION ALL SELECT k + 1, {", ".join(f"{u} / {size}" for u in up)} FROM v, g WHERE k < {steps})
SELECT round({size}, 5) AS variance, round(({size}) / (m00 + m11 + m22), 5) AS share FROM v, g WHERE k = {steps}"""


@query(_component_sql(2000))
def component_variance(spark: SparkSession, d: str) -> DataFrame:
    """Variance of the first principal component of standardised features, and its share of the whole."""
    c = ["l_quantity", "l_discount", "l_tax"]
    df = prep.standard_scaled(t(spark, d, "lineitem").select(*c), c)
    m = estimators.PCA(3).fit(df, c)
    v = [float(x) for x in m.variance]
    return spark.createDataFrame([(round(v[0], 5), round(v[0] / math.fsum(v), 5))], "variance double, share double")




@query("SELECT 'relu' AS name UNION ALL SELECT unnest(['leaky_relu', 'elu', 'swish', 'gelu', 'sigmoid', 'tanh', 'linear', 'softmax'])")
def activation_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in scalars.Activations().names()], "name string")


@query("SELECT CAST(k AS INTEGER) AS epoch, round(0.1 * pow(0.5, floor(k / 10)), 9) AS step, round(0.001 + 0.099 * (1 + cos(pi() * k / 50)) / 2, 9) AS cosine FROM range(50) t(k)")
def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, round(networks.step_decay(0.1, k), 9), round(training.cosine_rate(0.1, k, 50, 0.001), 9)) for k in range(50)]
    return spark.createDataFrame(rows, "epoch int, step double, cosine double")
