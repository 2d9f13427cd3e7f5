"""Registered queries, each with SQL for DuckDB where SQL can express it.

Floats are rounded on both sides, as sums depend on their order; counts are 64-bit on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import losses, scalars
from ..operators import arrays, estimators, layers, metrics, prep, stats, training
from ..operators.networks import Adam, Sequential
from ..sources import matrices
from ..streaming.drift import drift

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
LINE = ["l_quantity", "l_extendedprice", "l_discount"]
NUMERIC = [*LINE, "l_tax"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    from . import coverage  # noqa: F401  (registers its queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import coverage  # noqa: F401

    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def vectors(spark: SparkSession, d: str, width: int = 64) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.transform(F.slice("embedding", 1, width), lambda v: v.cast("double")).alias("values"))


EMB = "SELECT vec_id AS row_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Scale, split by key, fit one feature by least squares on the training part, predict and score, in one plan."""
    o = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("x"), F.sum("l_extendedprice").alias("y"))
    o = prep.standard_scaled(o, ["x"]).withColumn("is_test", F.pmod(F.col("l_orderkey"), F.lit(5)) == 0)
    fit = o.where("not is_test").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    scored = o.join(F.broadcast(fit)).withColumn("p", F.col("slope") * F.col("x") + F.col("intercept"))
    return scored.groupBy("is_test").agg(
        F.count("*").alias("n"),
        r(1 - F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))) / (F.var_pop("y") * F.count("y")), 6).alias("r2"),
        r(F.max("slope"), 2).alias("slope"),
        r(F.max("intercept"), 2).alias("intercept"),
    )


@query("""
WITH o AS (SELECT l_orderkey, sum(l_quantity) AS x0, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, y, (x0 - avg(x0) OVER ()) / stddev_pop(x0) OVER () AS x, l_orderkey % 5 = 0 AS is_test FROM o),
f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM s WHERE NOT is_test)
SELECT is_test, count(*) AS n, round(1 - sum((y - slope * x - intercept) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
  round(max(slope), 2) AS slope, round(max(intercept), 2) AS intercept FROM s, f GROUP BY is_test""")
def fit_and_score(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


@query("""SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice FROM orders""")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prep.standard_scaled(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query(f"""SELECT l_orderkey, l_linenumber, {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) AS z_{c}, round({c}, 4) AS {c}" for c in LINE)} FROM lineitem""")
def standard_scale_inverse(spark: SparkSession, d: str) -> DataFrame:
    """Scaled values beside those that the inverse gives back."""
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    m = prep.StandardScaler.fit(df, LINE)
    scaled = m.transform(df).withColumns({f"z_{c}": F.col(c) for c in LINE})
    return rounded(m.inverse(scaled), 4)


@query("""SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) * 2 - 1, 6) AS o_totalprice FROM orders""")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(prep.MinMaxScaler.fit(df, ["o_totalprice"], -1.0, 1.0).transform(df))


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS share, round(c_acctbal, 4) AS c_acctbal FROM customer")
def minmax_scale_inverse(spark: SparkSession, d: str) -> DataFrame:
    """Scaled values beside those that the inverse gives back."""
    df = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    m = prep.MinMaxScaler.fit(df, ["c_acctbal"])
    return m.inverse(m.transform(df).withColumn("share", r("c_acctbal"))).withColumn("c_acctbal", r("c_acctbal", 4))


@query("""SELECT o_orderkey, o_orderstatus, CAST(o_orderstatus = 'F' AS DOUBLE) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS DOUBLE) AS "o_orderstatus_O",
CAST(o_orderstatus = 'P' AS DOUBLE) AS "o_orderstatus_P" FROM orders""")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return prep.OneHotEncoder.fit(df, "o_orderstatus").transform(df)


@query("SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return prep.LabelEncoder.fit(df, "o_orderpriority").transform(df)


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code, o_orderpriority AS value FROM orders")
def label_decode(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    m = prep.LabelEncoder.fit(df, "o_orderpriority")
    return m.inverse(m.transform(df), "code").select("o_orderkey", "code", "value")


@query("SELECT vec_id, [CAST(label = i AS DOUBLE) for i in range(10)] AS hot FROM embeddings")
def one_hot_of_codes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", prep.one_hot_codes(F.col("label"), 10).alias("hot"))


def dirty(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("event_id", F.lit(7))
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return t(spark, d, "events").select("event_id", v.alias("value"))


DIRTY = "WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN CAST('-inf' AS DOUBLE) ELSE value END AS value FROM events)"


@query(f"{DIRTY} SELECT event_id, CASE WHEN isfinite(value) THEN value ELSE 0 END AS value FROM e")
def clean_zero(spark: SparkSession, d: str) -> DataFrame:
    return stats.clean(dirty(spark, d), ["value"], "zero")


@query(f"{DIRTY} SELECT event_id, round(CASE WHEN isfinite(value) THEN value ELSE (SELECT avg(value) FROM e WHERE isfinite(value)) END, 6) AS value FROM e")
def clean_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.clean(dirty(spark, d), ["value"], "mean"))


@query(f"{DIRTY} SELECT event_id, CASE WHEN isnan(value) THEN 0 WHEN NOT isinf(value) THEN value WHEN value > 0 THEN 1e6 ELSE -1e6 END AS value FROM e")
def clean_clamp(spark: SparkSession, d: str) -> DataFrame:
    return stats.clean(dirty(spark, d), ["value"], "clamp")


@query(f"{DIRTY} SELECT 'value' AS feature, CAST(count(*) FILTER (isnan(value)) AS BIGINT) AS n_nan, CAST(count(*) FILTER (isinf(value)) AS BIGINT) AS n_inf FROM e")
def non_finite_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.non_finite(dirty(spark, d), ["value"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) > (SELECT count(*) - greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM orders) AS is_test FROM orders")
def sequential_split(spark: SparkSession, d: str) -> DataFrame:
    return prep.split(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY md5('42-' || o_orderkey), o_orderkey) > (SELECT count(*) - CAST(round(count(*) * 0.25) AS BIGINT) FROM orders) AS is_test FROM orders""")
def hashed_split(spark: SparkSession, d: str) -> DataFrame:
    return prep.split(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.25, 42)


STRAT = """SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42-' || o_orderkey), o_orderkey)
 <= least(greatest(round(count(*) OVER (PARTITION BY o_orderstatus) * 0.3), 1), count(*) OVER (PARTITION BY o_orderstatus) - 1) AS is_test FROM orders"""


@query(STRAT)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return prep.stratified(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.3).select("o_orderkey", "o_orderstatus", "is_test")


@query("SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 64) AS BIGINT) AS batch FROM events")
def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    return prep.batches(t(spark, d, "events").select("event_id"), "event_id", 64)


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(sum({c}), 2) AS total, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(var_samp({c}), 2) AS variance, min({c}) AS low, max({c}) AS high FROM lineitem" for c in NUMERIC))
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    s = stats.summary(t(spark, d, "lineitem"), NUMERIC)
    return s.select("feature", "n", r("total", 2).alias("total"), r("mean").alias("mean"), r("std").alias("std"), r("variance", 2).alias("variance"), "low", "high")


@query("SELECT CAST(k AS INTEGER) AS k, round(value, 6) AS value FROM (SELECT unnest(range(5)) AS k, unnest(quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1])) AS value FROM lineitem)")
def percentile_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.percentiles(t(spark, d, "lineitem"), "l_extendedprice", [-5, 25, 50, 75, 100]))


PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i:]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in PAIRS if a != b))
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.correlations(t(spark, d, "lineitem"), NUMERIC))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS cov FROM lineitem" for a, b in PAIRS))
def covariance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.covariances(t(spark, d, "lineitem"), NUMERIC), 4)


@query("SELECT round(sqrt(sum(l_quantity * l_quantity) + sum(l_discount * l_discount)), 4) AS norm FROM lineitem")
def frobenius_norm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.frobenius(t(spark, d, "lineitem"), ["l_quantity", "l_discount"]), 4)


QUALITY = ["l_quantity", "l_discount", "twice", "one"]


@query("WITH q AS (SELECT l_quantity, l_discount, l_quantity * 2 AS twice, 1.0::DOUBLE AS one FROM lineitem) "
       + " UNION ALL ".join(f"SELECT 'constant' AS finding, '{c}' AS feature, CAST(NULL AS VARCHAR) AS other FROM q HAVING max({c}) - min({c}) < 1e-8" for c in QUALITY)
       + "".join(f" UNION ALL SELECT 'not_finite', '{c}', NULL FROM q HAVING count(*) FILTER (isnan({c}) OR isinf({c})) > 0" for c in QUALITY)
       + "".join(f" UNION ALL SELECT 'correlated', '{a}', '{b}' FROM q HAVING stddev_pop({a}) * stddev_pop({b}) >= 1e-8 AND abs(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))) > 0.95" for i, a in enumerate(QUALITY) for b in QUALITY[i + 1 :]))
def quality_findings(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "lineitem").select("l_quantity", "l_discount", (F.col("l_quantity") * 2).alias("twice"), F.lit(1.0).alias("one"))
    return stats.quality_report(df, ["l_quantity", "l_discount", "twice", "one"])


@query("SELECT CAST(quality AS INTEGER) AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY quality")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.label_report(t(spark, d, "labels"), "quality"))


@query("SELECT count(*) AS n_classes, min(n) AS smallest, max(n) AS largest, count(*) > 1 AS is_valid, min(n) < 0.1 * max(n) AS is_imbalanced FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)")
def label_balance(spark: SparkSession, d: str) -> DataFrame:
    return stats.label_quality(t(spark, d, "labels"), "toxic")


@query("SELECT round(1 - sum(n * n) / sum(n) ** 2, 9) AS gini FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def gini_impurity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arrays.gini(t(spark, d, "embeddings"), "label"), 9)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 1")
def majority_class(spark: SparkSession, d: str) -> DataFrame:
    return arrays.majority(t(spark, d, "events"), "event_type")


@query("SELECT CAST(quality AS INTEGER) AS truth, CAST(toxic AS INTEGER) AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(t(spark, d, "labels"), "quality", "toxic")


REPORT = """WITH c AS (SELECT k.class, count(*) FILTER (quality = class AND toxic = class) AS tp, count(*) FILTER (quality <> class AND toxic = class) AS fp,
 count(*) FILTER (quality = class AND toxic <> class) AS fn, count(*) FILTER (quality <> class AND toxic <> class) AS tn
 FROM labels, (SELECT DISTINCT CAST(quality AS INTEGER) AS class FROM labels UNION SELECT DISTINCT CAST(toxic AS INTEGER) FROM labels) k GROUP BY k.class),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, tp + fn AS support FROM p)"""


@query(f"{REPORT} SELECT class, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.class_report(t(spark, d, "labels"), "quality", "toxic"))


@query(f"{REPORT} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM f")
def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.macro(t(spark, d, "labels"), "quality", "toxic"))


@query(f"{REPORT}, h AS (SELECT sum(tp) / sum(support) AS a, arg_max(precision, class) AS p, arg_max(recall, class) AS q FROM f) SELECT round(a, 6) AS accuracy, round(p, 6) AS precision, round(q, 6) AS recall, CASE WHEN p + q = 0 THEN 0 ELSE round(2 * p * q / (p + q), 6) END AS f1 FROM h")
def headline_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.headline(t(spark, d, "labels"), "quality", "toxic"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", "n_chars")


ROC = """WITH j AS (SELECT quality, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)),
b AS (SELECT s, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS q FROM j GROUP BY s),
c AS (SELECT s, p, q, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM b WINDOW w AS (ORDER BY s DESC))"""


@query(f"{ROC} SELECT s AS threshold, round(cp / (SELECT sum(p) FROM b), 6) AS tpr, round(cq / (SELECT sum(q) FROM b), 6) AS fpr FROM c UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc(judged(spark, d), "quality", "n_chars"))


@query(f"{ROC} SELECT round(sum(q * (cp - p / 2)) / (sum(p) * sum(q)), 6) AS auc FROM c")
def roc_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auc(judged(spark, d), "quality", "n_chars"))


def guessed(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))


GUESS = "WITH g AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem)"


@query(f"""{GUESS} SELECT round(avg((y - p) ** 2), 2) AS mse, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
round(100 * avg(abs((y - p) / y)) FILTER (abs(y) > 1e-8), 4) AS mape, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS explained_variance FROM g""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.regression(guessed(spark, d), "y", "p")
    return m.select(r("mse", 2).alias("mse"), r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"), r("r2").alias("r2"), r("mape", 4).alias("mape"), r("explained_variance").alias("explained_variance"))


@query(f"""{GUESS} SELECT round(avg(y - p), 4) AS mean, round(stddev_pop(y - p), 4) AS std, round(min(y - p), 4) AS low, round(max(y - p), 4) AS high,
round(quantile_cont(y - p, 0.25), 4) AS q1, round(quantile_cont(y - p, 0.5), 4) AS q2, round(quantile_cont(y - p, 0.75), 4) AS q3 FROM g""")
def residual_analysis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.residuals(guessed(spark, d), "y", "p"), 4)


@query("SELECT l_linenumber, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY l_linenumber")
def simple_linear_fit(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_linenumber").agg(r(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), r(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem")
def normal_equation_fit(spark: SparkSession, d: str) -> DataFrame:
    m = estimators.LinearRegression().fit(t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(m.weights[0], 3), round(m.intercept, 1))], "slope double, intercept double")


@query("""WITH RECURSIVE s AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS y FROM lineitem),
g AS (SELECT avg(x) AS mx, avg(y) AS my, avg(x * x) AS xx, avg(x * y) AS xy FROM s),
w(k, b, a) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k + 1, b - 0.05 * (b + a * mx - my), a - 0.05 * (b * mx + a * xx - xy) FROM w, g WHERE k < 50)
SELECT round(a, 6) AS slope FROM w WHERE k = 50""")
def gradient_descent_fit(spark: SparkSession, d: str) -> DataFrame:
    df = prep.standard_scaled(t(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    m = estimators.LinearRegression(solver="gradient", rate=0.05, max_iter=50, tol=0.0).fit(df, ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(m.weights[0], 6),)], "slope double")


@query(f"""WITH e AS ({EMB}), u AS (SELECT row_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM e),
c AS (SELECT label AS k, j, avg(x) AS m FROM u GROUP BY ALL),
dd AS (SELECT row_id, k, sum((x - m) ** 2) AS d FROM u JOIN c USING (j) GROUP BY ALL)
SELECT row_id, CAST(arg_min(k, (round(d, 9), k)) AS INTEGER) AS cluster, round(min(d), 6) AS distance FROM dd GROUP BY row_id""")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    means = v.groupBy("label").agg(F.array(*(F.avg(F.element_at("values", j + 1)) for j in range(64))).alias("m")).orderBy("label").collect()  # ten labels
    return rounded(arrays.nearest(v.select("row_id", "values"), [x["m"] for x in means]).select("row_id", "cluster", "distance"))


@query("""WITH a AS (SELECT c_acctbal AS x, least(abs(c_acctbal), abs(c_acctbal - 5000), abs(c_acctbal - 9000)) AS dist FROM customer),
k AS (SELECT x, dist, CASE WHEN dist = abs(x) THEN 0 WHEN dist = abs(x - 5000) THEN 1 ELSE 2 END AS cluster FROM a)
SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, round(avg(x), 4) AS c_acctbal, round(sum(dist * dist), 0) AS inertia FROM k GROUP BY cluster""")
def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    s = estimators.lloyd_step(t(spark, d, "customer"), ["c_acctbal"], [[0.0], [5000.0], [9000.0]])
    return s.select("cluster", "n", r("c_acctbal", 4).alias("c_acctbal"), r("inertia", 0).alias("inertia"))


LLOYD = "CASE WHEN abs(x - a) <= least(abs(x - b), abs(x - c)) THEN 0 WHEN abs(x - b) <= abs(x - c) THEN 1 ELSE 2 END"


@query(f"""WITH RECURSIVE p AS (SELECT c_custkey, c_acctbal AS x FROM customer), m(k, a, b, c) AS (SELECT 0, 0.0::DOUBLE, 5000.0::DOUBLE, 9000.0::DOUBLE UNION ALL
  SELECT k + 1, coalesce(avg(x) FILTER (g = 0), a), coalesce(avg(x) FILTER (g = 1), b), coalesce(avg(x) FILTER (g = 2), c) FROM (SELECT *, {LLOYD} AS g FROM m, p WHERE k < 19) GROUP BY k, a, b, c)
SELECT c_custkey, CAST({LLOYD} AS INTEGER) AS cluster, round(least((x - a) ** 2, (x - b) ** 2, (x - c) ** 2), 2) AS distance2 FROM m, p WHERE k = 19""")
def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    """Lloyd's iterations from given centres."""
    df = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    found = estimators.KMeans(3, max_iter=20, tol=0.0, centres=[[0.0], [5000.0], [9000.0]]).fit_predict(df, ["c_acctbal"])
    return rounded(found.select("c_custkey", "cluster", "distance2"), 2)


def flat(spark: SparkSession, d: str, width: int = 64) -> tuple[DataFrame, list[str]]:
    names = [f"f{j}" for j in range(width)]
    e = t(spark, d, "embeddings")
    return e.select("vec_id", "label", *(F.get("embedding", j).cast("double").alias(n) for j, n in enumerate(names))), names


FLAT = "WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), u AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM e)"


@query(f"{FLAT} SELECT round(sum(w), 4) AS inertia FROM (SELECT var_pop(x) * count(*) AS w FROM u GROUP BY label, j)")
def cluster_inertia(spark: SparkSession, d: str) -> DataFrame:
    df, names = flat(spark, d)
    return rounded(metrics.inertia(df, names, "label"), 4)


@query(f"""{FLAT}, m AS (SELECT label, j, avg(x) AS m, count(*) AS c, var_pop(x) * count(*) AS w FROM u GROUP BY ALL), g AS (SELECT j, avg(x) AS g FROM u GROUP BY j)
SELECT round((sum(c * (m - g) ** 2) / (count(DISTINCT label) - 1)) / (sum(w) / ((SELECT count(*) FROM e) - count(DISTINCT label))), 4) AS calinski_harabasz FROM m JOIN g USING (j)""")
def cluster_calinski(spark: SparkSession, d: str) -> DataFrame:
    df, names = flat(spark, d)
    return rounded(metrics.calinski_harabasz(df, names, "label"), 4)


@query(f"""{FLAT}, m AS (SELECT label, j, avg(x) AS m FROM u GROUP BY ALL), dd AS (SELECT vec_id, label, sqrt(sum((x - m) ** 2)) AS d FROM u JOIN m USING (label, j) GROUP BY ALL),
s AS (SELECT label, avg(d) AS s FROM dd GROUP BY label), p AS (SELECT a.label AS i, b.label AS k, sqrt(sum((a.m - b.m) ** 2)) AS d FROM m a JOIN m b ON a.j = b.j AND a.label <> b.label GROUP BY ALL)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / d) AS r FROM p JOIN s x ON x.label = i JOIN s y ON y.label = k GROUP BY i)""")
def cluster_davies(spark: SparkSession, d: str) -> DataFrame:
    df, names = flat(spark, d)
    return rounded(metrics.davies_bouldin(df, names, "label"))


@query(f"""{FLAT}, p AS (SELECT a.vec_id, a.label AS l, b.label AS m, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2))) AS d FROM e a, e b),
s AS (SELECT vec_id, l, m, sum(d) AS s, count(*) AS n FROM p GROUP BY ALL),
f AS (SELECT vec_id, max(CASE WHEN l = m THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN l <> m THEN s / n END) AS b FROM s GROUP BY vec_id)
SELECT round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM f""")
def cluster_silhouette(spark: SparkSession, d: str) -> DataFrame:
    df, names = flat(spark, d)
    return rounded(metrics.silhouette(df, "vec_id", names, "label"))


@query("SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM embeddings), 6) AS percent FROM embeddings GROUP BY label")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.cluster_sizes(t(spark, d, "embeddings"), "label"))


def plane(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_nationkey") * 3.0).alias("y"))


PLANE = "WITH RECURSIVE p AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey * 3.0::DOUBLE AS y FROM customer), n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.1), k AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 4)"


@query(f"{PLANE} SELECT a, b FROM n")
def range_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return arrays.range_join(plane(spark, d), "x", "y", 1.1, "id")


@query(f"""{PLANE}, l AS (SELECT a, b FROM n WHERE a IN (SELECT a FROM k) AND b IN (SELECT a FROM k)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, dense_rank() OVER (ORDER BY min(b)) - 1 AS label FROM reach GROUP BY a),
o AS (SELECT n.a, min(label) AS label FROM n JOIN c ON n.b = c.a GROUP BY n.a)
SELECT id, CAST(coalesce(c.label, o.label, -1) AS BIGINT) AS label, c.label IS NOT NULL AS is_core FROM p LEFT JOIN c ON c.a = id LEFT JOIN o ON o.a = id""")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return estimators.dbscan(plane(spark, d), "id", ["x", "y"], 1.1, 4)


@query()
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    df, names = flat(spark, d)
    return estimators.PCA(2).fit(df, names).transform(df).select("vec_id", "pc0", "pc1")


def _logistic_sql(steps: int = 5, rate: float = 0.5) -> str:
    """Steps of gradient descent: a row of 65 weights a step."""
    w = [f"w{j}" for j in range(65)]
    z = " + ".join(["w0", *(f"w{j} * v[{j}]" for j in range(1, 65))])
    step = ", ".join(f"{c} - {rate} * avg((p - y){'' if not j else f' * v[{j}]'})" for j, c in enumerate(w))
    return f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(label < 5 AS INTEGER) AS y, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
w(k, {", ".join(w)}) AS (SELECT 0, {", ".join("0.0::DOUBLE" for _ in w)} UNION ALL
  SELECT k + 1, {step} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM w, e WHERE k < {steps}) GROUP BY k, {", ".join(w)})
SELECT vec_id, CAST({z} >= 0 AS INTEGER) AS prediction FROM w, e WHERE k = {steps}"""


@query(_logistic_sql())
def logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    df, names = flat(spark, d)
    df = df.withColumn("y", (F.col("label") < 5).cast("int"))
    return estimators.LogisticRegression(rate=0.5, max_iter=5, tol=0.0).fit(df, names, "y").predict(df).select("vec_id", "prediction")


@query()
def forest_fit(spark: SparkSession, d: str) -> DataFrame:
    df, names = flat(spark, d)
    return estimators.RandomForest(n_trees=20, max_depth=8).fit(df, names, "label").predict(df.select("vec_id", *names)).select("vec_id", "prediction")


@query()
def network_fit(spark: SparkSession, d: str) -> DataFrame:
    df, names = flat(spark, d)
    df = df.withColumn("y", (F.col("label") < 5).cast("double"))
    return Sequential([(8, "relu"), (1, "sigmoid")], loss="bce").fit(df, names, ["y"], epochs=10, optimizer=Adam(0.01)).predict(df.select("vec_id", *names)).select("vec_id", "p0")


ACTS = ["relu", "leaky_relu", "elu", "swish", "gelu", "sigmoid", "tanh"]
Z = "((o_totalprice % 1000) / 100 - 5)"
SIG = f"(1 / (1 + exp(-{Z})))"


@query(f"""SELECT o_orderkey, round(greatest({Z}, 0), 6) AS relu, round(CASE WHEN {Z} > 0 THEN {Z} ELSE 0.01 * {Z} END, 6) AS leaky_relu, round(CASE WHEN {Z} > 0 THEN {Z} ELSE exp({Z}) - 1 END, 6) AS elu,
round({Z} * {SIG}, 6) AS swish, round(0.5 * {Z} * (1 + tanh(sqrt(2 / pi()) * ({Z} + 0.044715 * {Z} ** 3))), 6) AS gelu, round({SIG}, 6) AS sigmoid, round(tanh({Z}), 6) AS tanh FROM orders""")
def activation_values(spark: SparkSession, d: str) -> DataFrame:
    known, z = scalars.Activations(), F.col("o_totalprice") % 1000 / 100 - 5
    return t(spark, d, "orders").select("o_orderkey", *(r(known.apply(n, z)).alias(n) for n in ACTS))


@query(f"""SELECT o_orderkey, CASE WHEN {Z} > 0 THEN 1.0::DOUBLE ELSE 0 END AS relu, round({SIG} * (1 - {SIG}), 6) AS sigmoid, round(1 - tanh({Z}) ** 2, 6) AS tanh, round({SIG} + {Z} * {SIG} * (1 - {SIG}), 6) AS swish FROM orders""")
def activation_slopes(spark: SparkSession, d: str) -> DataFrame:
    known, z = scalars.Activations(), F.col("o_totalprice") % 1000 / 100 - 5
    return t(spark, d, "orders").select("o_orderkey", *(r(known.slope(n, z)).alias(n) for n in ("relu", "sigmoid", "tanh", "swish")))


@query(f"""WITH e AS (SELECT event_id, value - 50 AS v FROM events)
SELECT event_id, round(v / CASE WHEN abs(event_id % 3 - 1) < 1e-8 THEN CASE WHEN event_id % 3 - 1 >= 0 THEN 1e-8 ELSE -1e-8 END ELSE event_id % 3 - 1 END, 2) AS ratio, round(CASE WHEN v < 0 THEN 0 ELSE sqrt(v) END, 6) AS root,
round(ln(greatest(v, 1e-8)), 6) AS log, CASE WHEN v > 1e-8 THEN 1.0::DOUBLE WHEN v < -1e-8 THEN -1.0::DOUBLE ELSE 0 END AS sign, least(10.0::DOUBLE, greatest(-10.0::DOUBLE, v)) AS clamped FROM e""")
def guarded_math(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") - 50
    e = t(spark, d, "events")
    return e.select("event_id", r(scalars.safe_div(v, (F.col("event_id") % 3 - 1).cast("double")), 2).alias("ratio"), r(scalars.safe_sqrt(v)).alias("root"), r(scalars.safe_log(v)).alias("log"), scalars.dead_sign(v).alias("sign"), scalars.clamp(v, -10.0, 10.0).alias("clamped"))


@query(f"WITH e AS ({EMB}) SELECT row_id, [round(exp(x - list_max(v)) / list_sum([exp(y - list_max(v)) for y in v]), 6) for x in v] AS p FROM e")
def softmax_rows(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("row_id", F.transform(scalars.softmax_row(F.col("values")), lambda x: F.round(x, 6)).alias("p"))


@query(f"WITH e AS ({EMB}) SELECT row_id, round(list_max(v) + ln(list_sum([exp(y - list_max(v)) for y in v])), 6) AS lse, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS top, CAST(list_position(v, list_min(v)) - 1 AS INTEGER) AS low FROM e")
def row_extremes(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return v.select("row_id", r(scalars.log_sum_exp(F.col("values"))).alias("lse"), arrays.arg_best(F.col("values"), F.array_max).alias("top"), arrays.arg_best(F.col("values"), F.array_min).alias("low"))


@query(f"WITH e AS ({EMB}) SELECT row_id, round(list_sum([x * x for x in v]), 6) AS dot, round(sqrt(list_sum([x * x for x in v])), 6) AS norm, round(v[1] / sqrt(list_sum([x * x for x in v])), 6) AS first FROM e")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("values")
    return vectors(spark, d).select("row_id", r(arrays.dot(v, v)).alias("dot"), r(arrays.norm(v)).alias("norm"), r(F.get(arrays.normalised(v), 0)).alias("first"))


PQ = "WITH l AS (SELECT CAST(quality AS DOUBLE) AS y, 0.1 + 0.8 * toxic AS p FROM labels)"


@query(f"""{PQ} SELECT round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS bce, round(avg((p - y) ** 2) / 2, 6) AS half_mse, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS cce,
round(sum(CASE WHEN y > 0 THEN -0.25 * (1 - p) ** 2 * ln(p) ELSE 0 END) / count(*), 6) AS focal FROM l""")
def loss_values(spark: SparkSession, d: str) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    df = t(spark, d, "labels").select(F.col("quality").cast("double").alias("y"), (0.1 + 0.8 * F.col("toxic")).alias("p"))
    return df.agg(r(losses.bce(y, p)).alias("bce"), r(losses.half_mse(y, p)).alias("half_mse"), r(losses.cce([y, 1 - y], [p, 1 - p])).alias("cce"), r(losses.focal(y, p)).alias("focal"))


DENSE = [[0.25 * (j % 5 - 2), 0.5 * (j % 3 - 1)] for j in range(64)]


@query(f"WITH e AS ({EMB}) SELECT row_id, [" + ", ".join(f"round(greatest(0, {' + '.join(f'{w[k]} * v[{j + 1}]' for j, w in enumerate(DENSE))} + {b}), 6)" for k, b in enumerate((0.1, -0.2))) + "] AS out FROM e")
def dense_forward(spark: SparkSession, d: str) -> DataFrame:
    z = arrays.dense_product(vectors(spark, d), DENSE, [0.1, -0.2])
    return z.select("row_id", F.transform("values", lambda v: F.round(F.greatest(v, F.lit(0.0)), 6)).alias("out"))


COO = "WITH c AS (SELECT i, CAST(unnest(range(64)) AS INTEGER) AS j, unnest(v) AS value FROM (SELECT vec_id AS i, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings))"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return matrices.to_coo(vectors(spark, d).select("row_id", "values"))


@query(f"{COO} SELECT CAST(a.j AS BIGINT) AS i, b.j, round(sum(a.value * b.value), 6) AS value FROM c a JOIN c b USING (i) GROUP BY a.j, b.j")
def matrix_product(spark: SparkSession, d: str) -> DataFrame:
    """The transpose of the embeddings' matrix times it: 64 x 64."""
    c = cells(spark, d)
    return rounded(arrays.matmul(arrays.transpose(c), c))


@query(f"{COO} SELECT CAST(j AS BIGINT) AS i, CAST(i AS INTEGER) AS j, value FROM c")
def matrix_transpose(spark: SparkSession, d: str) -> DataFrame:
    return arrays.transpose(cells(spark, d))


@query(f"{COO} SELECT CAST(floor((i * 64 + j) / 4) AS BIGINT) AS i, CAST((i * 64 + j) % 4 AS INTEGER) AS j, value FROM c")
def matrix_reshape(spark: SparkSession, d: str) -> DataFrame:
    return arrays.reshape(cells(spark, d), 64, 4)


@query(f"{COO} SELECT i, value FROM c WHERE i = j")
def matrix_diagonal(spark: SparkSession, d: str) -> DataFrame:
    return arrays.diagonal(cells(spark, d))


@query(f"WITH e AS ({EMB}) SELECT a.row_id, [round(a.v[k] - b.v[k], 6) for k in range(1, 65)] AS values FROM e a JOIN (SELECT row_id, [y * 0.5 for y in v] AS v FROM e) b USING (row_id)")
def matrix_difference(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("row_id", "values")
    signed = lambda x: F.signum(x) * F.round(F.abs(x), 6)  # noqa: E731  (a small negative cell gives -0.0, as in SQL)
    return arrays.elementwise(v, arrays.scalar(v, "mul", 0.5), "sub").select("row_id", F.transform("values", signed).alias("values"))


@query(f"WITH e AS ({EMB}) SELECT row_id, v[3:6] AS values FROM e WHERE row_id >= 10 AND row_id < 30")
def matrix_block(spark: SparkSession, d: str) -> DataFrame:
    return arrays.block(vectors(spark, d).select("row_id", "values"), 10, 30, 2, 6)


@query(f"WITH e AS ({EMB}) SELECT CAST(3 * row_id + k AS BIGINT) AS row_id, v AS values FROM e, range(2) t(k)")
def gather_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row twice, at positions of its own."""
    v = vectors(spark, d).select("row_id", "values")
    index = v.select("row_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select((3 * F.col("row_id") + F.col("k")).cast("bigint").alias("pos"), "row_id")
    return arrays.gather(v, index)


@query("SELECT CAST(k AS BIGINT) AS row_id, round(k / 500.0, 9) AS x, round(2 * k / 500.0 + 1 + 0.1 * sin(10 * k / 500.0) + 0.05 * cos(3 * k / 500.0), 9) AS y FROM range(500) t(k)")
def regression_demo(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrices.regression_demo(spark, 500), 9)


@query("SELECT 'linspace' AS kind, CAST(k AS BIGINT) AS row_id, round(k * 0.25, 9) AS value FROM range(5) t(k) UNION ALL SELECT 'arange', k, round(2 - k * 0.5, 9) FROM range(4) t(k)")
def number_ranges(spark: SparkSession, d: str) -> DataFrame:
    a = matrices.linspace(spark, 0, 1, 5).select(F.lit("linspace").alias("kind"), "row_id", "value")
    return rounded(a.unionByName(matrices.arange(spark, 2, 0, -0.5).select(F.lit("arange").alias("kind"), "row_id", "value")), 9)


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_discount * l_discount), 6) AS radius FROM lineitem")
def radial_feature(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arrays.with_radius(t(spark, d, "lineitem"), "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", "radius"))


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def hourly_drift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(drift(t(spark, d, "events"), "ts", "value"))


CELL = f"WITH e AS ({EMB}), u AS (SELECT row_id, unnest(range(64)) AS j, unnest(v) AS x FROM e)"


def listed(a: DataFrame, places: int = 6) -> DataFrame:
    return a.select("row_id", F.transform("values", lambda v: F.round(v, places) + 0.0).alias("values"))


@query(f"""{CELL}, m AS (SELECT j, avg(x) AS m, sqrt(var_pop(x) + 1e-5) AS s FROM u GROUP BY j)
SELECT row_id, list(round((x - m) / s, 6) + 0.0 ORDER BY j) AS values FROM u JOIN m USING (j) GROUP BY row_id""")
def batch_norm(spark: SparkSession, d: str) -> DataFrame:
    a = vectors(spark, d)
    return listed(layers.BatchNorm().fit(a).transform(a))


@query(f"""{CELL}, m AS (SELECT row_id, avg(x) AS m, sqrt(var_pop(x) + 1e-5) AS s FROM u GROUP BY row_id)
SELECT row_id, list(round((x - m) / s, 6) + 0.0 ORDER BY j) AS values FROM u JOIN m USING (row_id) GROUP BY row_id""")
def layer_norm(spark: SparkSession, d: str) -> DataFrame:
    return listed(layers.layer_norm(vectors(spark, d)))


@query(f"""{CELL} SELECT row_id, list(CASE WHEN CAST('0x' || substr(md5('42-' || row_id || '-' || j), 1, 8) AS BIGINT) / 4294967296.0 >= 0.25 THEN round(x * (1 / 0.75::DOUBLE), 6) + 0.0 ELSE 0.0::DOUBLE END ORDER BY j) AS values
FROM u GROUP BY row_id""")
def dropout(spark: SparkSession, d: str) -> DataFrame:
    return listed(layers.dropout(vectors(spark, d), 0.25))


@query(f"WITH e AS ({EMB}) SELECT row_id, [round(greatest(v[2 * k + 1], v[2 * k + 2]), 6) + 0.0 for k in range(32)] AS values FROM e")
def max_pool(spark: SparkSession, d: str) -> DataFrame:
    return listed(layers.max_pool(vectors(spark, d)))


@query(f"WITH e AS ({EMB}) SELECT row_id, [round(greatest(v[(k // 4) * 16 + (k % 4) * 2 + 1], v[(k // 4) * 16 + (k % 4) * 2 + 2], v[(k // 4) * 16 + (k % 4) * 2 + 9], v[(k // 4) * 16 + (k % 4) * 2 + 10]), 6) + 0.0 for k in range(16)] AS values FROM e")
def max_pool_squares(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as images of 8 x 8."""
    return listed(layers.max_pool2d(vectors(spark, d), 8, 8))


@query(f"""WITH e AS ({EMB}) SELECT row_id, [round(v[(k // 6) * 8 + k % 6 + 1] - v[(k // 6 + 2) * 8 + k % 6 + 3] + 0.5 * v[(k // 6 + 1) * 8 + k % 6 + 2] + 0.1, 6) + 0.0 for k in range(36)] AS values FROM e""")
def convolution(spark: SparkSession, d: str) -> DataFrame:
    """A 3 x 3 kernel over embeddings as images of 8 x 8."""
    kernel = np.array([[[[1.0, 0, 0], [0, 0.5, 0], [0, 0, -1.0]]]])
    return listed(layers.conv2d(vectors(spark, d), kernel, np.array([0.1]), 8, 8))


@query(f"""WITH e AS ({EMB}) SELECT row_id, [round(CASE WHEN CAST('0x' || substr(md5('42-' || row_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 THEN v[(k // 8) * 8 + 8 - k % 8] ELSE v[k + 1] END, 6) + 0.0 for k in range(64)] AS values FROM e""")
def flipped(spark: SparkSession, d: str) -> DataFrame:
    return listed(training.flip(8)(vectors(spark, d)))


@query("""SELECT round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS accuracy, round(avg(CAST((quality - toxic) ** 2 AS DOUBLE)), 6) AS mse, round(sqrt(avg(CAST((quality - toxic) ** 2 AS DOUBLE))), 6) AS rmse,
round(avg(CAST(abs(quality - toxic) AS DOUBLE)), 6) AS mae FROM labels""")
def model_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(training.evaluate(t(spark, d, "labels"), "quality", "toxic"))


@query()
def recurrent_states(spark: SparkSession, d: str) -> DataFrame:
    """The last state of an LSTM over embeddings as 8 steps of 8 values (weights by seed; tested against a loop)."""
    return listed(layers.recurrent(vectors(spark, d), 8, layers.gates(4, 8, 4)))


@query()
def transformer_states(spark: SparkSession, d: str) -> DataFrame:
    """One transformer block over embeddings as 8 steps of 8 values (weights by seed; tested against a loop)."""
    return listed(layers.transformer(vectors(spark, d), 8, [layers.transformer_weights(8, 16)], heads=2))
