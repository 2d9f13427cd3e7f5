"""Metrics of classification, regression and clustering, each as few aggregates as it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPSILON
from .arrays import sums_above
from .pairs import label_sums


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) of int-truncated labels that occur."""
    return df.groupBy(F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """A row a class (union of both sides): tp, fp, fn, tn, precision, recall, f1, support; undefined is 0."""
    m = confusion(df, truth, predicted)
    side = m.select(F.col("truth").alias("class"), "n", (F.col("truth") == F.col("predicted")).alias("hit"), F.lit(True).alias("real"))
    side = side.unionByName(m.where("truth <> predicted").select(F.col("predicted").alias("class"), "n", F.lit(False).alias("hit"), F.lit(False).alias("real")))
    c = side.groupBy("class").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("real"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("real") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fn"),
    )
    total = m.agg(F.sum("n").alias("t"))
    c = c.join(F.broadcast(total)).select("class", "tp", "fp", "fn", (F.col("t") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumn("precision", p).withColumn("recall", r)
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


def macro(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and the means over all classes, undefined ones as 0."""
    c = class_report(df, truth, predicted)
    return c.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def headline(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: precision and recall of the larger of two classes, else means over the defined ones; f1 of these two."""
    c = class_report(df, truth, predicted)
    pd, rd = F.when(F.col("tp") + F.col("fp") > 0, F.col("precision")), F.when(F.col("tp") + F.col("fn") > 0, F.col("recall"))
    out = c.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.when(F.count("*") == 2, F.max_by("precision", "class")).otherwise(F.coalesce(F.avg(pd), F.lit(0.0))).alias("precision"),
        F.when(F.count("*") == 2, F.max_by("recall", "class")).otherwise(F.coalesce(F.avg(rd), F.lit(0.0))).alias("recall"),
    )
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr): the origin with threshold infinity, then a point a distinct score, descending.

    Rows are summed by score first, and distinct scores are summed within ranges, so no task has them all.  A rate of a class
    that does not occur is 0.
    """
    by = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum((F.col(truth).cast("int") == 1).cast("bigint")).alias("p"), F.sum((F.col(truth).cast("int") != 1).cast("bigint")).alias("q")
    )
    total = by.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    points = sums_above(by, "threshold", ["p", "q"]).join(F.broadcast(total))
    tpr, fpr = ratio(F.col("above_p") + F.col("p"), F.col("tp")), ratio(F.col("above_q") + F.col("q"), F.col("tq"))
    points = points.select("threshold", tpr.alias("tpr"), fpr.alias("fpr"))
    return df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")).unionByName(points)


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks: each score's negatives under the positives above and half of its own; 0 of one class."""
    by = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum((F.col(truth).cast("int") == 1).cast("bigint")).alias("p"), F.sum((F.col(truth).cast("int") != 1).cast("bigint")).alias("q")
    )
    won = F.sum(F.col("q") * (F.col("above_p") + F.col("p") / 2))
    return sums_above(by, "s", ["p"]).agg(F.coalesce(ratio(won, F.sum("p") * F.sum("q")), F.lit(0.0)).alias("auc"))


def regression(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: mse, rmse, mae, r2 (1 where the truth does not vary), mape in percent, explained variance."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    d = y - p
    out = df.agg(
        F.avg(d * d).alias("mse"),
        F.avg(F.abs(d)).alias("mae"),
        F.sum(d * d).alias("_res"),
        (F.var_pop(y) * F.count(y)).alias("_tot"),
        F.coalesce(100 * F.avg(F.when(F.abs(y) > EPSILON, F.abs(d / y))), F.lit(0.0)).alias("mape"),
    )
    r2 = F.when(F.col("_tot") == 0, 1.0).otherwise(1 - F.col("_res") / F.col("_tot"))
    return out.select("mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "mape", r2.alias("explained_variance"))


def residuals(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    d = F.col(truth) - F.col(predicted)
    q = F.percentile(d, [0.25, 0.5, 0.75])
    return df.agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("low"), F.max(d).alias("high"), q.alias("_q")).select(
        "mean", "std", "low", "high", *(F.get("_q", k).alias(f"q{k + 1}") for k in range(3))
    )


def gap(train_r2: float, test_r2: float) -> str:
    """What the difference of two R2 says."""
    d = train_r2 - test_r2
    return "overfit" if d > 0.1 else "underfit" if d < -0.05 else "balanced"



def inertia(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Sum of squared distances to the cluster means, noise (label < 0) left out; from one pass of moments."""
    m = df.where(F.col(label) >= 0).groupBy(label).agg(*((F.var_pop(c) * F.count(c)).alias(f"v{i}") for i, c in enumerate(columns)))
    return m.agg(sum((F.sum(f"v{i}") for i in range(1, len(columns))), F.sum("v0")).alias("inertia"))


def calinski_harabasz(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(between / (k - 1)) / (within / (n - k)); n counts noise rows too; within 0 gives infinity, one cluster or one row a cluster 0."""
    m = df.where(F.col(label) >= 0).groupBy(label).agg(
        F.count("*").alias("c"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(columns)), *((F.var_pop(x) * F.count(x)).alias(f"v{i}") for i, x in enumerate(columns))
    )
    centre = df.where(F.col(label) >= 0).agg(*(F.avg(x).alias(f"g{i}") for i, x in enumerate(columns)))
    n = df.agg(F.count("*").alias("n"))
    k = range(len(columns))
    d = [(F.col(f"m{i}") - F.col(f"g{i}")) * (F.col(f"m{i}") - F.col(f"g{i}")) for i in k]
    s = m.join(F.broadcast(centre)).agg(
        F.sum(F.col("c") * sum(d[1:], d[0])).alias("b"), sum((F.sum(f"v{i}") for i in k[1:]), F.sum("v0")).alias("w"), F.count("*").alias("k")
    )
    score = (F.col("b") / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(F.col("w") / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0))
    undefined = F.when((F.col("k") < 2) | (F.col("n") <= F.col("k")), F.lit(0.0)).when(F.col("w") == 0, F.lit(float("inf")))
    return s.join(F.broadcast(n)).select(undefined.otherwise(score).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Mean over clusters of the largest (s_i + s_j) / d_ij; pairs at distance 0 are skipped."""
    own = df.where(F.col(label) >= 0).withColumn("_v", F.array(*(F.col(c).cast("double") for c in columns)))
    m = own.groupBy(label).agg(F.array(*(F.avg(c) for c in columns)).alias("m"))  # a row a cluster
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v))
    s = own.join(F.broadcast(m), label).groupBy(label).agg(F.avg(dist(F.col("_v"), F.col("m"))).alias("s"))
    c = m.join(s, label)
    a, b = c.select(F.col(label).alias("i"), F.col("m").alias("mi"), F.col("s").alias("si")), c.select(F.col(label).alias("j"), F.col("m").alias("mj"), F.col("s").alias("sj"))
    pairs = a.join(b, F.col("i") != F.col("j")).withColumn("d", dist(F.col("mi"), F.col("mj")))  # clusters, not rows
    worst = pairs.groupBy("i").agg(F.coalesce(F.max(F.when(F.col("d") > 0, (F.col("si") + F.col("sj")) / F.col("d"))), F.lit(0.0)).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def silhouette(df: DataFrame, key: str, columns: list[str], label: str, blocks: int | None = None) -> DataFrame:
    """One row: the mean of (b - a) / max(a, b) over the rows of clusters; a singleton has a = 0.

    Exact Euclidean means need every distance: blocks of rows meet in pairs, and give each row's sums by label.  A row
    with a null cell counts as 0, and among the rows of its cluster.
    """
    own = df.where(F.col(label) >= 0).select(F.col(key).alias("key"), F.col(label).alias("label"), F.array(*(F.col(c).cast("double") for c in columns)).alias("values"))
    sizes = own.groupBy("label").agg(F.count("*").alias("n"))
    total, holes = own.select(F.count("*"), F.count_if(F.exists("values", F.isnull))).first()
    parts = label_sums(own.where(~F.exists("values", F.isnull)), total, blocks)
    sums = parts.groupBy("key", "label", "label2").agg(F.sum("s").alias("s")).join(sizes.withColumnRenamed("label", "label2"), "label2")
    same = F.col("label") == F.col("label2")
    a = F.max(F.when(same, F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).otherwise(0.0)))
    each = sums.groupBy("key").agg(a.alias("a"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"))
    top = F.greatest("a", "b")
    one = F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return each.agg((F.coalesce(F.sum(one), F.lit(0.0)) / F.nullif(F.count(one) + holes, F.lit(0))).alias("silhouette"))


def accuracy(df: DataFrame, truth: str, predicted: str, eps: float = EPSILON) -> DataFrame:
    """Share of rows whose values agree within eps; 0 of no rows."""
    return df.agg(F.coalesce(F.avg((F.abs(F.col(truth).cast("double") - F.col(predicted)) < eps).cast("double")), F.lit(0.0)).alias("accuracy"))


def for_class(df: DataFrame, truth: str, predicted: str, positive: float, eps: float = 1e-10) -> DataFrame:
    """One row for an explicit positive class: tp, fp, fn, tn, accuracy, precision, recall, f1; undefined is 0."""
    t, p = F.abs(F.col(truth).cast("double") - positive) < eps, F.abs(F.col(predicted).cast("double") - positive) < eps
    c = df.agg(*(F.count_if(x).alias(n) for n, x in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))), accuracy_of(truth, predicted, eps).alias("accuracy"))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy_of(truth: str, predicted: str, eps: float) -> Column:
    return F.coalesce(F.avg((F.abs(F.col(truth).cast("double") - F.col(predicted)) < eps).cast("double")), F.lit(0.0))


def training_accuracy(df: DataFrame, truth: Column, outputs: list[Column]) -> DataFrame:
    """One output: at 0.5; several: the first largest, against the class number."""
    if len(outputs) == 1:
        hit = (outputs[0] >= 0.5).cast("int") == (truth >= 0.5).cast("int")
    else:
        all_ = F.array(*outputs)
        hit = F.array_position(all_, F.array_max(all_)) - 1 == truth
    return df.agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("accuracy"))


def binary_check(df: DataFrame, truth: str) -> DataFrame:
    """One row: whether there are exactly two classes."""
    return df.agg((F.count_distinct(F.col(truth).cast("int")) == 2).alias("is_binary"))


def with_probability(df: DataFrame, truth: str, predicted: str, score: str) -> DataFrame:
    """The headline metrics, and the area under the ROC curve where there are exactly two classes (else null)."""
    out = headline(df, truth, predicted).join(F.broadcast(auc(df, truth, score))).join(F.broadcast(binary_check(df, truth)))
    return out.withColumn("auc", F.when(F.col("is_binary"), F.col("auc"))).drop("is_binary")


def regression_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: the regression metrics, the residuals' spread, the rows."""
    rows = df.agg(F.count("*").alias("n_rows"))
    return regression(df, truth, predicted).join(F.broadcast(residuals(df, truth, predicted))).join(F.broadcast(rows))


def centred_explained_variance(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """1 - var(truth - predicted) / var(truth); 1 where the truth does not vary."""
    d = F.col(truth).cast("double") - F.col(predicted)
    out = df.agg(F.var_pop(d).alias("_d"), F.var_pop(F.col(truth).cast("double")).alias("_t"))
    return out.select(F.when(F.col("_t") == 0, 1.0).otherwise(1 - F.col("_d") / F.nullif("_t", F.lit(0.0))).alias("explained_variance"))


def fold_summary(df: DataFrame, score: str) -> DataFrame:
    """One row of given fold scores: n, mean, population std, low, high."""
    s = F.col(score)
    return df.agg(F.count(s).alias("n"), F.coalesce(F.avg(s), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(s), F.lit(0.0)).alias("std"), F.min(s).alias("low"), F.max(s).alias("high"))


def calinski_band(score: float) -> str:
    return "strong" if score > 100 else "reasonable" if score > 50 else "weak" if score > 20 else "very weak"


def davies_band(score: float) -> str:
    """Lower is better."""
    return "excellent" if score < 0.5 else "good" if score < 1.0 else "fair" if score < 2.0 else "poor"


def band(score: float) -> str:
    """How strong a silhouette is."""
    return "strong" if score > 0.7 else "reasonable" if score > 0.5 else "weak" if score > 0.25 else "very weak"


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select("label", "n", (100 * F.col("n") / F.col("t")).alias("percent"))
