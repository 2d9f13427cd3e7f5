"""Statistics, validation, cleaning and data-quality profiles: one aggregate a table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPSILON, is_finite


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: n, sum, mean, population std, sample variance, min, max; all from one scan."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            F.struct(
                F.lit(c).alias("feature"), F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
                F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"), F.min(x).alias("low"), F.max(x).alias("high"),
            )
        ]
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def percentiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation; shares outside [0, 100] take the ends."""
    p = [min(100.0, max(0.0, s)) / 100 for s in shares]
    return df.agg(F.percentile(F.col(column), p).alias("p")).select(F.posexplode("p").alias("k", "value"))


def frobenius(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.sqrt(sum((F.sum(F.col(c) * F.col(c)) for c in columns[1:]), F.sum(F.col(columns[0]) * F.col(columns[0])))).alias("norm"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs from one scan; 0 where a column does not vary."""

    def corr(a: str, b: str) -> Column:
        spread = F.stddev_pop(a) * F.stddev_pop(b)
        return F.when(spread < EPSILON, 0.0).otherwise(F.coalesce(F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)), F.lit(0.0)))

    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(a, b).alias("corr")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(a, b).alias("cov")) for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of NaN and infinite cells by column."""
    inf = float("inf")
    each = [F.struct(F.lit(c).alias("feature"), F.sum(F.isnan(c).cast("bigint")).alias("n_nan"), F.sum((F.abs(F.col(c)) == inf).cast("bigint")).alias("n_inf")) for c in columns]
    return df.agg(F.array(*each).alias("s")).select(F.inline("s"))


def check_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; the first NaN or infinite cell raises."""
    ok = is_finite(F.col(columns[0]))
    for c in columns[1:]:
        ok = ok & is_finite(F.col(c))
    return df.where(F.assert_true(ok, "a value is not finite").isNull())


def check_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.assert_true(F.col(column).between(low, high), f"{column} is outside [{low}, {high}]").isNull())


def require(ok: bool, message: str) -> None:
    """Checks of options and shapes on the driver raise ValueError."""
    if not ok:
        raise ValueError(message)


def clean(df: DataFrame, columns: list[str], strategy: str) -> DataFrame:
    """Replace NaN and infinities: ``zero``; ``mean`` of the column's finite values (0 of none); ``clamp`` to 0, 1e6, -1e6."""
    require(strategy in ("zero", "mean", "clamp"), f"unknown strategy {strategy!r}")

    def fixed(c: str, bad: Column) -> Column:
        x = F.col(c)
        return F.when(is_finite(x), x).otherwise(bad).alias(c)

    rest = [F.col(c) for c in df.columns if c not in columns]
    if strategy == "zero":
        return df.select(*rest, *(fixed(c, F.lit(0.0)) for c in columns))
    if strategy == "clamp":
        return df.select(*rest, *(fixed(c, F.when(F.isnan(c), 0.0).when(F.col(c) > 0, 1e6).otherwise(-1e6)) for c in columns))
    means = df.agg(*(F.coalesce(F.avg(F.when(is_finite(F.col(c)), F.col(c))), F.lit(0.0)).alias(f"_mean_{c}") for c in columns))
    return df.join(F.broadcast(means)).select(*rest, *(fixed(c, F.col(f"_mean_{c}")) for c in columns))  # one row


def constant_features(df: DataFrame, columns: list[str]) -> DataFrame:
    each = [F.struct(F.lit(c).alias("feature"), ((F.max(c) - F.min(c)) < EPSILON).alias("is_constant")) for c in columns]
    return df.agg(F.array(*each).alias("s")).select(F.inline("s"))


def label_report(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of the rounded labels."""
    n = df.groupBy(F.round(F.col(label)).cast("int").alias("label")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("t")).alias("share"))


def label_quality(df: DataFrame, label: str) -> DataFrame:
    """One row: classes, smallest and largest count, whether valid (two classes) and severely imbalanced (below 0.1)."""
    n = df.groupBy(F.round(F.col(label)).cast("int").alias("label")).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_classes"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).select(
        "n_classes", "smallest", "largest", (F.col("n_classes") > 1).alias("is_valid"), (F.col("smallest") < 0.1 * F.col("largest")).alias("is_imbalanced")
    )


def quality_report(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    """A row a finding: dirty columns, constant columns, pairs correlated beyond the limit."""
    dirty = non_finite(df, columns).where("n_nan + n_inf > 0").select(F.lit("not_finite").alias("finding"), "feature", F.lit(None).cast("string").alias("other"))
    flat = constant_features(df, columns).where("is_constant").select(F.lit("constant").alias("finding"), "feature", F.lit(None).cast("string").alias("other"))
    close = correlations(df, columns).where(F.abs("corr") > limit).select(F.lit("correlated").alias("finding"), F.col("a").alias("feature"), F.col("b").alias("other"))
    return dirty.unionByName(flat).unionByName(close)
