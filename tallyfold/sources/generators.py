"""Generated tables and samples.  Randomness is a hash of seed, stream and row, so that a value depends on nothing else and SQL agrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, key: Column) -> Column:
    """In [0, 1): the first 32 bits of md5(seed-stream-key)."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(stream), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(seed: int, stream: str, key: Column) -> Column:
    """Standard normal, by the cosine branch of two uniforms."""
    u = F.greatest(uniform(seed, f"{stream}a", key), F.lit(2.0**-33))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * uniform(seed, f"{stream}b", key))


def _rows(spark: SparkSession, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("a sample has 0 rows or more")
    return spark.range(n).withColumnRenamed("id", "row_id")


def uniform_sample(spark: SparkSession, n: int, low: float, high: float, seed: int = 42) -> DataFrame:
    return _rows(spark, n).withColumn("value", low + (high - low) * uniform(seed, "u", F.col("row_id")))


def normal_sample(spark: SparkSession, n: int, mean: float, std: float, seed: int = 42) -> DataFrame:
    return _rows(spark, n).withColumn("value", mean + std * normal(seed, "n", F.col("row_id")))


def integer_sample(spark: SparkSession, n: int, low: int, high: int, seed: int = 42) -> DataFrame:
    """Whole numbers in [low, high)."""
    if high <= low:
        raise ValueError("the range is empty")
    return _rows(spark, n).withColumn("value", (low + F.floor((high - low) * uniform(seed, "i", F.col("row_id")))).cast("bigint"))


def matrix_sample(spark: SparkSession, n: int, width: int, low: float = 0.0, high: float = 1.0, seed: int = 42) -> DataFrame:
    """ARRAY matrix of uniform cells."""
    cells = F.array(*(low + (high - low) * uniform(seed, f"c{j}", F.col("row_id")) for j in range(width)))
    return _rows(spark, n).withColumn("values", cells)


def sequence_matrix(spark: SparkSession, n: int, width: int) -> DataFrame:
    """ARRAY matrix of 1, 2, 3, ... by rows."""
    return _rows(spark, n).withColumn("values", F.array(*((F.col("row_id") * width + j + 1).cast("double") for j in range(width))))


def edge_matrix(spark: SparkSession) -> DataFrame:
    """One row of values that trip arithmetic."""
    inf = float("inf")
    return spark.createDataFrame([(0, [0.0, -0.0, float("nan"), inf, -inf, 5e-324, 1.7976931348623157e308, -1.7976931348623157e308])], "row_id bigint, values array<double>")


def choice(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement (all, if there are fewer): those of the lowest hash."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``position``: the place of each row in the order of its hash."""
    from ..operators.prep import hashed_rank

    return hashed_rank(df, key, seed).withColumn("position", F.col("_k") - 1).drop("_k")


def xor(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Points in [-1, 1] x [-1, 1] with noise; label 1 where the noisy coordinates differ in sign."""
    k = F.col("row_id")
    x, y = (2 * uniform(seed, c, k) - 1 + noise * normal(seed, f"{c}n", k) for c in "xy")
    out = _rows(spark, n).select("row_id", x.alias("f0"), y.alias("f1"))
    return out.withColumn("label", ((F.col("f0") > 0) != (F.col("f1") > 0)).cast("int"))


def circles(spark: SparkSession, n: int, noise: float = 0.0, factor: float = 0.5, seed: int = 42) -> DataFrame:
    """The first half on a circle of radius 1 (label 0), the rest on one of radius ``factor`` (label 1)."""
    half = n // 2
    k, inner = F.col("row_id"), F.col("row_id") >= half
    angle = 2 * math.pi * F.when(inner, (k - half) / max(n - half, 1)).otherwise(k / max(half, 1))
    radius = F.when(inner, factor).otherwise(1.0)
    return _rows(spark, n).select(
        "row_id", (radius * F.cos(angle) + noise * normal(seed, "x", k)).alias("f0"), (radius * F.sin(angle) + noise * normal(seed, "y", k)).alias("f1"), inner.cast("int").alias("label")
    )


def blobs(spark: SparkSession, n: int, width: int, centres: int, spread: float = 1.0, seed: int = 42) -> DataFrame:
    """ARRAY points round ``centres`` places in [-10, 10], n // centres each; rows left over are zeros of label 0."""
    if centres < 1:
        raise ValueError("at least one centre")
    each, k = n // centres, F.col("row_id")
    label = F.when(k < each * centres, F.floor(k / max(each, 1))).otherwise(0).cast("int")
    at = [20 * uniform(seed, f"m{j}", label) - 10 + spread * normal(seed, f"p{j}", k) for j in range(width)]
    return _rows(spark, n).select("row_id", F.array(*(F.when(k < each * centres, v).otherwise(0.0) for v in at)).alias("values"), label.alias("label"))


def spiral(spark: SparkSession, n: int, classes: int, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """n // classes points a class on arms that turn by four radians while the radius grows from 0 to 1."""
    each, k = max(n // classes, 1), F.col("row_id")
    label, step = F.floor(k / each).cast("int"), F.pmod(k, F.lit(each)) / each
    angle = 4 * (label + step) + noise * normal(seed, "t", k)
    return _rows(spark, n // classes * classes).select("row_id", (step * F.sin(angle)).alias("f0"), (step * F.cos(angle)).alias("f1"), label.alias("label"))
