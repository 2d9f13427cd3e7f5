"""Sources and sinks: strict CSV, nested lists, generators, JSON settings, matrices in three layouts.

WIDE has a column a feature, ARRAY one array a row (row_id, values), COO one row a cell (i, j, value).
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A header and numeric fields of exactly these columns; anything else fails the read."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def from_rows(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """ARRAY layout from nested lists, which must be non-empty and of one width."""
    if not rows or not rows[0]:
        raise ValueError("a matrix needs a row and a column")
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("rows differ in width")
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "row_id bigint, values array<double>")


def from_flat(spark: SparkSession, n_rows: int, n_cols: int, data: list[float]) -> DataFrame:
    if len(data) != n_rows * n_cols:
        raise ValueError("the buffer does not fit the shape")
    return from_rows(spark, [data[i * n_cols : (i + 1) * n_cols] for i in range(n_rows)])


def filled(spark: SparkSession, n_rows: int, n_cols: int, value: float) -> DataFrame:
    return spark.range(n_rows).select(F.col("id").alias("row_id"), F.array_repeat(F.lit(float(value)), n_cols).alias("values"))


def linspace(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    """n evenly spaced values with both ends; none for n <= 0, the start for 1."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return spark.range(max(n, 0)).select(F.col("id").alias("row_id"), (F.lit(float(start)) + F.col("id") * step).alias("value"))


def arange(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    """Half-open; each value is start + k * step, without accumulated rounding."""
    if step == 0:
        raise ValueError("step must not be 0")
    n = max(0, math.ceil((stop - start) / step))
    return spark.range(n).select(F.col("id").alias("row_id"), (F.lit(float(start)) + F.col("id") * float(step)).alias("value"))


def to_arrays(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("row_id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("values"))


def to_wide(arrays: DataFrame, columns: list[str]) -> DataFrame:
    return arrays.select("row_id", *(F.element_at("values", j + 1).alias(c) for j, c in enumerate(columns)))


def to_coo(arrays: DataFrame) -> DataFrame:
    return arrays.select(F.col("row_id").alias("i"), F.posexplode("values").alias("j", "value"))


def from_coo(cells: DataFrame) -> DataFrame:
    """Rows with their cells in column order; a row's cells are bounded by the width."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda s: s["value"])
    return cells.groupBy(F.col("i").alias("row_id")).agg(ordered.alias("values"))


def cluster_demo(spark: SparkSession, n: int, centres: list[tuple[float, float]], spread: float = 0.5, seed: int = 42) -> DataFrame:
    """Normal points round given centres, dealt in turn."""
    k = F.pmod(F.col("id"), F.lit(len(centres))).cast("int")
    xs, ys = (F.array(*(F.lit(float(c[d])) for c in centres)) for d in range(2))
    return spark.range(n).select(
        F.col("id").alias("row_id"), (F.get(xs, k) + spread * F.randn(seed)).alias("f0"), (F.get(ys, k) + spread * F.randn(seed + 1)).alias("f1"), k.alias("label")
    )


def regression_demo(spark: SparkSession, n: int) -> DataFrame:
    """A deterministic line with waves: y = 2 x + 1 + 0.1 sin(10 x) + 0.05 cos(3 x)."""
    x = F.col("id") / F.lit(float(n))
    return spark.range(n).select(F.col("id").alias("row_id"), x.alias("x"), (2 * x + 1 + 0.1 * F.sin(10 * x) + 0.05 * F.cos(3 * x)).alias("y"))


@dataclass(frozen=True)
class Settings:
    """Engine settings; every value is checked on load."""

    epsilon: float = 1e-8
    max_value: float = 1e10
    min_value: float = -1e10
    seed: int = 42

    def check(self) -> Settings:
        if not self.epsilon > 0 or not self.max_value > self.min_value:
            raise ValueError(f"settings out of range: {self}")
        return self

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> Settings:
        known = json.loads(Path(path).read_text())
        if missing := [f.name for f in fields(cls) if f.name not in known]:
            raise ValueError(f"settings lack {missing}")
        return cls(**{f.name: known[f.name] for f in fields(cls)}).check()
