"""Checks of shapes, options and models.  Driver-side checks raise ValueError; those of data raise when the plan runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import check_finite, clean, non_finite, require

#: Cells of all matrices together that an operation on the driver takes.
MAX_CELLS = 100_000_000


def shape(a: DataFrame) -> tuple[int, int]:
    """(rows, columns) of an ARRAY matrix, from one aggregate; rows of different widths raise."""
    r = a.agg(F.count("*").alias("n"), F.min(F.size("values")).alias("low"), F.max(F.size("values")).alias("high")).first()
    require(r["low"] == r["high"], "rows differ in width")
    return r["n"], r["high"] or 0


def shape_report(a: DataFrame) -> DataFrame:
    """One row: rows, columns, is_empty, is_square, is_vector."""
    s = a.agg(F.count("*").alias("n_rows"), F.coalesce(F.max(F.size("values")), F.lit(0)).cast("bigint").alias("n_cols"))
    n, m = F.col("n_rows"), F.col("n_cols")
    return s.select("n_rows", "n_cols", ((n == 0) | (m == 0)).alias("is_empty"), (n == m).alias("is_square"), ((n == 1) | (m == 1)).alias("is_vector"))


def is_empty(a: DataFrame) -> bool:
    return 0 in shape(a)


def is_square(a: DataFrame) -> bool:
    n, m = shape(a)
    return n == m


def is_vector(a: DataFrame) -> bool:
    return 1 in shape(a)


def check_input(a: DataFrame | None, width: int = -1) -> tuple[int, int]:
    """A matrix that is there, is not empty and has ``width`` columns (-1: any)."""
    require(a is not None, "no matrix")
    n, m = shape(a)
    require(n > 0 and m > 0, "the matrix is empty")
    require(width < 0 or m == width, f"{m} columns where {width} were expected")
    return n, m


def check_dimensions(a: tuple[int, int], b: tuple[int, int], operation: str) -> None:
    """Equal shapes for add, sub, mul_elem, div, equal; an equal inner dimension for mul; other operations take any."""
    if operation in ("add", "sub", "mul_elem", "div", "equal"):
        require(a == b, f"{operation} of shapes {a} and {b}")
    elif operation == "mul":
        require(a[1] == b[0], f"mul of shapes {a} and {b}")


def check_square(a: DataFrame, name: str = "matrix") -> None:
    n, m = shape(a)
    require(n == m, f"{name} is not square: {n} x {m}")


def check_vector(a: DataFrame, name: str = "matrix") -> None:
    require(1 in shape(a), f"{name} is no vector")


def check_scalar(value: float, name: str = "value") -> None:
    require(math.isfinite(value), f"{name} is not finite: {value}")


def check_between(value: float, low: float, high: float, name: str = "value") -> None:
    require(low <= value <= high, f"{name} is outside [{low}, {high}]: {value}")


def check_positive(value: float, name: str = "value") -> None:
    require(value > 0, f"{name} must be positive: {value}")


def check_not_negative(value: float, name: str = "value") -> None:
    require(value >= 0, f"{name} must not be negative: {value}")


def check_whole(value: int, low: int, high: int, name: str = "value") -> None:
    require(isinstance(value, int) and not isinstance(value, bool) and low <= value <= high, f"{name} is no whole number in [{low}, {high}]: {value!r}")


def check_one_of(value: str, allowed: list[str], name: str = "value") -> None:
    require(value in allowed, f"{name} must be one of {allowed}: {value!r}")


def check_not_empty(values: list, name: str = "list") -> None:
    require(len(values) > 0, f"{name} is empty")


def check_state(operation: str, compiled: bool, fitted: bool) -> None:
    """fit needs a compiled model; predict, evaluate and score need a fitted one too."""
    require(compiled, f"{operation} needs a compiled model")
    require(operation == "fit" or fitted, f"{operation} needs a fitted model")


def check_not_fitted(fitted: bool) -> None:
    require(not fitted, "the model is fitted already")


def check_training(options: dict) -> None:
    """rate > 0, epochs and batch_size whole and > 0, betas and split in [0, 1); other keys are left alone."""
    if "rate" in options:
        check_positive(options["rate"], "rate")
    for name in ("epochs", "batch_size"):
        if name in options:
            check_whole(options[name], 1, 1 << 62, name)
    for name in ("beta1", "beta2", "validation"):
        if name in options:
            require(0 <= options[name] < 1, f"{name} must be in [0, 1): {options[name]}")


def check_memory(shapes: list[tuple[int, int]], operation: str) -> None:
    """For operations on the driver: cells of all matrices together are at most MAX_CELLS."""
    cells = sum(n * m for n, m in shapes)
    require(cells <= MAX_CELLS, f"{operation} holds {cells} cells on the driver, more than {MAX_CELLS}")


def check_aligned(x: DataFrame, y: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows of x with those of y beside them; a key that only one side has raises when the plan runs."""
    both = x.withColumn("_in_x", F.lit(True)).join(y.withColumn("_in_y", F.lit(True)), key, "full")
    same = F.assert_true(F.col("_in_x").isNotNull() & F.col("_in_y").isNotNull(), "rows differ")
    return both.where(same.isNull()).drop("_in_x", "_in_y")


def check_then_clean(df: DataFrame, columns: list[str], strategy: str = "") -> DataFrame:
    """Clean rows as they are; dirty ones cleaned by ``strategy``, or without one an error when the plan runs."""
    return clean(df, columns, strategy) if strategy else check_finite(df, columns)


def check_clusters(df: DataFrame, columns: list[str], label: str) -> None:
    """Every row has a label and finite values."""
    bad = non_finite(df, columns).agg(F.sum(F.col("n_nan") + F.col("n_inf"))).first()[0]
    require(not bad, f"{bad} cells are not finite")
    require(not df.where(F.col(label).isNull()).take(1), "a row has no label")
