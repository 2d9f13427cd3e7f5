"""Matrix operators: row-aligned arithmetic, gathers, products, distances and joins on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import EPSILON, safe_div
from ..sources.matrices import to_coo
from .pairs import range_pairs

Pair = Callable[[Column, Column], Column]
ARITHMETIC: dict[str, Pair] = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: safe_div(a, b)}

#: Pairs that a product of blocks does in the time of one of a join.
PRODUCT = 100


def elementwise(a: DataFrame, b: DataFrame, op: str | Pair) -> DataFrame:
    """Cell by cell of two ARRAY matrices with the same rows and width."""
    f = ARITHMETIC[op] if isinstance(op, str) else op
    both = a.join(b.withColumnRenamed("values", "_other"), "row_id", "full")
    same = F.assert_true(F.size("values").eqNullSafe(F.size("_other")), "shapes differ")
    return both.select("row_id", F.when(same.isNull(), F.zip_with("values", "_other", f)).alias("values"))


def apply(a: DataFrame, f: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """f(row, column, value) of every cell."""
    return a.select("row_id", F.transform("values", lambda v, j: f(F.col("row_id"), j, v)).alias("values"))


def scalar(a: DataFrame, op: str, k: float) -> DataFrame:
    if op == "div" and abs(k) < EPSILON:
        raise ZeroDivisionError("division by a scalar near 0")
    f = {"add": lambda v: v + k, "sub": lambda v: v - k, "mul": lambda v: v * k, "div": lambda v: v / k, "pow": lambda v: F.pow(v, F.lit(float(k)))}[op]
    return a.select("row_id", F.transform("values", f).alias("values"))


def block(a: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Half-open rows [r0, r1) and columns [c0, c1)."""
    return a.where((F.col("row_id") >= r0) & (F.col("row_id") < r1)).select("row_id", F.slice("values", c0 + 1, c1 - c0).alias("values"))


def gather(a: DataFrame, index: DataFrame) -> DataFrame:
    """Rows by an index (pos, row_id): order kept by ``pos``, repeats allowed, an unknown row raises."""
    out = index.join(a, "row_id", "left")
    known = F.assert_true(F.col("values").isNotNull(), "index out of range")
    return out.where(known.isNull()).select(F.col("pos").alias("row_id"), "values")


def diagonal(cells: DataFrame) -> DataFrame:
    return cells.where("i = j").select("i", "value")


def absolute(a: DataFrame) -> DataFrame:
    return a.select("row_id", F.transform("values", F.abs).alias("values"))


def fill(a: DataFrame, k: float = 0.0) -> DataFrame:
    """Every cell k."""
    return a.select("row_id", F.transform("values", lambda v: F.lit(float(k))).alias("values"))


def cell(a: DataFrame, i: int, j: int) -> DataFrame:
    """One row with the value at (i, j); a place outside the matrix raises."""
    out = a.where(F.col("row_id") == i).agg(F.max(F.get("values", j)).alias("value"), F.max((F.size("values") > j) & F.lit(j >= 0)).alias("_in"))
    return out.where(F.assert_true(F.coalesce("_in", F.lit(False)), "no such cell").isNull()).select("value")


def set_cell(a: DataFrame, i: int, j: int, value: float) -> DataFrame:
    """The matrix with one cell replaced; without a cell (i, j) it stays as it is."""
    changed = F.transform("values", lambda v, k: F.when(k == j, F.lit(float(value))).otherwise(v))
    return a.select("row_id", F.when(F.col("row_id") == i, changed).otherwise(F.col("values")).alias("values"))


def set_column(a: DataFrame, j: int, column: DataFrame) -> DataFrame:
    """Column j from (row_id, value); a row that only one side has raises."""
    both = a.join(column.withColumnRenamed("value", "_value"), "row_id", "full")
    same = F.assert_true(F.col("values").isNotNull() & F.col("_value").isNotNull(), "the column does not fit the rows")
    return both.where(same.isNull()).select("row_id", F.transform("values", lambda v, k: F.when(k == j, F.col("_value")).otherwise(v)).alias("values"))


def trace(a: DataFrame) -> DataFrame:
    """One row: the sum of the diagonal of a square ARRAY matrix; another shape raises."""
    s = a.agg(F.sum(F.get("values", F.col("row_id").cast("int"))).alias("trace"), F.count("*").alias("_n"), F.max(F.size("values")).alias("_m"))
    return s.where(F.assert_true(F.col("_n") == F.col("_m"), "the matrix is not square").isNull()).select("trace")


def flatten(cells: DataFrame, cols: int) -> DataFrame:
    """COO cells as one row: row 0, columns i * cols + j."""
    return cells.select(F.lit(0).cast("bigint").alias("i"), (F.col("i") * cols + F.col("j")).cast("bigint").alias("j"), "value")


def with_radius(df: DataFrame, x: str, y: str, out: str = "radius") -> DataFrame:
    """Adds sqrt(x * x + y * y)."""
    return df.withColumn(out, F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))


def pair_distances(points: DataFrame, label: str | None = None, blocks: int = 8) -> DataFrame:
    """(label, pairs, mean, low, high) of the distances of all unordered pairs of ARRAY rows, within each label or of the whole.

    Quadratic by nature: rows are dealt into blocks, a pair of blocks is one key, and sums are combined before the shuffle.
    Labels of fewer than two rows have no row.
    """
    own = points.select("row_id", (F.col(label) if label else F.lit(0)).alias("label"), "values").withColumn("blk", F.pmod(F.xxhash64("row_id"), F.lit(blocks)))
    every = F.array(*(F.lit(k).cast("bigint") for k in range(blocks)))
    left = own.withColumn("other", F.explode(every))
    right = own.select(F.col("row_id").alias("b"), "label", F.col("values").alias("w"), F.col("blk").alias("other")).withColumn("blk", F.explode(every))
    d = F.sqrt(squared_distance(F.col("values"), F.col("w")))
    pairs = left.join(right, ["label", "blk", "other"]).where("row_id < b").groupBy("label")
    return pairs.agg(F.count("*").alias("pairs"), F.avg(d).alias("mean"), F.min(d).alias("low"), F.max(d).alias("high"))


def set_row(a: DataFrame, i: int, values: list[float]) -> DataFrame:
    return a.select("row_id", F.when(F.col("row_id") == i, F.array(*(F.lit(float(v)) for v in values))).otherwise(F.col("values")).alias("values"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").cast("bigint").alias("i"), F.col("i").cast("int").alias("j"), "value")


def reshape(cells: DataFrame, cols: int, new_cols: int) -> DataFrame:
    at = F.col("i") * cols + F.col("j")
    return cells.select(F.floor(at / new_cols).cast("bigint").alias("i"), F.pmod(at, F.lit(new_cols)).cast("int").alias("j"), "value")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """COO times COO: join on the inner dimension, partial sums before the shuffle."""
    left = a.select("i", F.col("j").cast("bigint").alias("k"), F.col("value").alias("x"))
    right = b.select(F.col("i").cast("bigint").alias("k"), "j", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def dense_product(a: DataFrame, weights: list[list[float]], bias: list[float] | None = None) -> DataFrame:
    """ARRAY matrix times a small literal one (a layer): a projection, no shuffle."""
    bias = bias or [0.0] * len(weights[0])
    out = [F.aggregate(F.zip_with("values", F.array(*(F.lit(float(w[j])) for w in weights)), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) + bias[j] for j in range(len(weights[0]))]
    return a.select("row_id", F.array(*out).alias("values"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a vector shorter than epsilon stays."""
    return F.when(norm(a) < EPSILON, a).otherwise(F.transform(a, lambda v: v / norm(a)))


def squared_distance(a: Column, b: Column) -> Column:
    """Infinity where the widths differ."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(float("inf")))


def arg_best(values: Column, best: Callable[[Column], Column]) -> Column:
    """First index of the largest or smallest value; -1 of none."""
    return F.when(F.size(values) == 0, F.lit(-1)).otherwise((F.array_position(values, best(values)) - 1).cast("int"))


def nearest(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """(row_id, cluster, distance): ties to the lowest index.  Centroids are literals, so this is a projection."""
    each = F.array(*(squared_distance(F.col("values"), F.array(*(F.lit(float(v)) for v in c))) for c in centroids))
    out = points.withColumn("_d", each)
    return out.select("row_id", "values", arg_best(F.col("_d"), F.array_min).alias("cluster"), F.array_min("_d").alias("distance"))


def range_join(points: DataFrame, x: str, y: str, eps: float, key: str = "row_id") -> DataFrame:
    """(a, b) of all pairs within ``eps`` in two dimensions, each with itself too: an equi-join on grid cells.

    A point goes to its own cell and is looked up from the nine cells round it, so the work follows the number of
    neighbours, not of all pairs; Spark splits crowded cells as skewed keys.
    """
    cell = points.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.floor(F.col(x) / eps).alias("cx"), F.floor(F.col(y) / eps).alias("cy"))
    step = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    other = cell.select(F.col("a").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"), "cx", "cy")
    other = other.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    other = other.select("b", "bx", "by", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    near = cell.join(other, ["cx", "cy"])
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return near.where(F.sqrt(d2) <= eps).select("a", "b")


def range_join_wide(points: DataFrame, eps: float, grid: int = 3) -> DataFrame:
    """(a, b) of all pairs of ARRAY rows (row_id, values) within ``eps``, each with itself too, in any number of dimensions.

    Cells of the first ``grid`` dimensions are the join's keys, which leaves no pair out; the whole distance is checked.  Where
    the cells part so little that more than one in ``PRODUCT`` pairs would meet, all pairs are met by products of blocks.
    """
    width, n = points.select(F.max(F.size("values")), F.count("*")).first()
    dims = range(min(grid, width or 1))
    cells = [F.floor(F.element_at("values", k + 1) / eps) for k in dims]
    names = [f"c{k}" for k in dims]

    def around(df: DataFrame) -> DataFrame:
        for c in names:
            df = df.withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
        return df

    own = points.select(F.col("row_id").alias("a"), F.col("values").alias("v"), *(c.alias(k) for k, c in zip(names, cells)))
    if width and width > grid:
        sizes = own.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
        met = sizes.join(around(sizes.withColumnRenamed("n", "m")), names).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0.0
        if met * PRODUCT > float(n) * n:
            return range_pairs(points, eps, n)
    other = around(own.withColumnsRenamed({"a": "b", "v": "w"}))
    near = own.join(other, names)
    return near.where(F.sqrt(squared_distance(F.col("v"), F.col("w"))) <= eps).select("a", "b")


def lookup(tokens: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """Embedding of each token id; zeros for an unknown one."""
    zero = F.array_repeat(F.lit(0.0), width)
    return tokens.join(vectors, "token_id", "left").withColumn("values", F.coalesce("values", zero))


def equal(a: DataFrame, b: DataFrame, eps: float = EPSILON) -> DataFrame:
    """One row: whether all cells agree within eps and the shapes are the same."""
    both = to_coo(a).withColumnRenamed("value", "x").join(to_coo(b).withColumnRenamed("value", "y"), ["i", "j"], "full")
    off = F.when(F.col("x").isNull() | F.col("y").isNull() | (F.abs(F.col("x") - F.col("y")) > eps), 1).otherwise(0)
    return both.agg((F.coalesce(F.sum(off), F.lit(0)) == 0).alias("equal"))


def majority(df: DataFrame, label: str) -> DataFrame:
    """The most frequent label; ties to the smallest."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)


def gini(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(1 - F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2)), F.lit(0.0)).alias("gini"))


def ranged(df: DataFrame, column: str) -> DataFrame:
    """Adds ``_part``: the number of a range of a numeric column, with about as many rows as any other."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.select(F.percentile_approx(column, [k / n for k in range(1, n)] or [0.5], 1000)).first()[0] or []))
    part = F.lit(0)
    for k, b in enumerate(bounds):
        part = F.when(F.col(column) > F.lit(b), k + 1).otherwise(part)
    return df.withColumn("_part", part)


def sums_above(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Adds ``above_<column>``: the sum over rows with a larger ``order`` (distinct numbers).  Ranges are summed apart, then shifted."""
    dealt = ranged(df, order)
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_s_{c}") for c in columns))
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_s_{c}").over(later), F.lit(0)).alias(f"_before_{c}") for c in columns))  # a row a range
    own = Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"_own_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns}).join(F.broadcast(parts), "_part")
    return out.select(*df.columns, *((F.col(f"_own_{c}") + F.col(f"_before_{c}")).alias(f"above_{c}") for c in columns))


def row_ids(df: DataFrame, *order: str) -> DataFrame:
    """row_id 0, 1, ... by ``order`` over the whole table: ranks within ranges of the first key, then shifted."""
    dealt = ranged(df, order[0])
    shift = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = shift.select("_part", before.alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(shift), "_part").withColumn("row_id", F.col("_own") - 1 + F.col("_before")).drop("_part", "_own", "_before")


