"""Scalers, encoders and splits.  A fit is one aggregate; its model holds plain numbers and transforms by projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import EPSILON
from .stats import require


@dataclass(frozen=True)
class StandardScaler:
    """(x - mean) / std, with population std; below epsilon it counts as 1; without mean it is about 0."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], with_mean: bool = True, with_std: bool = True) -> StandardScaler:
        spread = [F.stddev_pop(c) if with_mean else F.sqrt(F.avg(F.col(c) * F.col(c))) for c in columns]
        r = df.agg(*(F.avg(c) for c in columns), *spread).first()
        n = len(columns)
        std = [s if with_std and s is not None and s >= EPSILON else 1.0 for s in r[n:]]
        return cls(tuple(columns), tuple(m if with_mean and m is not None else 0.0 for m in r[:n]), tuple(std))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(self.columns, self.mean, self.std, strict=True)})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + m for c, m, s in zip(self.columns, self.mean, self.std, strict=True)})


def standard_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fit and transform in one plan: the one-row aggregate is broadcast."""
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    out = df.join(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < EPSILON, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}).select(*df.columns)


@dataclass(frozen=True)
class MinMaxScaler:
    """To [low, high]; a column whose range is below epsilon becomes low; unseen values are not clipped."""

    columns: tuple[str, ...]
    least: tuple[float, ...]
    most: tuple[float, ...]
    low: float = 0.0
    high: float = 1.0

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> MinMaxScaler:
        require(high > low, "the range must not be empty")
        r = df.agg(*(F.min(F.col(c).cast("double")) for c in columns), *(F.max(F.col(c).cast("double")) for c in columns)).first()
        return cls(tuple(columns), tuple(r[: len(columns)]), tuple(r[len(columns) :]), low, high)

    def transform(self, df: DataFrame) -> DataFrame:
        def one(c: str, a: float, b: float) -> Column:
            return F.lit(self.low) if b - a < EPSILON else (F.col(c) - a) / (b - a) * (self.high - self.low) + self.low

        return df.withColumns({c: one(c, a, b) for c, a, b in zip(self.columns, self.least, self.most, strict=True)})

    def inverse(self, df: DataFrame) -> DataFrame:
        def one(c: str, a: float, b: float) -> Column:
            return F.lit(a) if b - a < EPSILON else (F.col(c) - self.low) / (self.high - self.low) * (b - a) + a

        return df.withColumns({c: one(c, a, b) for c, a, b in zip(self.columns, self.least, self.most, strict=True)})


def classes_of(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """Distinct values in byte order; more than ``most`` are no categories."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    require(bool(found), "no category to fit")
    require(len(found) <= most, f"more than {most} categories")
    return found


@dataclass(frozen=True)
class LabelEncoder:
    """Sorted distinct values to 0 .. k - 1; an unknown value raises unless ``strict`` is off (then null)."""

    column: str
    classes: tuple[str, ...]

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> LabelEncoder:
        return cls(column, tuple(classes_of(df, column)))

    def transform(self, df: DataFrame, out: str = "code", strict: bool = True) -> DataFrame:
        at = F.array_position(F.array(*map(F.lit, self.classes)), F.col(self.column)).cast("int") - 1
        unknown = F.raise_error(F.concat(F.lit("unknown category "), F.coalesce(self.column, F.lit("null")))).cast("int") if strict else F.lit(None).cast("int")
        return df.withColumn(out, F.when(at >= 0, at).otherwise(unknown))

    def inverse(self, df: DataFrame, code: str, out: str = "value") -> DataFrame:
        return df.withColumn(out, F.element_at(F.array(*map(F.lit, self.classes)), F.round(F.col(code)).cast("int") + 1))


@dataclass(frozen=True)
class OneHotEncoder:
    """A 0/1 column a class, none dropped; an unknown value raises, or with ``strict`` off gives zeros."""

    column: str
    classes: tuple[str, ...]

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> OneHotEncoder:
        return cls(column, tuple(classes_of(df, column)))

    def transform(self, df: DataFrame, strict: bool = True) -> DataFrame:
        out = df
        if strict:
            out = df.where(F.assert_true(F.col(self.column).isin(*self.classes), "unknown category").isNull())
        return out.withColumns({f"{self.column}_{v}": F.coalesce((F.col(self.column) == v).cast("double"), F.lit(0.0)) for v in self.classes})


def one_hot_codes(code: Column, k: int) -> Column:
    """0/1 array of an integer label; a label out of range gives zeros."""
    return F.array(*(F.coalesce((code == i).cast("double"), F.lit(0.0)) for i in range(k)))


def _ordered(df: DataFrame, key: str, seed: int | None) -> list[Column]:
    return [F.col(key)] if seed is None else [F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), F.col(key)]


def hashed_rank(df: DataFrame, key: str, seed: int, *by: str) -> DataFrame:
    """Adds ``_k``: 1, 2, ... in the order of the md5 of seed and key, within the values of ``by``.

    Rows are ranked in 4096 buckets by the hash's first digits and shifted by the counts of those before: no task has a whole class.
    """
    order = _ordered(df, key, seed)
    dealt = df.withColumn("_bucket", F.substring(order[0], 1, 3))
    sizes = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))  # 4096 rows a class
    own = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    same = F.col("_bucket") == F.col("_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return dealt.withColumn("_own", own).join(sizes, same).withColumn("_k", F.col("_own") + F.col("_before")).select(*df.columns, "_k")


def split(df: DataFrame, key: str, size: float, seed: int | None = None) -> DataFrame:
    """Adds ``is_test``: the last share by key (a number), or with a seed by the md5 of seed and key (both engines agree).

    Rows are ranked within ranges of the key, or buckets of the hash, and shifted; no task and no driver has the whole order.
    """
    from .arrays import row_ids

    require(0 < size < 1, "size must be inside (0, 1)")
    n = df.count()
    require(n > 1, "a split needs two rows")
    k = min(n - 1, max(1, int(n * size) if seed is None else round(n * size)))
    if seed is None:
        return row_ids(df, key).withColumn("is_test", F.col("row_id") >= n - k).drop("row_id")
    return hashed_rank(df, key, seed).withColumn("is_test", F.col("_k") > n - k).drop("_k")


def head_split(df: DataFrame, key: str, size: float, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the first int(n * size) rows in the hashed order (the older rule: truncated, and the head)."""
    k = int(df.count() * size)
    return hashed_rank(df, key, seed).withColumn("is_test", F.col("_k") <= k).drop("_k")


def stratified(df: DataFrame, key: str, label: str, size: float, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: of each class round(n * size) rows, at least 1 and at most n - 1; a class of one row raises."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    n = n.where(F.assert_true(F.col("_n") > 1, "a class has one row").isNull())
    test = F.least(F.greatest(F.round(F.col("_n") * size), F.lit(1.0)), F.col("_n") - 1)
    return hashed_rank(df, key, seed, label).join(n, label).withColumn("is_test", F.col("_k") <= test).drop("_k", "_n")


@dataclass(frozen=True)
class SplitOptions:
    """How to split: ``test_size`` or ``train_size`` (which leaves the rest to the test part), shuffled by seed, by class."""

    test_size: float = 0.2
    train_size: float | None = None
    shuffle: bool = True
    stratify: str | None = None
    seed: int = 42

    def check(self, rows: int) -> float:
        """The test share; sizes outside (0, 1), and fewer than 2 rows (4 by class), raise."""
        size = self.test_size if self.train_size is None else 1 - self.train_size
        require(0 < size < 1, "the parts must both have a share")
        require(rows >= (4 if self.stratify else 2), f"{rows} rows can't be split")
        return size


def train_test_split(df: DataFrame, key: str, options: SplitOptions = SplitOptions()) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the options."""
    size = options.check(df.limit(4).count())
    if options.stratify:
        out = stratified(df, key, options.stratify, size, options.seed)
    else:
        out = split(df, key, size, options.seed if options.shuffle else None)
    return out.where(~F.col("is_test")).drop("is_test"), out.where("is_test").drop("is_test")


def normalised(df: DataFrame, columns: list[str], mean: list[float], std: list[float]) -> DataFrame:
    """(x - mean) / std with given numbers; columns past them stay; a std of 0 gives null."""
    return df.withColumns({c: F.try_divide(F.col(c) - m, F.lit(float(s))) for c, m, s in zip(columns, mean, std)})


def one_hot_all(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[OneHotEncoder]]:
    """A 0/1 column a class of each column; unknown classes give zeros."""
    fitted = [OneHotEncoder.fit(df, c) for c in columns]
    for m in fitted:
        df = m.transform(df, strict=False)
    return df, fitted


def shuffled_batches(df: DataFrame, key: str, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds ``batch``: ``size`` rows each in the hashed order of seed and epoch, the last may be short."""
    require(size > 0, "size must be positive")
    return hashed_rank(df, key, seed + epoch).withColumn("batch", F.floor((F.col("_k") - 1) / size)).drop("_k")


@dataclass
class Loader:
    """Batches of a table, epoch by epoch; ``next_epoch`` deals anew if it shuffles.  Spark's tasks fetch ahead by themselves."""

    df: DataFrame
    key: str
    size: int
    shuffle: bool = True
    seed: int = 42
    epoch: int = 0

    def __post_init__(self) -> None:
        self.dealt = shuffled_batches(self.df, self.key, self.size, self.seed, self.epoch) if self.shuffle else batches(self.df, self.key, self.size)

    def __len__(self) -> int:
        return -(-self.df.count() // self.size)

    def batch(self, k: int) -> DataFrame:
        return self.dealt.where(F.col("batch") == k).drop("batch")

    def __iter__(self):
        return map(self.batch, range(len(self)))

    def item(self, key) -> DataFrame:
        return self.df.where(F.col(self.key) == key)

    def next_epoch(self) -> Loader:
        return Loader(self.df, self.key, self.size, self.shuffle, self.seed, self.epoch + 1)


def three_way(df: DataFrame, key: str, test: float, val: float, seed: int = 42) -> DataFrame:
    """Adds ``part``: train, val or test, by shares of the same hashed order."""
    require(0 < test and 0 < val and test + val < 1, "shares must leave a training part")
    held = split(df, key, test + val, seed)
    inner = split(held.where("is_test").drop("is_test"), key, test / (test + val), seed + 1).select(F.col(key).alias("_k"), F.col("is_test").alias("_t"))
    return held.join(inner, F.col(key) == F.col("_k"), "left").withColumn("part", F.when(F.col("_t"), "test").when(F.col("is_test"), "val").otherwise("train")).drop("_k", "_t", "is_test")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``batch``: rows of consecutive keys, ``size`` each, the last may be short."""
    from .arrays import row_ids

    require(size > 0, "size must be positive")
    return row_ids(df, key).withColumn("batch", F.floor(F.col("row_id") / size)).drop("row_id")


def bootstrap(df: DataFrame, seed: int = 42) -> DataFrame:
    """A sample with replacement, as large in expectation."""
    return df.sample(withReplacement=True, fraction=1.0, seed=seed)
