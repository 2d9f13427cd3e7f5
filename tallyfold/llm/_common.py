"""Shared pieces of the training-data operators: tables, working folders, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker handles at once; a row larger than this is handled alone.
SLICE_BYTES = 4 << 20

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a whole table with Spark's own reader (local, HDFS, object store alike)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on a single machine (master local), where it is unset, a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if known is None:
            master = spark.sparkContext.master
            if not re.match(r"local($|\[)", master):
                raise RuntimeError(f"spark.checkpoint.dir is unset, and master {master} needs a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyfold-"))
            known = spark.sparkContext.getCheckpointDir()
        folder = known
    return folder.rstrip("/")


class Workspace:
    """Tables written to the shared folder, to cut lineage and to use a costly result more than once.

    Files survive the loss of executors.  ``drop`` removes a table that is no longer read, ``clear`` all of them; ``made`` lists
    the workspaces that are still there, so that a caller who has written a result can clear what it was made from.
    """

    made: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        Workspace.made.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def clear(self) -> None:
        self._delete(self.base)
        Workspace.made.remove(self)

    def drop(self, df: DataFrame) -> None:
        self._delete(df._workspace_path)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


#: Caches, by name, that outlive a task in its Python worker.
caches: dict[str, dict] = {}


def forget(but: str | None = None) -> None:
    """Empty this process's caches, save one."""
    for name, cache in caches.items():
        if name != but:
            cache.clear()


def lean(run: Run, cache: str | None = None) -> Run:
    """``run`` for mapInArrow that releases its memory when it ends: Python workers live on between tasks and stages.

    It begins without what other runs cached in its worker; ``cache`` names the one it uses.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(cache)
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``size`` bytes in each; every row is kept."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = batch.column([c.lower() for c in batch.schema.names].index(column.lower()))
        step = max(1, int(n * size / max(1, values.nbytes)))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Values as str, a null as the empty string."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def with_column_names(df: DataFrame, *needed: str) -> DataFrame:
    """Check that the columns are there, once each; other columns may have any name."""
    names = [c.lower() for c in df.columns]
    for c in needed:
        if names.count(c.lower()) != 1:
            raise ValueError(f"column {c!r} must be there once; the columns are {df.columns}")
    return df.select(*needed)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as no column of ``df`` has, in any case."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def position(df: DataFrame, column: str) -> int:
    """Place of a column whatever the case of its name, as Spark resolves it."""
    return [c.lower() for c in df.columns].index(column.lower())


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``: about ``rows`` rows each, or one larger group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        begin = group_starts(table, keys)[-1]
        if begin:
            yield table.slice(0, begin)
            table = table.slice(begin)
        held, size = table.combine_chunks().to_batches(), table.num_rows
        rows = max(rows, 2 * size)  # a group larger than this grows in doubling steps
    if size:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a group begins; the key columns are integers without nulls."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
