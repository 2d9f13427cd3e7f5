"""Streams: windowed drift statistics under a watermark, and scoring of micro-batches with a fitted model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def drift(events: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, n, mean, std) by tumbling window; works on streams and on tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(F.col("w.start").alias("window_start"), "n", "mean", "std")


def score(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append transformed micro-batches to a table, each exactly once under its batch id."""

    def one(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
