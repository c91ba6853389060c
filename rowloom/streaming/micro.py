"""Streams of observations: operators per micro-batch, and windows of event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Apply a table operator to every micro-batch and append its outcome at ``path``, in a folder per batch.

    A batch that runs again after a failure writes the same folder again, so its rows occur once.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.format(kind).mode("overwrite").save(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(stream: DataFrame, time: str, size: str, stride: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Aggregates by window of event time, a row when the watermark has passed the window."""
    window = F.window(time, size, stride) if stride else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window, *by).agg(*(c.alias(k) for k, c in aggregates.items()))
