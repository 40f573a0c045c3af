"""Event-time windows over streams; an extra, for the same aggregates as `group_by_dynamic`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, every: str, late: str, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates of tumbling windows of a stream or table; rows later than `late` are left out of a stream's windows."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    marked = timed.withWatermark(time, late) if stream.isStreaming else timed
    grouped = marked.groupBy(F.window(time, every).alias("w"), *by).agg(*aggregates)
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *[c for c in grouped.columns if c != "w"])
