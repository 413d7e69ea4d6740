"""Windowed profiles of an event stream: an extension, the audited tables are batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_profile(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, rows, nulls, mean) by event-time windows.  On a stream, ``late`` bounds
    how long a window's state is kept; on a batch table it has no effect."""
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    x = F.when(~F.isnan(F.col(value)), F.col(value))
    grouped = events.groupBy(F.window(time, width).alias("w"), F.col(key).alias("key"))
    return grouped.agg(F.count("*").alias("rows"), (F.count("*") - F.count(x)).alias("nulls"), F.avg(x).alias("mean")).select(F.col("w.start").alias("window_start"), "key", "rows", "nulls", "mean")
