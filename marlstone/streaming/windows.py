"""Tumbling windows over events, for batch and stream alike (an extension of the batch recency reports)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """``day, event_type, n, total`` of tumbling days; on a stream, rows later than ``late`` are dropped by the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("w.start").alias("day"), "event_type", "n", "total")
