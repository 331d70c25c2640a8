"""Windowed counts over event streams; beyond the repository domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """window_start, event_type, n and total of a batch or a stream of events (ts, event_type, value)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total_cents"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total_cents")
