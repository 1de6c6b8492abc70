"""Streaming forms that Spark's own state serves; see ``ordered`` for folds in event-time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_items(items: DataFrame, keys: list[str], at: str, lateness: str = "72 hours") -> DataFrame:
    """Items of a stream once per identity, as long as the lateness; later ones are dropped with their state."""
    return items.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def hourly_counts(items: DataFrame, at: str, group: str, lateness: str = "1 hour") -> DataFrame:
    """Counts per hour and group, appended when the watermark has passed the hour."""
    windowed = items.withWatermark(at, lateness).groupBy(F.window(at, "1 hour").alias("w"), group).agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("hour"), group, "n")
