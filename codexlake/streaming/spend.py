"""Streams over the run ledger and event tables; an extension, as the batch queries have no stream of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(window_start, key, n, total) of a stream or a table; rows later than the watermark drop out of a stream."""
    at = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = events.withWatermark(time, late).groupBy(at.alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def first_deliveries(events: DataFrame, time: str, key: str, late: str = "2 hours") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's events with no longer pause than the gap."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what the source holds now, as a scheduled batch would, and stop."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
