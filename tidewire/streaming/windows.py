"""Windowed totals and incidents that run on a batch and, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, width: str, delay: str | None = None) -> DataFrame:
    """Events and attacks of each host per tumbling window; ``delay`` bounds how late an event of a stream may be."""
    if delay and events.isStreaming:
        events = events.withWatermark("ts", delay)
    return events.groupBy("host", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if("is_attack").alias("n_attack")).select("host", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n", "n_attack")


def incidents(alerts: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """Sessions of a host's alerts: first and last, count, peak score."""
    if delay and alerts.isStreaming:
        alerts = alerts.withWatermark("ts", delay)
    found = alerts.groupBy("host", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max("score").alias("peak"), F.min("t").alias("first"), F.max("t").alias("last"))
    return found.select("host", "n", "peak", "first", "last")
