"""Event-time windows that run unchanged over batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 hour"


def _late(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 day", late: str = LATE) -> DataFrame:
    rows = _late(events, late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("started"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = LATE) -> DataFrame:
    rows = _late(events, late).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("started"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = LATE) -> DataFrame:
    rows = _late(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("started"), "n")
