"""Event-time windows over streams or tables of (ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str | None = None) -> DataFrame:
    """``ts`` as an instant in UTC; with ``delay`` a watermark for streams."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return own.withWatermark("ts", delay) if delay else own


def hopping(events: DataFrame, size: str = "1 hour", hop: str = "30 minutes") -> DataFrame:
    """start, event_type, n, mean_value of hopping windows."""
    rows = events.groupBy(F.window("ts", size, hop).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, stop, n, total: runs of a user's events with less than ``gap`` between."""
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")
