"""Event-time aggregations for batches and streams alike.

On a stream, rows later than ``LATE`` behind the newest are left out and state
older than that is freed; a table is read whole. State is kept
per key and window, so it is bounded by the keys active within ``LATE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE, GAP = "1 hour", "30 minutes"


def _late(events: DataFrame) -> DataFrame:
    """The watermark of a stream; a table has none."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE) if events.isStreaming else events


def hourly(events: DataFrame) -> DataFrame:
    """Events and their values by hour and type."""
    grouped = _late(events).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame) -> DataFrame:
    """Each user's runs of events less than ``GAP`` apart."""
    grouped = _late(events).groupBy(F.session_window("ts", GAP).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def first_of_hour(events: DataFrame) -> DataFrame:
    """The smallest event id of each user, type and hour, and the events it stands for."""
    grouped = _late(events).groupBy("user_id", "event_type", F.window("ts", "1 hour").alias("w"))
    return grouped.agg(F.min("event_id").alias("event_id"), F.count("*").alias("events")).select("user_id", "event_type", F.col("w.start").alias("hour"), "event_id", "events")
