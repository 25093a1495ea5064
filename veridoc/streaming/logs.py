"""Windowed and stateful processing of request logs; the same functions serve batch frames and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.functions import pii


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, for which the time must be a zoned timestamp."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def rate_limit_windows(events: DataFrame, limit: int = 30, late: str = "5 minutes") -> DataFrame:
    """Clients over the limit in fixed one-minute windows."""
    counted = _timed(events, late).groupBy(F.window("ts", "1 minute").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests"))
    return counted.filter(F.col("requests") > limit).select(F.col("w.start").alias("minute"), "user_id", "requests")


def sliding_counts(events: DataFrame, length: str = "30 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per event type over trailing windows."""
    counted = _timed(events, late).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events closer than the gap."""
    s = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("requests")).drop("w")


def redact_stream(messages: DataFrame, column: str = "text") -> DataFrame:
    """Messages with personal data redacted before anything stores them, and the kinds found."""
    r = pii.redact(column)
    return messages.withColumn("pii_types", r["types"]).withColumn(column, r["text"])
