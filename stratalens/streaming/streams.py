"""Streaming forms of the change log and feedback operators; the batch ones are their reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def churn_stream(events: DataFrame, file: str, ts: str, author: str, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Changes per file and window; authors by sketch, as streams have no exact distinct counts."""
    d = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)  # watermarks take no TIMESTAMP_NTZ
    return d.groupBy(F.window(ts, window, slide) if slide else F.window(ts, window), F.col(file).alias("file")).agg(F.count("*").alias("change_count"), F.max(ts).alias("latest"), F.approx_count_distinct(author).alias("authors"))


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    d = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)  # watermarks take no TIMESTAMP_NTZ
    return d.groupBy(F.session_window(ts, gap), F.col(user).alias("user")).agg(F.count("*").alias("events"))


def latest_stream(feedback: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """The latest row per key so far; of equal times the last by `seq`. For complete or update mode."""
    rest = [c for c in feedback.columns if c != key]
    return feedback.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, seq)).alias("_r")).select(key, "_r.*")
