"""Event-time windows over streams, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream with ``at`` as its watermarked event time; times without zone are taken in the session's."""
    return df.withColumn("at", F.col(column).cast("timestamp")).withWatermark("at", delay)


def tumbling(df: DataFrame, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts by window and key; windows overlap if ``slide`` is shorter than ``width``."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def sessions(df: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """Counts by session: rows of a key less than ``gap`` apart."""
    return df.groupBy(F.session_window("at", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def distinct(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without repeats of a key within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)
