"""Answers as a stream: repeated requests within the watermark are dropped, and counts per window follow late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than the watermark is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def counts(stream: DataFrame, time: str, of: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), of).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
