"""Strength of themes on an unbounded stream of decoded words (an addition: the batch definition over tumbling windows, with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strength_stream(decoded: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(ts, theme, n) per window of a stream (ts, state); rows later than the watermark are dropped by Spark."""
    counted = decoded.where("state <> 0").withWatermark("ts", late).groupBy(F.window("ts", window), F.col("state").alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("ts"), "theme", "n")
