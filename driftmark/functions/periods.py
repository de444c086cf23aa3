"""Periods (open intervals) and what lies in them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Periods up to which they are broadcast.
BROADCAST_PERIODS = 10_000
SCHEMA = "period_id int, p_from timestamp, p_to timestamp"


def from_rows(spark: SparkSession, rows: list[tuple[dt.datetime, dt.datetime]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], SCHEMA)


def sliding(spark: SparkSession, start: dt.datetime, width: dt.timedelta, step: dt.timedelta, n: int) -> DataFrame:
    return from_rows(spark, [(start + i * step, start + i * step + width) for i in range(n)])


def tumbling(spark: SparkSession, start: dt.datetime, days: int, n: int) -> DataFrame:
    return sliding(spark, start, dt.timedelta(days=days), dt.timedelta(days=days), n)


def englobing(periods: DataFrame) -> DataFrame:
    return periods.agg(F.min("p_from").alias("p_from"), F.max("p_to").alias("p_to"))


def bounds(periods: DataFrame) -> tuple[dt.datetime, dt.datetime]:
    """Begin of the first and end of the last period."""
    row = englobing(periods).first()
    return row.p_from, row.p_to


def only(periods: DataFrame) -> tuple[dt.datetime, dt.datetime]:
    """Begin and end of a single period; any other number of periods is an error."""
    rows = periods.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("exactly one period is needed")
    return rows[0].p_from, rows[0].p_to


def contains(outer: tuple[dt.datetime, dt.datetime], inner: tuple[dt.datetime, dt.datetime]) -> bool:
    return outer[0] <= inner[0] and outer[1] >= inner[1]


def require_inside(outer: tuple[dt.datetime, dt.datetime], inner: tuple[dt.datetime, dt.datetime], what: str) -> None:
    if not contains(outer, inner):
        raise ValueError(f"{what} has to lie inside its frame")


def assign(rows: DataFrame, periods: DataFrame, ts: str = "issue_ts", bucket_days: int | None = None) -> DataFrame:
    """Each row once for each period that it lies strictly inside. Periods may overlap.

    Up to BROADCAST_PERIODS periods are broadcast. For more, or with bucket_days, rows and periods meet by an equi-join on buckets of so many
    days (none: the mean width of a period).
    """
    inside = (F.col(ts) > F.col("p_from")) & (F.col(ts) < F.col("p_to"))
    if bucket_days is None:
        if periods.limit(BROADCAST_PERIODS + 1).count() <= BROADCAST_PERIODS:
            return rows.join(F.broadcast(periods), inside)
        width = periods.agg(F.avg(F.unix_seconds("p_to") - F.unix_seconds("p_from")).alias("w")).first().w
        bucket_days = max(1, round(width / 86400))
    bucket = lambda c: F.floor(F.unix_seconds(c) / (86400 * bucket_days))
    spread = periods.withColumn("bucket", F.explode(F.sequence(bucket(F.col("p_from")), bucket(F.col("p_to")))))
    return rows.withColumn("bucket", bucket(F.col(ts))).join(spread, "bucket").where(inside).drop("bucket")
