"""Strength of themes over time. decoded: (ts, state), state 0 being the background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths of buckets in days that a display chooses from; fixed values.
LADDER = (1, 2, 3, 7, 14, 30, 90, 180, 365, 3 * 365)
WIDEST = 10 * 365


def strength_by_ts(decoded: DataFrame) -> DataFrame:
    """(ts, theme, n): words decoded as each theme."""
    return decoded.where("state <> 0").groupBy("ts", F.col("state").alias("theme")).agg(F.count(F.lit(1)).alias("n"))


def zero_fill(strengths: DataFrame, k: int) -> DataFrame:
    """All k themes at every observed ts."""
    grid = strengths.select("ts").distinct().withColumn("theme", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return grid.join(strengths, ["ts", "theme"], "left").select("ts", "theme", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def listed(strengths: DataFrame) -> DataFrame:
    """(theme, points): each theme's (strength, ts) in the order of ts, as it is written for a display."""
    rows = strengths.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("ts", "n"))).alias("r"))
    return rows.select("theme", F.transform("r", lambda x: F.struct(x["n"].alias("strength"), x["ts"].alias("ts"))).alias("points"))


def matrix(strengths: DataFrame, k: int) -> DataFrame:
    """One row per theme with its strengths in the order of ts."""
    rows = zero_fill(strengths, k).groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("ts", "n"))).alias("r"))
    return rows.select("theme", F.transform("r", lambda x: x["n"]).alias("strengths"))


def absolute(decoded: DataFrame, theme: int, starts: DataFrame, seconds: int) -> DataFrame:
    """(start, n): words of a theme with start <= ts < start + seconds. starts is a short list and broadcast; starts without words have 0."""
    own = decoded.where(F.col("state") == theme).groupBy("ts").agg(F.count(F.lit(1)).alias("c"))
    end = F.timestamp_add("SECOND", F.lit(seconds), F.col("start"))
    found = own.join(F.broadcast(starts), (F.col("ts") >= F.col("start")) & (F.col("ts") < end)).groupBy("start").agg(F.sum("c").alias("n"))
    return starts.join(found, "start", "left").select("start", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sampled_starts(decoded: DataFrame, n: int) -> DataFrame:
    """n evenly spaced instants from the first ts on."""
    bounds = decoded.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b"))
    return bounds.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "a", "b").select(F.timestamp_micros((F.col("a") + F.floor((F.col("b") - F.col("a")) * F.col("i") / n)).cast("long")).alias("start"))


def moving(series: DataFrame, half: int) -> DataFrame:
    """(t, theme, strength): words of the theme in the intervals t - half .. t + half, over 2 * half. series: (t, theme, n), one row for each interval t."""
    near = Window.partitionBy("theme").orderBy("t").rangeBetween(-half, half)
    return series.select("t", "theme", (F.sum("n").over(near) / (2.0 * half)).alias("strength"))


def relative(strengths: DataFrame) -> DataFrame:
    """Each theme's part of all themes' strength at t; null where there is none."""
    total = F.sum("strength").over(Window.partitionBy("t"))
    return strengths.select("t", "theme", F.try_divide("strength", total).alias("share"))


def bucket_days(span_days: Column) -> Column:
    """The first width of which 30 are longer than the span."""
    out = F.lit(WIDEST)
    for width in reversed(LADDER):
        out = F.when(30 * width > span_days, width).otherwise(out)
    return out


def resample(series: DataFrame, begin, end) -> DataFrame:
    """(bucket_start, strength): the mean per bucket from begin to before end, 0 for buckets without rows. series: (ts, strength)."""
    spark = series.sparkSession
    frame = spark.range(1).select(F.lit(begin).cast("timestamp").alias("t0"), F.lit(end).cast("timestamp").alias("t1"))
    frame = frame.withColumn("w", bucket_days((F.unix_seconds("t1") - F.unix_seconds("t0")) / 86400) * 86400)
    inside = series.crossJoin(F.broadcast(frame)).where("ts >= t0 and ts < t1")
    b = F.floor((F.unix_seconds("ts") - F.unix_seconds("t0")) / F.col("w"))
    means = inside.groupBy(b.alias("b")).agg(F.avg("strength").alias("strength"))
    count = F.ceil((F.unix_seconds("t1") - F.unix_seconds("t0")) / F.col("w"))
    grid = frame.select("t0", "w", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("b"))
    return grid.join(means, "b", "left").select(F.timestamp_seconds(F.unix_seconds("t0") + F.col("b") * F.col("w")).alias("bucket_start"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
