"""Places in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settle


def running_total(rows: DataFrame, order: list[str], size: Column, name: str) -> DataFrame:
    """rows and, as `name`, the sum of `size` over all rows that come before in the order.

    Rows are dealt to tasks by ranges of the order and numbered within them; only one sum per range meets in one place.
    """
    ranged = rows.withColumn("own_size", size.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    # ranges are drawn by sampling, so they are fixed before they are read twice
    ranged = settle(ranged, "ranges")
    parts = ranged.groupBy("part").agg(F.sum("own_size").alias("all"))
    starts = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.sum("own_size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own_size")
    placed = ranged.withColumn("inside", inside).join(F.broadcast(starts), "part")
    return placed.withColumn(name, F.col("start") + F.col("inside")).drop("part", "own_size", "inside", "start")
