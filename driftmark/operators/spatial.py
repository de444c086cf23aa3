"""Nearest targets of points in the plane, exact, along a quadtree whose levels are tables.

Every cell of a level knows the box of its targets. All points go down the levels together: of the cells that a point has left, those that are farther than another's
farthest corner cannot have its nearest target and go. A point keeps a few cells a level, whatever the number of targets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Shelf

#: Levels of the quadtree at most; targets nearer than a 2**LEVELS-th of the extent share a cell.
LEVELS = 24
#: Targets of a cell, about, with which the tree ends.
CELL = 4
#: Cells of a level up to which it is broadcast.
BROADCAST_CELLS = 10_000


def quadtree(targets: DataFrame, shelf: Shelf, levels: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """targets (target_id, tx, ty) with their cell (ix, iy) on the last level, and the levels from the root on: ix, iy, box (x0, x1, y0, y1)."""
    frame = targets.agg(F.min("tx").alias("x"), F.min("ty").alias("y"), F.greatest(F.max("tx") - F.min("tx"), F.max("ty") - F.min("ty")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    depth = min(LEVELS, max(1, math.ceil(math.log(max(frame.n, 1) / CELL, 4)) + 1)) if levels is None else levels
    cells = 1 << depth
    at = lambda c, low: F.least(F.lit(cells - 1), F.floor((F.col(c) - low) / (frame.size or 1.0) * cells)).cast("long")
    placed = shelf.write(targets.select("target_id", "tx", "ty", at("tx", frame.x).alias("ix"), at("ty", frame.y).alias("iy")), "targets") if frame.n else targets.select("*", F.lit(0).alias("ix"), F.lit(0).alias("iy"))
    box = lambda x, y: [f(c).alias(n) for f, c, n in ((F.min, x[0], "x0"), (F.max, x[1], "x1"), (F.min, y[0], "y0"), (F.max, y[1], "y1"))]
    out = [shelf.write(placed.groupBy("ix", "iy").agg(*box(("tx", "tx"), ("ty", "ty"))), f"level{depth}")]
    for level in range(depth - 1, -1, -1):
        above = out[-1].groupBy(F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy")).agg(*box(("x0", "x1"), ("y0", "y1")))
        out.append(shelf.write(above, f"level{level}"))
    return placed, out[::-1]


def bounds() -> tuple[Column, Column]:
    """The squares of the least and the greatest distance of (x, y) to what is in a box. Rounding keeps them on their sides, as each step is monotone."""
    low = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
    high = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1")))
    return low("x") ** 2 + low("y") ** 2, high("x") ** 2 + high("y") ** 2


def nearest(points: DataFrame, targets: DataFrame, levels: int | None = None) -> DataFrame:
    """(point_id, target_id, dist2): the nearest target of each point (point_id, x, y), the least id on ties; a written table. Without targets no rows.

    Points with a null coordinate have no nearest target, and targets with one are none's.
    """
    points, targets = points.dropna(subset=["x", "y"]), targets.dropna(subset=["tx", "ty"])
    spark = points.sparkSession
    with Shelf(spark, "quadtree") as shelf:
        placed, tree = quadtree(targets, shelf, levels)
        # the root is one cell; all points are in it
        front = shelf.write(points.select("point_id", "x", "y", F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py")), "front")
        for level, cells in enumerate(tree[1:], 1):
            few = 4**level <= BROADCAST_CELLS
            below = cells.withColumns({"px": F.shiftright("ix", 1), "py": F.shiftright("iy", 1)})
            low, high = bounds()
            met = front.join(F.broadcast(below) if few else below, ["px", "py"]).select("point_id", "x", "y", F.col("ix").alias("px"), F.col("iy").alias("py"), low.alias("low"), high.alias("high"))
            met = shelf.write(met, f"met{level}")
            reach = met.groupBy("point_id").agg(F.min("high").alias("reach"))
            front = shelf.write(met.join(reach, "point_id").where("low <= reach").select("point_id", "x", "y", "px", "py"), f"front{level}")
            shelf.drop(f"met{level}")
        dist = (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2
        found = front.join(placed.withColumnsRenamed({"ix": "px", "iy": "py"}), ["px", "py"]).groupBy("point_id").agg(F.min(F.struct(dist.alias("dist2"), "target_id")).alias("m"))
        return Shelf(spark, "nearest").write(found.select("point_id", "m.target_id", "m.dist2"), "found")
