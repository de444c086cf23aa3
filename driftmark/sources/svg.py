"""Graphs that were laid out as SVG: nodes with their places, edges as paths whose ends are matched to the nearest nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import nearest
from ..shared import settle

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
#: Chords of a curve; the error falls with the square of their number.
CHORDS = 64


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(kind, element) of the groups of class node and edge. Files are split at the ends of groups, so a large one is read by many tasks."""
    text = spark.read.option("lineSep", "</g>").text(path).select(F.col("value").alias("element"))
    kind = F.regexp_extract("element", r'(?s).*<g\b[^>]*\bclass="(node|edge)"', 1)
    return text.select(kind.alias("kind"), "element").where("kind <> ''")


def attribute(name: str) -> Column:
    return F.regexp_extract("element", rf'\b{name}="\s*({NUMBER})', 1).try_cast("double")


def nodes_of(parts: DataFrame) -> DataFrame:
    """(name, x, y): the title of each node and the middle of its ellipse; a node without either is left out."""
    name = F.regexp_extract("element", r"<title>([^<]*)</title>", 1)
    return parts.where("kind = 'node'").select(name.alias("name"), attribute("cx").alias("x"), attribute("cy").alias("y")).where("name <> '' and x is not null and y is not null")


def path_points(d: Column) -> Column:
    """The points of a path of absolute moves and cubic curves (M, C), in order."""
    values = F.transform(F.regexp_extract_all(d, F.lit(f"({NUMBER})"), 1), lambda x: x.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 2).cast("int") - 1), lambda i: F.struct(F.get(values, 2 * i).alias("x"), F.get(values, 2 * i + 1).alias("y")))


def curve_length(points: Column, chords: int = CHORDS) -> Column:
    """The length of a path of cubic curves: that of its chords. points: begin, and for each curve two controls and its end."""

    def at(i: Column, c: str, t: Column) -> Column:
        p = [F.get(points, 3 * i + k)[c] for k in range(4)]
        u = 1 - t
        return u * u * u * p[0] + 3 * u * u * t * p[1] + 3 * u * t * t * p[2] + t * t * t * p[3]

    def chord(i: Column, j: Column) -> Column:
        a, b = j / chords, (j + 1) / chords
        return F.sqrt((at(i, "x", b) - at(i, "x", a)) ** 2 + (at(i, "y", b) - at(i, "y", a)) ** 2)

    curves = F.floor((F.size(points) - 1) / 3).cast("int")
    places = F.when(curves > 0, F.sequence(F.lit(0), curves * chords - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0.0), lambda total, n: total + chord(F.floor(n / chords).cast("int"), n % chords))


def read_svg_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, length): the names of the nodes nearest to both ends of each edge, and the edge's length. Titles of edges are not trusted; nodes with one name are one."""
    parts = settle(elements(spark, path), "svg")
    points = path_points(F.regexp_extract("element", r'<path\b[^>]*\bd="([^"]*)"', 1))
    edges = parts.where("kind = 'edge'").select(points.alias("points")).where(F.size("points") > 1).withColumn("edge_id", F.monotonically_increasing_id())
    edges = settle(edges, "edges")
    nodes = nodes_of(parts).withColumn("target_id", F.xxhash64("name"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.get("points", F.lit(0)).alias("p")), F.struct(F.lit(1).alias("end"), F.element_at("points", -1).alias("p"))))
    found = nearest(edges.select("edge_id", ends.alias("e")).select((2 * F.col("edge_id") + F.col("e.end")).alias("point_id"), "e.p.x", "e.p.y"), nodes.select("target_id", F.col("x").alias("tx"), F.col("y").alias("ty")))
    named = found.join(nodes.select("target_id", "name").distinct(), "target_id").select(F.shiftright("point_id", 1).alias("edge_id"), (F.col("point_id") % 2).alias("end"), "name")
    ends_of = named.groupBy("edge_id").agg(F.max(F.when(F.col("end") == 0, F.col("name"))).alias("src"), F.max(F.when(F.col("end") == 1, F.col("name"))).alias("dst"))
    return edges.join(ends_of, "edge_id").select("src", "dst", curve_length(F.col("points")).alias("length"))
