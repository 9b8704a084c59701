"""Polygons of GeoJSON as edges, which the polygon joins of operators.tiles take.

One feature a line is read in splits; a whole FeatureCollection is one row of its file. Properties are text, so that conditions and columns are chosen with where() and
select() before any ring is opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GEOMETRY = "struct<type: string, coordinates: string>"
_FEATURE = f"struct<id: string, properties: map<string, string>, geometry: {_GEOMETRY}>"
_RINGS = "array<array<array<double>>>"


def features(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """(id, properties, geometry): coordinates stay text. lines: a feature a line; else a FeatureCollection a file. What isn't JSON raises."""
    if lines:
        return spark.read.schema(f"id string, properties map<string, string>, geometry {_GEOMETRY}").option("mode", "FAILFAST").json(path)
    whole = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return whole.select(F.inline("features"))


def _twice_area(ring: Column) -> Column:
    at = lambda i: F.element_at(ring, i)
    return F.aggregate(F.sequence(F.lit(2), F.size(ring)), F.lit(0.0), lambda s, i: s + at(i - 1)[0] * at(i)[1] - at(i)[0] * at(i - 1)[1])


def edges(found: DataFrame, *keep: str, geometry: str = "geometry") -> DataFrame:
    """(keep..., part, ring, x1, y1, x2, y2): the edges of polygons and of each member of multipolygons, with the inside to their left: outer rings run
    counterclockwise, holes clockwise, however they were written. Geometries of other types, null ones, rings of fewer than three places and edges without length have none."""
    kind, text = F.col(f"{geometry}.type"), F.col(f"{geometry}.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, _RINGS))).when(kind == "MultiPolygon", F.from_json(text, f"array<{_RINGS}>"))
    part = found.select(*keep, F.posexplode(parts).alias("part", "_rings"))
    ring = part.select(*keep, "part", F.posexplode("_rings").alias("ring", "_at")).where(F.size("_at") >= 3)
    # closed, if it isn't
    closed = F.when(F.element_at("_at", 1) == F.element_at("_at", -1), F.col("_at")).otherwise(F.concat("_at", F.slice("_at", 1, 1)))
    ring = ring.withColumn("_at", closed)
    ring = ring.withColumn("_at", F.when((_twice_area(F.col("_at")) < 0) == (F.col("ring") == 0), F.reverse("_at")).otherwise(F.col("_at")))
    pair = F.arrays_zip(F.slice("_at", F.lit(1), F.size("_at") - 1).alias("a"), F.slice("_at", F.lit(2), F.size("_at") - 1).alias("b"))
    each = ring.select(*keep, "part", "ring", F.explode(pair).alias("e"))
    ends = {"x1": F.col("e.a")[0], "y1": F.col("e.a")[1], "x2": F.col("e.b")[0], "y2": F.col("e.b")[1]}
    out = each.select(*keep, "part", "ring", *[c.alias(n) for n, c in ends.items()])
    return out.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def areas(edge: DataFrame, *by: str) -> DataFrame:
    """(by..., area) inside of edges that have the inside to their left; holes count against it."""
    return edge.groupBy(*by).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))
