"""What a fill changes: a run on filled heights against one on raw heights, pixel by pixel; and what explains a changed label."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..functions import codes
from . import quantiles


def aligned(filled: DataFrame, raw: DataFrame, surface: DataFrame) -> DataFrame:
    """(frame, row, col, surface, shade, quality, raw_shade, raw_quality): layers (frame, row, col, shade, quality) of both runs and the surface."""
    r = raw.select("frame", "row", "col", F.col("shade").alias("raw_shade"), F.col("quality").alias("raw_quality"))
    return filled.select("frame", "row", "col", "shade", "quality").join(r, ["frame", "row", "col"]).join(surface.select("row", "col", "surface"), ["row", "col"])


def dependencies(both: DataFrame) -> DataFrame:
    """both with code, what the label owes to the fill, and grp, the report group."""
    return both.withColumns({"code": codes.dependency(F.col("surface"), F.col("shade"), F.col("raw_shade")), "grp": codes.group_of(F.col("surface"))})


def dependency_counts(deps: DataFrame) -> DataFrame:
    """(frame, grp, code, pixels) with a row for every group and code."""
    n = deps.where(F.col("grp").isNotNull()).groupBy("frame", "grp", "code").agg(F.count(F.lit(1)).alias("pixels"))
    groups = F.explode(F.array(*[F.lit(g) for g in codes.GROUPS]))
    grid = deps.select("frame").distinct().withColumn("grp", groups).withColumn("code", F.explode(F.array(*[F.lit(c).cast("smallint") for c in codes.DEPENDENCIES])))
    return grid.join(n, ["frame", "grp", "code"], "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)).cast("long"))


def scope_report(view: DataFrame, by: list[str]) -> DataFrame:
    """Pixels of each surface in each scope of a filled view, and shares that are null where there is nothing to divide by."""
    n = lambda *s: F.count_if(F.col("surface").isin(*s))
    t = view.groupBy(*by).agg(n(0).alias("observed"), n(1, 2).alias("water"), n(2).alias("synthetic"), n(3).alias("enclosed"), n(4).alias("open"))
    missing = F.col("water") + F.col("enclosed") + F.col("open")
    return t.withColumns({"missing": missing, "water_share": F.try_divide(F.col("water"), missing), "synthetic_share": F.try_divide("synthetic", "water")})


def dependent_land(counts: DataFrame) -> DataFrame:
    """(frame, land, dependent, share): land pixels whose label depends on the fill."""
    land = counts.where("grp = 'land'")
    out = land.groupBy("frame").agg(F.sum("pixels").alias("land"), F.sum(F.when(F.col("code").isin(1, 2, 3), F.col("pixels")).otherwise(0)).alias("dependent"))
    return out.withColumn("share", F.coalesce(F.col("dependent") / F.nullif(F.col("land"), F.lit(0)), F.lit(0.0)))


def transitions(both: DataFrame) -> DataFrame:
    """(frame, raw_shade, raw_quality, shade, quality, pixels) of observed pixels."""
    return both.where("surface = 0").groupBy("frame", "raw_shade", "raw_quality", "shade", "quality").agg(F.count(F.lit(1)).alias("pixels"))


def blocker_address(df: DataFrame, direction: str = "direction", distance: str = "blocker", resolution: float = 0.5) -> DataFrame:
    """df with blocker_row, blocker_col: the pixel that a ray hits at the distance, as the ray's own rounding gives it."""
    snap = lambda c: F.when(F.abs(c) < 1e-14, F.lit(0.0)).otherwise(c)
    d = F.col(distance).cast("double")
    rp, cp = F.pmod("row", F.lit(2)), F.pmod("col", F.lit(2))
    return df.withColumns({
        "blocker_row": F.col("row") + F.rint(rp + snap(-F.cos(F.radians(direction))) * d / resolution).cast("long") - rp,
        "blocker_col": F.col("col") + F.rint(cp + snap(F.sin(F.radians(direction))) * d / resolution).cast("long") - cp,
    })


def blocker_surfaces(horizon: DataFrame, surface: DataFrame) -> DataFrame:
    """horizon (row, col, z, direction, blocker, horizon) with the surface class at its blocker, 255 where there is none."""
    at = surface.select(F.col("row").alias("blocker_row"), F.col("col").alias("blocker_col"), F.col("surface").alias("s"))
    return blocker_address(horizon).join(at, ["blocker_row", "blocker_col"], "left").withColumn("blocker_surface", F.coalesce("s", F.lit(255)).cast("smallint")).drop("s")


def blocker_angle(z, distance, sea_m: float):
    """Elevation, in degrees, of a filled pixel at the sea's height seen from a pixel of height z."""
    return F.degrees(F.atan((F.lit(sea_m).cast("float") - z).cast("double") / F.greatest(distance.cast("double"), F.lit(0.25))))


def explained(losses: DataFrame, sea_m: float) -> DataFrame:
    """losses with cause: 'raised_threshold', 'filled_blocker' or 'unexplained'. losses: pixels that were sunlit and aren't now, with z, quality, shade,
    apparent, old_threshold, new_threshold, horizon, blocker, blocker_surface."""
    angle = blocker_angle(F.col("z"), F.col("blocker"), sea_m)
    raised = (F.col("quality") == 3) & (F.col("old_threshold") < F.col("apparent")) & (F.col("apparent") <= F.col("new_threshold"))
    seen = F.col("blocker_surface").between(1, 4) & (F.col("blocker") > 0) & (F.col("shade") == 1) & (angle > F.col("apparent")) & (F.abs(angle - F.col("horizon")) <= 1e-4)
    return losses.withColumn("cause", F.when(raised, "raised_threshold").when(seen, "filled_blocker").otherwise("unexplained"))


def differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """One row: rows on one side only, and for each value its different nulls, largest difference and rows beyond the tolerance."""
    left = a.select(*keys, F.struct(*values).alias("va"))
    right = b.select(*keys, F.struct(*values).alias("vb"))
    both = left.join(right, keys, "full")
    aggs = [F.count_if(F.col("vb").isNull()).alias("only_a"), F.count_if(F.col("va").isNull()).alias("only_b")]
    there = F.col("va").isNotNull() & F.col("vb").isNotNull()
    for v in values:
        x, y = F.col(f"va.{v}").cast("double"), F.col(f"vb.{v}").cast("double")
        aggs += [F.count_if(there & (x.isNull() != y.isNull())).alias(f"{v}_nulls"), F.max(F.when(there, F.abs(x - y))).alias(f"{v}_most"), F.count_if(there & (F.abs(x - y) > tolerance)).alias(f"{v}_beyond")]
    return both.agg(*aggs)


def error_quantiles(df: DataFrame, delta) -> DataFrame:
    """One row: n, median, p95 and largest absolute difference."""
    x = store.cut(df.select(F.abs(delta).cast("double").alias("x")))
    return x.agg(F.count("x").alias("n"), F.max("x").alias("largest")).join(quantiles.exact(x, "x", {"median": 0.5, "p95": 0.95}))


def map_agreement(surface: DataFrame, sea: str = "sea", land: str = "land", inside: str = "inside") -> DataFrame:
    """One row: how the water of a surface agrees with a map's sea and land, whose coverage is `inside`."""
    water, gap = F.col("surface").isin(1, 2), F.col("surface").isin(3, 4)
    mapped = F.col(sea) & ~F.col(land)
    unknown = water & ~(F.col(sea) | F.col(land))
    parts = {
        "water_pixels": water, "water_in_mapped_sea": water & mapped, "mapped_sea_missing": (water | gap) & mapped, "false_water": water & F.col(land),
        "missed_sea_3": (F.col("surface") == 3) & mapped, "missed_sea_4": (F.col("surface") == 4) & mapped, "class_3_in_sea": (F.col("surface") == 3) & F.col(sea),
        "water_outside_coverage": unknown & ~F.col(inside), "water_unmapped_inside": unknown & F.col(inside), "water_unmapped": unknown,
    }
    return surface.agg(*[F.count_if(c).alias(n) for n, c in parts.items()])


def distance_bound(radius_m: float, resolution: float = 0.5) -> int:
    """Pixels that a halo must be wide."""
    return math.ceil(radius_m / resolution)
