"""A whole run: from heights, tiles and instants to labels of every pixel in every frame, published with their counts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames, rays, tasks, tiles
from .. import store


@dataclass(frozen=True)
class Request:
    """radius_m: how far rays go; method: of directions; block: side of a block of the ray kernel, or 0 for the join form;
    split: how many tasks share a block's directions."""

    radius_m: float = 1000.0
    method: str = "nearest5"
    block: int = 2048
    split: int = 1
    bin_m: float = 1000.0


@dataclass(frozen=True)
class Plan:
    """Small tables only: what would be done, before any pixel is read."""

    sun: DataFrame
    needed: DataFrame
    missing: DataFrame
    counts: dict[str, int]


def plan(tile_frames: DataFrame, tile_sites: DataFrame, request: Request, have: DataFrame | None = None) -> Plan:
    """tile_frames: frame, utc; tile_sites: tile, left, bottom, right, top, latitude, longitude."""
    sun = frames.tile_frames(tile_frames, tile_sites, request.method)
    needed = frames.needed_directions(sun)
    missing = needed if have is None else frames.missing_directions(needed, have)
    counts = {"frames": tile_frames.count(), "tiles": tile_sites.count(), "directions": needed.count(), "missing": missing.count()}
    return Plan(sun, needed, missing, counts)


def horizons(pixels: DataFrame, wanted: DataFrame, request: Request) -> DataFrame:
    """(tile, row, col, z, direction, horizon, support, blocker) of pixels (tile, row, col, z) in their tile's wanted directions, however many there are."""
    if request.block:
        found = rays.block_horizons(pixels.select("tile", "row", "col", "z"), wanted, request.radius_m, request.block, split=request.split)
    else:
        found = rays.horizons(pixels.join(wanted, "tile"), pixels, rays.offsets_of(wanted, request.radius_m)).join(pixels.select("row", "col", "tile"), ["row", "col"])
    return found.select("tile", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "z", "direction", "horizon", "support", "blocker")


def run(pixels: DataFrame, tile_sites: DataFrame, tile_frames: DataFrame, request: Request = Request(), reuse: store.HorizonStore | None = None, check: bool = False) -> DataFrame:
    """(frame, tile, row, col, shade, quality). With a store, horizons that are there are read and only missing ones are computed, and kept; check: those that can't be used count as missing."""
    have = reuse.have() if reuse else None
    if reuse and check:
        have = store.cut(have.join(reuse.problems(pixels, request.radius_m), ["tile", "direction"], "left_anti"), "have")
    p = plan(tile_frames, tile_sites, request, have)
    if reuse:
        if p.counts["missing"]:
            reuse.put(horizons(pixels, p.missing, request))
        schema = "row long, col long, z float, horizon float, support smallint, blocker float, tile string, direction double"
        h = reuse.read(p.needed, schema) if p.counts["directions"] else pixels.sparkSession.createDataFrame([], schema)
    else:
        h = horizons(pixels, p.needed, request)
    limits = tiles.thresholds(tile_sites.select("tile", *tiles.SIDES), pixels, request.bin_m, request.radius_m, request.radius_m)
    return frames.label(pixels.select("tile", "row", "col", "z"), p.sun.select("frame", "tile", "apparent", "direction"), h, limits)


def publish(spark: SparkSession, layers: DataFrame, surface: DataFrame, root: str, name: str, point: bool = True) -> DataFrame:
    """Writes layers with their surface and counts under root/name, reads them back, compares, and only then, if point says so, names them in root/current.json. Returns the counts."""
    root = root.rstrip("/")
    whole = layers.join(surface.select("row", "col", "surface"), ["row", "col"])
    # a frame's rows together, split where they are many: else each task writes a file for every frame
    whole.hint("rebalance", "frame").write.mode("overwrite").partitionBy("frame").parquet(f"{root}/{name}/layers")
    back = spark.read.parquet(f"{root}/{name}/layers")
    if not frames.violations(back).isEmpty():
        raise RuntimeError("codes contradict each other")
    combos = frames.contingency(back)
    combos.write.mode("overwrite").parquet(f"{root}/{name}/counts")
    counts = spark.read.parquet(f"{root}/{name}/counts")
    if not tasks.same_rows(frames.contingency(whole).select(counts.columns), counts):
        raise RuntimeError("what was read back isn't what was computed")
    if point:
        store.replace(spark, f"{root}/current.json", json.dumps({"name": name}).encode())
    return counts


def summary(counts: DataFrame, tile_frames: DataFrame, policy: str = "group") -> DataFrame:
    """Per frame and group (or surface class): pixels, known and unknown, shares and their bounds, with the frame's time."""
    from ..functions import codes

    keyed = counts.withColumn("grp", codes.group_of(F.col("surface"))) if policy == "group" else counts
    return frames.rollup(keyed, ["frame", "grp" if policy == "group" else "surface"]).join(tile_frames.select("frame", "utc"), "frame")
