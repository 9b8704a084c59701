"""From a folder of heights to published frames: one call, or `python -m sunlattice`.

A publication is a folder: layers as Parquet by frame, each frame's layers as GeoTIFFs with a virtual mosaic, counts, summaries as JSON and CSV, and a
receipt. It is named in current.json only after everything was read back and held against what was computed."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import lattice
from ..operators import frames, tasks
from ..sources import catalogue, geotiff
from . import run

Rectangle = tuple[float, float, float, float]


def sites(found: DataFrame) -> DataFrame:
    """(tile, left, bottom, right, top, latitude, longitude) of a catalogue on the grid of functions.lattice: the Sun is that of a tile's centre."""
    centre = found.select(F.col("name").alias("tile"), "left", "bottom", "right", "top", ((F.col("left") + F.col("right")) / 2).alias("_e"), ((F.col("bottom") + F.col("top")) / 2).alias("_n"))
    return lattice.with_geographic(centre, "_e", "_n").drop("_e", "_n")


def instants(spark: SparkSession, times: Iterable[datetime]) -> DataFrame:
    """(frame, utc): instants in UTC, numbered in order."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(sorted(set(times)), 1)], "frame int, utc timestamp_ntz")


def labels(source, rectangle: Rectangle, times: DataFrame, request: run.Request = run.Request(), tile_sites: DataFrame | None = None, reuse: store.HorizonStore | None = None) -> DataFrame:
    """(frame, tile, row, col, shade, quality) of the pixels in a rectangle, in metres; tiles within the search distance are read as well."""
    source.check()
    px = store.cut(source.pixels(rectangle, request.radius_m), "heights")
    where = sites(source.catalogue()) if tile_sites is None else tile_sites
    whole = run.run(px, where.join(px.select("tile").distinct(), "tile", "left_semi"), times, request, reuse)
    l, b, r, t = rectangle
    x, y = (F.col("col") + 0.5) * lattice.RESOLUTION, -(F.col("row") + 0.5) * lattice.RESOLUTION
    return whole.where(x.between(l, r) & y.between(b, t))


def write(spark: SparkSession, layers: DataFrame, surface: DataFrame, times: DataFrame, root: str, name: str, rasters: bool = True) -> DataFrame:
    """Publishes layers with their surface under root/name; returns the summary (frame, grp, pixels, shares and bounds, utc) that was written."""
    root = root.rstrip("/")
    return _finish(spark, layers, run.publish(spark, layers, surface, root, name, point=False), times, root, name, rasters)


def finished_frames(spark: SparkSession, root: str, name: str) -> set[int]:
    """Frames of a publication that were written, read back and counted."""
    at = f"{root.rstrip('/')}/{name}/counts"
    fs, path = store.hadoop(spark, at)
    return {r["frame"] for r in spark.read.schema("frame int, surface smallint").parquet(at).select("frame").distinct().collect()} if fs.exists(path) else set()


def resume(spark: SparkSession, source, rectangle: Rectangle, times: DataFrame, root: str, name: str, request: run.Request = run.Request(), tile_sites: DataFrame | None = None, reuse: store.HorizonStore | None = None, at_once: int = 24, rasters: bool = True) -> DataFrame:
    """Publishes frames in groups of at_once, each group read back and counted before the next; started again, it goes on after the frames that are finished. Returns the
    summary. A request's instants are few and known to the driver; a publication must be resumed with the same request."""
    root = root.rstrip("/")
    layers, counts = f"{root}/{name}/layers", f"{root}/{name}/counts"
    done = finished_frames(spark, root, name)
    rest = sorted(r["frame"] for r in times.select("frame").collect() if r["frame"] not in done)
    surface = source.surface().select("row", "col", "surface")
    for i in range(0, len(rest), at_once):
        group = rest[i : i + at_once]
        part = times.where(F.col("frame").isin(group))
        whole = store.cut(labels(source, rectangle, part, request, tile_sites, reuse).join(surface, ["row", "col"]), "labels")
        whole.hint("rebalance", "frame").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("frame").parquet(layers)
        back = spark.read.schema(whole.schema).parquet(layers).where(F.col("frame").isin(group))
        own = store.cut(frames.contingency(back), "counts")
        if not frames.violations(back).isEmpty():
            raise RuntimeError("codes contradict each other")
        if not tasks.same_rows(frames.contingency(whole).select(own.columns), own):
            raise RuntimeError("what was read back isn't what was computed")
        # a group's counts are one folder, so they are there or not as a whole
        own.coalesce(1).withColumn("first", F.lit(group[0])).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("first").parquet(counts)
        store.drop(whole)
    every = spark.read.parquet(counts).drop("first")
    return _finish(spark, spark.read.parquet(layers), every, times, root, name, rasters)


def _finish(spark: SparkSession, layers: DataFrame, counts: DataFrame, times: DataFrame, root: str, name: str, rasters: bool) -> DataFrame:
    found = run.summary(counts, times)
    shown = found.select(*[F.col(c).cast("string").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in found.dtypes]).orderBy("frame", "grp")
    for kind in ("json", "csv"):
        shown.coalesce(1).write.mode("overwrite").option("header", "true").format(kind).save(f"{root}/{name}/summary-{kind}")
    if not tasks.same_rows(spark.read.schema(shown.schema).json(f"{root}/{name}/summary-json"), spark.read.schema(shown.schema).option("header", "true").csv(f"{root}/{name}/summary-csv")):
        raise RuntimeError("the summaries differ")
    written = 0
    if rasters:
        for layer in ("shade", "quality"):
            files = geotiff.encoded(layers.select(F.concat_ws("-", F.lit(layer), F.col("frame").cast("string"), F.regexp_replace("tile", r"\.tif$", "")).alias("tile"), "row", "col", F.col(layer).cast("int").alias(layer)), layer, "u1", 255)
            written += geotiff.export(files, f"{root}/{name}/rasters")
        made = geotiff.inventory(spark, f"{root}/{name}/rasters")
        bad = made.where(F.col("problem").isNotNull()).count()
        if bad or made.count() != written:
            raise RuntimeError("a raster can't be read back")
        for frame in sorted(r["frame"] for r in times.select("frame").collect()):
            one = made.where(F.col("name").startswith(f"shade-{frame}-"))
            if not one.isEmpty():
                store.replace(spark, f"{root}/{name}/rasters/shade-{frame}.vrt", catalogue.virtual_mosaic(one).encode())
    receipt = {"name": name, "frames": times.count(), "rasters": written, "pixels": counts.agg(F.sum("pixels")).first()[0]}
    store.replace(spark, f"{root}/{name}/receipt.json", json.dumps(receipt, sort_keys=True).encode())
    store.replace(spark, f"{root}/current.json", json.dumps(receipt, sort_keys=True).encode())
    return found


def shade_map(spark: SparkSession, folder: str, rectangle: Rectangle, times: Iterable[datetime], root: str, name: str, request: run.Request = run.Request(), epsg: int | None = None, cache: str | None = None, rasters: bool = True, at_once: int | None = None) -> DataFrame:
    """Heights under folder to published frames under root/name; returns the summary. cache: a folder in which horizons are kept for later runs; at_once: resume() with groups of so
    many frames, so that a run that was lost can go on."""
    source = catalogue.RawSource(spark, folder, epsg)
    when = instants(spark, times)
    if at_once:
        return resume(spark, source, rectangle, when, root, name, request, reuse=store.HorizonStore(spark, cache) if cache else None, at_once=at_once, rasters=rasters)
    found = store.cut(labels(source, rectangle, when, request, reuse=store.HorizonStore(spark, cache) if cache else None), "labels")
    return write(spark, found, source.surface(), when, root, name, rasters)


def prune(spark: SparkSession, root: str) -> list[str]:
    """Deletes publications under root that have no receipt, as they weren't finished, and neither are nor were current. Folders that this module didn't write stay."""
    fs, at = store.hadoop(spark, root)
    current = json.loads(store.read_text(spark, f"{root}/current.json"))["name"] if fs.exists(store.hadoop(spark, f"{root}/current.json")[1]) else None
    gone = []
    for s in fs.listStatus(at):
        name, path = s.getPath().getName(), s.getPath().toString()
        own = s.isDirectory() and fs.exists(store.hadoop(spark, f"{path}/layers")[1])
        if own and name != current and not fs.exists(store.hadoop(spark, f"{path}/receipt.json")[1]):
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)
