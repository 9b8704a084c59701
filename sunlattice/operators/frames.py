"""Frames: which instants need which directions, labels of every pixel, counts and their bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, solar

MEASURES = ("sunlit", "shaded", "uncertain")


def tile_frames(frames: DataFrame, tiles: DataFrame, method: str = "nearest5") -> DataFrame:
    """Each frame with each tile, and the Sun at that tile's site (latitude, longitude), not at each pixel. Tiles are few: theirs is the side that is copied."""
    both = frames.crossJoin(tiles.select("tile", "latitude", "longitude"))
    return solar.with_sun(both, "utc", "latitude", "longitude").withColumn("direction", solar.direction(F.col("azimuth"), method))


def sun_of_sources(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(frame, tile, azimuth, apparent, conflict) of each source (tile) in each frame of entries (frame, tile, azimuth, apparent), which several batches may give: null and no conflict
    where none does, conflict where two disagree. One aggregate, then a join with the few sources."""
    one = entries.groupBy("frame", "tile").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("azimuth", "apparent")])
    wanted = entries.select("frame").distinct().join(sources.select("tile").distinct())
    same = (F.col("low_azimuth") == F.col("high_azimuth")) & (F.col("low_apparent") == F.col("high_apparent"))
    found = wanted.join(one, ["frame", "tile"], "left")
    return found.select("frame", "tile", F.col("low_azimuth").alias("azimuth"), F.col("low_apparent").alias("apparent"), F.coalesce(~same, F.lit(False)).alias("conflict"))


def needed_directions(sun: DataFrame) -> DataFrame:
    """(tile, direction), once for all frames: only frames with the Sun up need a horizon."""
    return sun.where("apparent > 0").select("tile", "direction").distinct()


def missing_directions(needed: DataFrame, have: DataFrame) -> DataFrame:
    return needed.join(have, ["tile", "direction"], "left_anti")


def label(pixels: DataFrame, sun: DataFrame, horizon: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(frame, tile, row, col, shade, quality, ...) of every pixel in every frame; further columns of pixels that horizon has as well are kept.

    pixels: tile, row, col, z; horizon: rows of pixels with direction, horizon and support. Frames meet tables of pixels by (tile, direction) or tile only,
    and frames of a tile are few, so the product is made where the pixels are and nothing of its size is shuffled: an aggregation after it sums first.
    horizon has a row for every known pixel in the directions that sun needs; pixels of a (tile, direction) that it lacks altogether, as nothing
    was computed, get quality 2."""
    keep = [c for c in pixels.columns if c in horizon.columns and c not in ("z", "direction", "horizon", "support")]
    t = sun.join(thresholds.select("tile", "threshold"), "tile", "left")
    up, down = t.where("apparent > 0"), t.where("apparent <= 0")
    none = {"horizon": F.lit(None).cast("float"), "support": F.lit(None).cast("smallint")}
    columns = [*keep, "z", "frame", "apparent", "threshold", "horizon", "support"]
    seen = horizon.join(up, ["tile", "direction"]).select(*columns)
    blind = up.join(horizon.select("tile", "direction").distinct(), ["tile", "direction"], "left_anti").select("tile", "frame", "apparent", "threshold")
    known, missing = pixels.where(F.col("z").isNotNull()), pixels.where(F.col("z").isNull())
    dark = known.join(down.select("tile", "frame", "apparent", "threshold").unionByName(blind), "tile").withColumns(none).select(*columns)
    gaps = missing.join(t.select("tile", "frame", "apparent", "threshold"), "tile").withColumns(none).select(*columns)
    args = [F.col(c) for c in ("z", "horizon", "support", "apparent", "threshold")]
    return seen.unionByName(dark).unionByName(gaps).select("frame", *keep, codes.shade(*args).alias("shade"), codes.quality(*args).alias("quality"))


def contingency(layers: DataFrame) -> DataFrame:
    """(frame, surface, shade, quality, pixels)."""
    return layers.groupBy("frame", "surface", "shade", "quality").agg(F.count(F.lit(1)).alias("pixels"))


def with_zeros(counts: DataFrame, keys: list[str], code: str, domain: tuple[int, ...], n: str = "pixels") -> DataFrame:
    """counts with a row for every code of the domain, 0 where there was none."""
    grid = counts.select(*keys).distinct().withColumn(code, F.explode(F.array(*[F.lit(c).cast(dict(counts.dtypes)[code]) for c in domain])))
    return grid.join(counts, [*keys, code], "left").withColumn(n, F.coalesce(n, F.lit(0)).cast("long"))


def _sum(condition, n="pixels"):
    return F.sum(F.when(condition, F.col(n)).otherwise(0))


def rollup(combos: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of keys: pixels, sunlit, shaded, uncertain, uncertain by quality, and shares of the whole group with their bounds.
    A label that isn't known may be either, so a share lies between its known part and that plus the unknown one."""
    known = combos.groupBy(*keys).agg(
        F.sum("pixels").alias("pixels"), _sum(F.col("shade") == 0).alias("sunlit"), _sum(F.col("shade") == 1).alias("shaded"), _sum(F.col("shade") == 255).alias("uncertain"),
        *[_sum((F.col("shade") == 255) & (F.col("quality") == q)).alias(f"quality_{q}") for q in (1, 2, 3, 4)],
    )
    share = lambda *parts: sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / F.nullif(F.col("pixels"), F.lit(0))
    return known.withColumns({
        **{f"{m}_share": share(m) for m in MEASURES},
        "shaded_low": share("shaded"), "shaded_high": share("shaded", "uncertain"), "sunlit_low": share("sunlit"), "sunlit_high": share("sunlit", "uncertain"),
    })


def marginals(combos: DataFrame) -> DataFrame:
    """All marginals of (surface, shade, quality) of each frame in one pass; level tells which keys are summed over."""
    return combos.cube("frame", "surface", "shade", "quality").agg(F.sum("pixels").alias("pixels"), F.grouping_id().cast("long").alias("level")).where(F.col("frame").isNotNull())


def unreconciled(combos: DataFrame, published: DataFrame) -> DataFrame:
    """(frame, layer, code, computed, published) where the sums of combos and the published counts (frame, layer, code, pixels) differ."""
    layers = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).cast("int").alias("code")) for x in ("surface", "shade", "quality")])).alias("k")
    own = combos.select("frame", "pixels", layers).groupBy("frame", "k.layer", "k.code").agg(F.sum("pixels").alias("computed"))
    both = own.join(published.withColumnRenamed("pixels", "published"), ["frame", "layer", "code"], "full")
    return both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("computed", "published")}).where("computed <> published")


def violations(layers: DataFrame) -> DataFrame:
    """Rows whose codes are out of their domains or contradict each other."""
    return layers.where(~F.coalesce(codes.consistent(F.col("shade"), F.col("quality")), F.lit(False)))


def daily_means(rolled: DataFrame, day: str) -> DataFrame:
    """Means over frames of the groups' shares, per day."""
    return rolled.groupBy(day, "grp").agg(F.count(F.lit(1)).alias("frames"), *[F.avg(f"{m}_share").alias(f"{m}_mean") for m in MEASURES])


def recounted(layers: DataFrame, published: DataFrame) -> DataFrame:
    """(frame, surface, shade, quality, published, counted) of the combinations whose published count isn't that of the layers."""
    keys = ["frame", "surface", "shade", "quality"]
    both = contingency(layers).withColumnRenamed("pixels", "counted").join(published.withColumnRenamed("pixels", "published"), keys, "full")
    return both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("published", "counted")}).where("published <> counted").select(*keys, "published", "counted")


def reconciled(totals: DataFrame, area: int) -> DataFrame:
    """totals (..., pixels) with whole: whether all of them together are the domain's area."""
    return totals.join(F.broadcast(totals.agg((F.sum("pixels") == area).alias("whole"))))
