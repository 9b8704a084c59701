"""The registered queries: each applies one operator to the scene of scene.py or to the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, lattice, solar
from ..operators import fill, frames, impact, ordered, quantiles, rays, strips, tasks, tiles
from ..sources import catalogue, geotiff, vector
from .. import store
from . import publish, run, scene

RADIUS = 10.0
DIRECTIONS = (0.0, 45.0, 90.0, 215.0)
BIN = 8.0
PROFILE = fill.Profile(sea_m=1.0, low_margin_m=0.5, max_shore_m=2.0, preference_m=0.5, exclusions=((4.0, -8.0, 8.0, -4.0),))
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _directions(spark: SparkSession, values=DIRECTIONS) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "direction double")


def _r(c, n: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), n)


# --- the Sun


def _sun_events(spark, sf_dir):
    return solar.with_sun(scene.read(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.lit(scene.LATITUDE), F.lit(scene.LONGITUDE))


@query
def f1_solar_events(spark, sf_dir):
    return _sun_events(spark, sf_dir).select("event_id", _r("azimuth").alias("azimuth"), _r("geometric").alias("geometric"), _r("apparent").alias("apparent"))


@query
def f4_direction_bins(spark, sf_dir):
    s = _sun_events(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), solar.direction(F.col("azimuth"), m).alias("direction")) for m in ("nearest5", "nearest2_5")])).alias("d")
    return s.select(each).groupBy("d.method", "d.direction").agg(F.count(F.lit(1)).alias("n"))


@query
def w1_crossings(spark, sf_dir):
    s = _sun_events(spark, sf_dir).select(F.to_date("ts").alias("day"), "ts", "event_id", (F.col("geometric") - solar.HORIZON).alias("v"))
    # one event of each instant, so that the order is total
    s = s.groupBy("day", "ts").agg(F.min("event_id").alias("event_id"), F.min("v").alias("v"))
    return ordered.crossings(s, ["day"], "ts", "v").select(F.col("day").cast("string").alias("day"), "event_id", (F.col("v") > 0).alias("was_up"))


@query
def f2_daylight(spark, sf_dir):
    days = scene.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return solar.daylight(days, "day", F.lit(scene.LATITUDE), F.lit(0.0)).select(F.col("day").cast("string").alias("day"), _r("sunrise", 3).alias("sunrise"), _r("sunset", 3).alias("sunset"))


@query
def p9_daylight_filter(spark, sf_dir):
    """Events, kept or dropped by the sunrise and sunset of their day; fractions of a second count."""
    e = scene.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    days = e.select("day").distinct()
    return ordered.within_daylight(e, solar.daylight(days, "day", F.lit(scene.LATITUDE), F.lit(0.0))).select("event_id", "kept", "reason")


# --- frames and labels


def _sun_frames(spark, sf_dir):
    return frames.tile_frames(scene.frames(spark, sf_dir), scene.tiles(spark))


def _thresholds(spark, sf_dir):
    return tiles.thresholds(scene.tiles(spark), scene.pixels(spark, sf_dir), BIN, RADIUS, RADIUS)


def _labels(spark, sf_dir):
    """(frame, tile, row, col, surface, shade, quality) of the whole scene, by the block form of the ray operator."""
    px = scene.pixels(spark, sf_dir).join(F.broadcast(scene.tiles(spark).select("tile")), "tile").withColumn("surface", F.when(F.col("z").isNull(), 4).otherwise(0).cast("smallint"))
    # both are read several times: the heights as targets, samples, thresholds and labels, the Sun for the directions and the labels
    px, sun = store.cut(px), store.cut(_sun_frames(spark, sf_dir))
    horizon = rays.block_horizons(px, frames.needed_directions(sun), RADIUS, side=32)
    thr = tiles.thresholds(scene.tiles(spark), px, BIN, RADIUS, RADIUS)
    return frames.label(px, sun.select("frame", "tile", "apparent", "direction"), horizon, thr)


def _combos(spark, sf_dir):
    return frames.contingency(_labels(spark, sf_dir))


def _codes_int(df):
    return df.withColumns({c: F.col(c).cast("int") for c, t in df.dtypes if t == "smallint"})


@query
def a26_distinct_directions(spark, sf_dir):
    return frames.needed_directions(_sun_frames(spark, sf_dir))


@query
def j9_frames_tiles(spark, sf_dir):
    return _sun_frames(spark, sf_dir).groupBy("frame").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("apparent") > 0).alias("up"), _r(F.max("apparent")).alias("highest"))


@query
def j19_missing_directions(spark, sf_dir):
    needed = frames.needed_directions(_sun_frames(spark, sf_dir))
    return frames.missing_directions(needed, needed.where("cast(direction as int) % 10 = 0"))


@query
def a2_tile_threshold(spark, sf_dir):
    return _thresholds(spark, sf_dir).select("tile", "valid", F.col("lowest").cast("double").alias("lowest"), F.col("highest_near").cast("double").alias("highest_near"), _r("threshold").alias("threshold"))


@query
def j6_ray_slope_max(spark, sf_dir):
    px = scene.pixels(spark, sf_dir)
    h = rays.horizons(px, px, rays.offsets_of(_directions(spark), RADIUS))
    return h.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.sum("support").alias("supported"), _r(F.sum(F.round(F.col("horizon").cast("double"), 4)), 4).alias("horizon_sum"), F.sum(F.col("blocker").cast("double")).alias("blocker_sum"))


@query
def a1_ray_support(spark, sf_dir):
    px = scene.pixels(spark, sf_dir)
    h = rays.horizons(px, px, rays.offsets_of(_directions(spark, (45.0,)), RADIUS))
    return h.select("row", "col", _r("slope").alias("slope"), F.col("support").cast("int").alias("support"), F.col("blocker").cast("double").alias("blocker"))


@query
def j6_block_kernel(spark, sf_dir):
    """The block form of the ray operator; its rows are those of the join."""
    px = scene.pixels(spark, sf_dir)
    h = rays.block_horizons(px, list(DIRECTIONS), RADIUS, side=32)
    return h.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.sum("support").alias("supported"), _r(F.sum(F.round(F.col("horizon").cast("double"), 4)), 4).alias("horizon_sum"), F.sum(F.col("blocker").cast("double")).alias("blocker_sum"))


@query
def j7_coarse_ray(spark, sf_dir):
    px = scene.pixels(spark, sf_dir)
    h = rays.horizons(px, px, rays.coarse_offsets(_directions(spark), RADIUS))
    return h.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.sum("support").alias("supported"), _r(F.sum(F.round("slope", 6)), 4).alias("slope_sum"))


@query
def a23_ray_errors(spark, sf_dir):
    px = scene.pixels(spark, sf_dir)
    fine = rays.horizons(px, px, rays.offsets_of(_directions(spark), RADIUS)).select("row", "col", "direction", F.col("slope").alias("s1"))
    coarse = rays.horizons(px, px, rays.coarse_offsets(_directions(spark), RADIUS)).select("row", "col", "direction", F.col("slope").alias("s2"))
    e = impact.error_quantiles(fine.join(coarse, ["row", "col", "direction"]), F.col("s1") - F.col("s2"))
    return e.select("n", *[_r(c, 5).alias(c) for c in ("median", "p95", "largest")])


@query
def a24_horizon_differences(spark, sf_dir):
    px = scene.pixels(spark, sf_dir)
    fine = rays.horizons(px, px, rays.offsets_of(_directions(spark), RADIUS))
    coarse = rays.horizons(px, px, rays.coarse_offsets(_directions(spark), RADIUS)).where("(row + col) % 50 <> 0")
    d = impact.differences(fine, coarse, ["row", "col", "direction"], ["slope", "support"], 0.5)
    return d.withColumn("slope_most", _r("slope_most", 5))


@query
def f8_classify(spark, sf_dir):
    """Every pixel in every frame."""
    return _codes_int(_labels(spark, sf_dir).select("frame", "tile", "row", "col", "shade", "quality"))


@query
def a5_label_counts(spark, sf_dir):
    n = _labels(spark, sf_dir).groupBy("frame", "quality").agg(F.count(F.lit(1)).alias("pixels"))
    return _codes_int(frames.with_zeros(n, ["frame"], "quality", codes.QUALITIES))


@query
def a6_contingency(spark, sf_dir):
    return _codes_int(_combos(spark, sf_dir))


@query
def a7_surface_rollup(spark, sf_dir):
    r = frames.rollup(_combos(spark, sf_dir), ["frame", "surface"])
    return _codes_int(r.select("frame", "surface", "pixels", "sunlit", "shaded", "uncertain", *[f"quality_{q}" for q in (1, 2, 3, 4)]))


@query
def a14_bounds(spark, sf_dir):
    c = _combos(spark, sf_dir).withColumn("grp", codes.group_of(F.col("surface")))
    r = frames.rollup(c, ["frame", "grp"])
    return r.select("frame", "grp", "pixels", *[_r(x).alias(x) for x in ("sunlit_share", "shaded_low", "shaded_high", "sunlit_low", "sunlit_high")])


@query
def a15_daily_means(spark, sf_dir):
    c = _combos(spark, sf_dir).withColumn("grp", codes.group_of(F.col("surface")))
    days = scene.frames(spark, sf_dir).select("frame", F.to_date("utc").alias("day"))
    m = frames.daily_means(frames.rollup(c, ["frame", "grp"]).join(days, "frame"), "day")
    return m.select(F.col("day").cast("string").alias("day"), "grp", "frames", *[_r(f"{x}_mean").alias(f"{x}_mean") for x in frames.MEASURES])


@query
def a32_marginals_cube(spark, sf_dir):
    return _codes_int(frames.marginals(_combos(spark, sf_dir)))


@query
def a32_reconcile(spark, sf_dir):
    """Published counts, one of them wrong, against the sums of the combinations."""
    c = _combos(spark, sf_dir)
    layer = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).cast("int").alias("code")) for x in ("surface", "shade", "quality")])).alias("k")
    published = c.select("frame", "pixels", layer).groupBy("frame", "k.layer", "k.code").agg(F.sum("pixels").alias("pixels"))
    published = published.withColumn("pixels", F.col("pixels") + F.when((F.col("frame") % 7 == 1) & (F.col("layer") == "shade") & (F.col("code") == 255), 5).otherwise(0))
    return frames.unreconciled(c, published)


@query
def p18_code_violations(spark, sf_dir):
    """Codes taken from order lines; those that contradict each other."""
    x = scene.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 3 == 2, 255).otherwise(F.col("l_partkey") % 3).cast("smallint").alias("shade"), (F.col("l_suppkey") % 6).cast("smallint").alias("quality"))
    return _codes_int(frames.violations(x))


# --- tiles


def _shifted(spark):
    """Tiles and, a little off, some that overlap them."""
    t = scene.tiles(spark)
    off = t.where("(tx + ty) % 2 = 0").select(F.concat(F.lit("s"), "tile").alias("tile"), *[(F.col(c) + 2.5).alias(c) for c in ("left", "bottom", "right", "top")])
    return t.select("tile", "left", "bottom", "right", "top").unionByName(off)


@query
def j1_tiles_in_rect(spark, sf_dir):
    return tiles.touching(scene.tiles(spark), (7.0, -17.0, 16.0, -8.0)).select("tile")


@query
def j2_buffered_dependencies(spark, sf_dir):
    t = scene.tiles(spark).select("tile", "left", "bottom", "right", "top")
    return tiles.range_join(t, tiles.prefixed(t), BIN, RADIUS).select("tile", "b_tile")


@query
def j3_overlap_pairs(spark, sf_dir):
    return tiles.overlaps(_shifted(spark), BIN).select("tile", "b_tile")


@query
def j5_halo_semi(spark, sf_dir):
    t = scene.tiles(spark)
    return tiles.halo_members(t, t.where("tile in ('t0_0', 't2_3')"), BIN, 1.0).select("tile")


@query
def j4_seam_pairs(spark, sf_dir):
    return tiles.seams(scene.tiles(spark))


def _seam_bins(spark, sf_dir):
    return tiles.histogram(tiles.seam_differences(scene.pixels(spark, sf_dir)), width=0.25, most=40)


@query
def a4_seam_statistics(spark, sf_dir):
    d = tiles.seam_differences(scene.pixels(spark, sf_dir))
    return d.groupBy("vertical").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(F.col("diff").cast("double"))).alias("mean"), F.max(F.col("diff").cast("double")).alias("largest"))


@query
def a4_seam_histogram(spark, sf_dir):
    return _seam_bins(spark, sf_dir)


@query
def w5_histogram_quantile(spark, sf_dir):
    bins = _seam_bins(spark, sf_dir)
    out = None
    for q in (0.5, 0.95):
        x = tiles.histogram_quantile(bins, q, 0.25).select(F.lit(q).alias("q"), "quantile")
        out = x if out is None else out.unionByName(x)
    return out


@query
def a3_region_stats(spark, sf_dir):
    return tiles.region(scene.pixels(spark, sf_dir), 5, 10, 30, 40).select("valid", "total", _r("coverage").alias("coverage"), F.col("lowest").cast("double").alias("lowest"), F.col("highest").cast("double").alias("highest"))


@query
def s13_lattice_window(spark, sf_dir):
    return tiles.lattice_window(scene.pixels(spark, sf_dir).where("(row * 3 + col) % 7 <> 0").select("row", "col", "z"), -2, 50, 20, 20, z=codes.NODATA).select("row", "col", F.col("z").cast("double").alias("z"))


@query
def s14_mosaic(spark, sf_dir):
    px = scene.pixels(spark, sf_dir)
    a = px.where("col < 40").select("row", "col", F.col("z").cast("double").alias("z"))
    b = px.where("col >= 30").select("row", "col", F.when((F.col("row") % 9 == 0) & (F.col("col") == 33), F.col("z") + 1).otherwise(F.col("z")).cast("double").alias("z"))
    return tiles.mosaic(a.unionByName(b), ["row", "col"], ["z"])


@query
def j22_owner_resolution(spark, sf_dir):
    cells = scene.tiles(spark).select(F.concat(F.lit("c"), "tile").alias("cell"), "left", "bottom", "right", "top")
    return tiles.owners(cells, _shifted(spark).where("tile <> 't1_2'"), BIN)


@query
def j24_covered_cells(spark, sf_dir):
    return tiles.covered_cells(_shifted(spark), 5.0)


@query
def a28_area_union(spark, sf_dir):
    """Cells of half a metre that any widened tile covers, in bands of one row."""
    return tiles.covered_cells(_shifted(spark).select(*[(F.col(c) * 2 + d).alias(c) for c, d in (("left", -3), ("bottom", -3), ("right", 3), ("top", 3))]), 1.0).groupBy("y").agg(F.count(F.lit(1)).alias("cells"))


@query
def a30_lattice_pitch(spark, sf_dir):
    t = scene.tiles(spark)
    v = F.explode(F.array(*[F.rint(F.abs(c) * 2).cast("long") for c in (F.col("right") - F.col("left"), F.col("top") - F.col("bottom"), F.col("left"), F.col("bottom") + 32)])).alias("v")
    return t.select(v).agg(tiles.pitch(t).alias("pitch"))


def _edges(spark):
    ring = lambda name, pts: [(name, *a, *b) for a, b in zip(pts, pts[1:] + pts[:1], strict=True)]
    rows = ring("outer", [(1.0, -30.0), (30.0, -28.0), (27.0, -2.0), (3.0, -4.0)]) + ring("outer", [(10.0, -20.0), (20.0, -20.0), (20.0, -10.0), (10.0, -10.0)]) + ring("small", [(12.0, -18.0), (18.5, -17.0), (15.0, -11.0)])
    return spark.createDataFrame(rows, "polygon string, x1 double, y1 double, x2 double, y2 double")


def _centres(px):
    return px.select("row", "col", ((F.col("col") + 0.5) * 0.5).alias("x"), (-(F.col("row") + 0.5) * 0.5).alias("y"))


@query
def j25_pixels_in_polygons(spark, sf_dir):
    return tiles.inside_polygon(_centres(scene.pixels(spark, sf_dir)), _edges(spark), 4.0).select("row", "col", "polygon")


@query
def o1_owner_order(spark, sf_dir):
    return ordered.numbered(scene.tiles(spark).withColumns({"ty": F.col("ty"), "tx": F.col("tx")}), "ty", "tx", scene.SIDE // scene.TILE).select("tile", "number")


# --- the fill view


@query
def p5_missing_literal(spark, sf_dir):
    x = scene.read(spark, sf_dir, "lineitem").select("l_linenumber", F.when(F.col("l_partkey") % 10 == 0, F.lit(codes.NODATA)).when(F.col("l_partkey") % 10 == 1, F.lit(float("nan"))).when(F.col("l_partkey") % 10 == 2, F.lit(float("inf"))).when(F.col("l_partkey") % 10 == 3, F.lit(None)).otherwise(F.col("l_quantity")).alias("z"))
    return x.groupBy("l_linenumber").agg(F.count_if(codes.missing_literal(F.col("z"))).alias("literal"), F.count_if(codes.missing_declared(F.col("z"), F.lit(codes.NODATA))).alias("declared"))


@query
def p8_shore_low_high(spark, sf_dir):
    return fill.shores(scene.gappy(spark, sf_dir), PROFILE).select("row", "col", "low")


@query
def j17_neighbour_missing(spark, sf_dir):
    g = scene.gappy(spark, sf_dir)
    return fill.beside(g.where("z is not null").select("row", "col"), g.where("z is null"))


@query
def j18_eight_neighbours(spark, sf_dir):
    g = scene.gappy(spark, sf_dir)
    return fill.beside(g.where("z is not null").select("row", "col"), g.where("z is null"), eight=True)


def _gaps(spark, sf_dir, side=32):
    return fill.opened(scene.gappy(spark, sf_dir).where("z is null").select("row", "col"), 0, 0, scene.SIDE, scene.SIDE, side)


@query
def g1_components(spark, sf_dir):
    return _gaps(spark, sf_dir).select("row", "col", F.floor(F.col("component") / 4294967296).alias("root_row"), (F.col("component") % 4294967296).alias("root_col"), "open")


@query
def j15_nearest_shore(spark, sf_dir):
    g = scene.gappy(spark, sf_dir)
    low = fill.shores(g, PROFILE).where("low")
    return fill.nearest(g.where("z is null").select("row", "col"), low, 6.0, "d").select("row", "col", _r("d").alias("d"))


def _view(spark, sf_dir, profile=PROFILE):
    return fill.surface(scene.gappy(spark, sf_dir), profile, 0, 0, scene.SIDE, scene.SIDE, side=32)


@query
def a11_surface_counts(spark, sf_dir):
    n = _view(spark, sf_dir).groupBy("tile", "surface").agg(F.count(F.lit(1)).alias("pixels"))
    return _codes_int(frames.with_zeros(n, ["tile"], "surface", codes.SURFACES))


@query
def a12_territory_totals(spark, sf_dir):
    """Pixels of each surface, and whether they add up to the domain's area."""
    v = _view(spark, sf_dir).groupBy("surface").agg(F.count(F.lit(1)).alias("pixels"))
    return _codes_int(frames.reconciled(v, scene.SIDE * scene.SIDE))


@query
def g4_fill(spark, sf_dir):
    return fill.filled(_view(spark, sf_dir), PROFILE.sea_m).select("row", "col", F.col("z").cast("double").alias("z"), F.col("surface").cast("int").alias("surface"))


@query
def g12_sensitivity(spark, sf_dir):
    """Water pixels under other margins and preferences."""
    out = None
    for margin in (0.25, 1.0):
        for prefer in (0.0, 1.0):
            v = _view(spark, sf_dir, fill.Profile(PROFILE.sea_m, margin, PROFILE.max_shore_m, prefer, PROFILE.exclusions))
            x = v.agg(F.count_if(F.col("surface").isin(1, 2)).alias("water")).select(F.lit(margin).alias("margin"), F.lit(prefer).alias("preference"), "water")
            out = x if out is None else out.unionByName(x)
    return out


@query
def a18_component_stats(spark, sf_dir):
    g = _gaps(spark, sf_dir).withColumn("tile", scene.tile_name(F.col("row"), F.col("col")))
    return fill.component_statistics(g, 5).drop("component")


@query
def a19_enclosed_shores(spark, sf_dir):
    g = _gaps(spark, sf_dir).where("not open")
    s = fill.enclosed_shores(g, scene.gappy(spark, sf_dir))
    return s.select(F.floor(F.col("component") / 4294967296).alias("root_row"), (F.col("component") % 4294967296).alias("root_col"), "shore_pixels", *[_r(p).alias(p) for p in ("p10", "p50", "p90")])


@query
def a20_ingest_percentiles(spark, sf_dir):
    z = F.col("z").cast("double")
    g = store.cut(scene.gappy(spark, sf_dir).select(z.alias("z")))
    p = quantiles.exact(g, "z", {"p1": 0.01, "p50": 0.5, "p99": 0.99})
    a = g.agg(F.count("z").alias("valid"), F.count_if(F.col("z").isNull()).alias("missing"), F.min(z).alias("lowest"), F.max(z).alias("highest"), F.count_if(z < PROFILE.sea_m).alias("below")).join(p)
    return a.select("valid", "missing", "lowest", "highest", *[_r(n).alias(n) for n in ("p1", "p50", "p99")], "below", _r(F.col("below") / F.col("valid")).alias("below_share"), (F.col("below") > 0).alias("fill_above_ground"))


@query
def a16_map_agreement(spark, sf_dir):
    v = _view(spark, sf_dir).select("surface", ((F.col("row") + F.col("col")) % 3 != 0).alias("sea"), (F.col("row") % 4 == 0).alias("land"), (F.col("col") < 50).alias("inside"))
    return impact.map_agreement(v)


@query
def a31_permille(spark, sf_dir):
    v = _view(spark, sf_dir).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("surface") == 0).alias("land"), F.count_if(F.col("surface").isin(1, 2)).alias("water"))
    return v.select("tile", F.floor(F.col("land") * 1000 / F.col("n") + 0.5).cast("long").alias("land"), F.floor(F.col("water") * 1000 / F.col("n") + 0.5).cast("long").alias("water"))


# --- what the fill changes


def _two_runs(spark, sf_dir, limit: float = 2.0):
    """Layers of one frame with sun (an elevation of 30 degrees from 115) on raw and filled heights, aligned; and the horizons of the filled run, whose threshold is `limit`."""
    view = store.cut(_view(spark, sf_dir))
    full = fill.filled(view, PROFILE.sea_m)

    def layers(px, limit=2.0):
        h = rays.horizons(px, px, rays.offsets_of(_directions(spark, (115.0,)), 5.0))
        z = px.select("row", "col", "z").join(h.select("row", "col", "horizon", "support", "blocker"), ["row", "col"], "left")
        args = [F.col("z"), F.col("horizon"), F.col("support"), F.lit(30.0), F.lit(limit)]
        return z.select(F.lit(1).alias("frame"), "row", "col", "z", "horizon", "blocker", codes.shade(*args).alias("shade"), codes.quality(*args).alias("quality"))

    now = layers(full, limit)
    return impact.aligned(now, layers(view), view), now, view


@query
def f10_dependency_codes(spark, sf_dir):
    return _codes_int(impact.dependencies(_two_runs(spark, sf_dir)[0]).select("row", "col", "surface", "code", "grp"))


@query
def a8_transitions(spark, sf_dir):
    return _codes_int(impact.transitions(_two_runs(spark, sf_dir)[0]))


@query
def a9_dependency_hist(spark, sf_dir):
    return _codes_int(impact.dependency_counts(impact.dependencies(_two_runs(spark, sf_dir)[0])))


@query
def a10_fill_share(spark, sf_dir):
    s = impact.dependent_land(impact.dependency_counts(impact.dependencies(_two_runs(spark, sf_dir)[0])))
    return s.withColumn("share", _r("share"))


@query
def j14_blocker_class(spark, sf_dir):
    _, now, view = _two_runs(spark, sf_dir)
    h = now.where(F.col("blocker") > 0).withColumn("direction", F.lit(115.0))
    return _codes_int(impact.blocker_surfaces(h, view).groupBy("blocker_surface").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("blocker").cast("double")).alias("distance")))


# --- order, windows, samples


@query
def w3_interval_merge(spark, sf_dir):
    x = scene.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("band"), (F.col("l_partkey") * 3 % 5000).alias("s")).distinct().withColumn("e", F.col("s") + 2 + F.col("s") % 4)
    return ordered.merge_intervals(x, ["band"], "s", "e")


@query
def a28_interval_cover(spark, sf_dir):
    x = scene.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("band"), (F.col("l_partkey") * 3 % 5000).alias("s")).distinct().withColumn("e", F.col("s") + 2 + F.col("s") % 4)
    return ordered.covered_length(x, ["band"], "s", "e")


@query
def w4_prefix_max(spark, sf_dir):
    px = scene.pixels(spark, sf_dir).select("col", "row", F.col("z").cast("double").alias("z"))
    return ordered.prefix_max(px, ["col"], "row", "z", 20)


@query
def w6_nearest_time(spark, sf_dir):
    e = scene.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("s"))
    return ordered.nearest_time(e, ["day"], "s", 14 * 3600 + 1800, "event_id").withColumn("day", F.col("day").cast("string"))


@query
def w7_attempts(spark, sf_dir):
    e = scene.read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ordered.attempts(e, "user_id", "ts", "event_id", 3).select("event_id", F.col("attempt").cast("long").alias("attempt"), "allowed")


@query
def w9_core_numbering(spark, sf_dir):
    return ordered.numbered(scene.pixels(spark, sf_dir).select("row", "col"), "row", "col", scene.SIDE)


@query
def w11_neighbour_frames(spark, sf_dir):
    return ordered.steps(scene.frames(spark, sf_dir).withColumn("day", F.to_date("utc")), ["day"], "frame").select("frame", "previous", "following")


@query
def o3_first_ready(spark, sf_dir):
    t, e = scene.tasks(spark, sf_dir)
    return tasks.ready(t, e).orderBy("task").limit(1).select("task")


@query
def o4_first_k(spark, sf_dir):
    px = scene.pixels(spark, sf_dir).where("z is not null")
    return ordered.first_k(px, ["tile"], [F.desc("z"), "row", "col"], 3).select("tile", "row", "col", F.col("z").cast("double").alias("z"))


@query
def o5_stratified_sample(spark, sf_dir):
    return ordered.stratified_sample(scene.pixels(spark, sf_dir).select("tile", "row", "col"), ["tile"], ["row", "col"], 5, 17)


@query
def o9_decimation(spark, sf_dir):
    return scene.pixels(spark, sf_dir).where("row % 4 = 0 and col % 4 = 0").select("row", "col", F.col("z").cast("double").alias("z"))


# --- tasks and sets


@query
def a27_task_states(spark, sf_dir):
    return tasks.states(scene.tasks(spark, sf_dir)[0])


@query
def j20_ready_tasks(spark, sf_dir):
    t, e = scene.tasks(spark, sf_dir)
    return tasks.ready(t, e).select("task")


@query
def t2_illegal_moves(spark, sf_dir):
    e = scene.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("task"), F.col("ts").alias("at"), F.element_at(F.array(*map(F.lit, tasks.STATES)), (F.col("event_id") * 7 % 5 + 1).cast("int")).alias("state"))
    return tasks.illegal_moves(e).select("event_id", "task", "was", "state")


@query
def t4_invalidated(spark, sf_dir):
    t, e = scene.tasks(spark, sf_dir)
    return tasks.invalidated(e, t.where("task in (13, 50, 77)"))


@query
def u1_union_layers(spark, sf_dir):
    px = scene.pixels(spark, sf_dir)
    return px.where("row < 32").unionByName(px.where("row >= 32")).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))


@query
def u2_missing_extra(spark, sf_dir):
    o, l = scene.read(spark, sf_dir, "orders"), scene.read(spark, sf_dir, "lineitem")
    return tasks.missing_and_extra(o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k")), l.where("l_partkey % 2 = 0").select(F.col("l_orderkey").alias("k")), "k")


@query
def u3_intersect(spark, sf_dir):
    px = scene.pixels(spark, sf_dir)
    return px.where("z > 15").select("row").intersect(px.where("z < 1").select("row"))


@query
def u4_distinct_days(spark, sf_dir):
    return scene.read(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour")).distinct()


@query
def u7_complete_rectangle(spark, sf_dir):
    """Addresses of the lattice of tiles that no tile has."""
    n = scene.SIDE // scene.TILE
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).alias("ty"), (F.col("id") % n).alias("tx"))
    return grid.exceptAll(scene.tiles(spark).select("ty", "tx"))


@query
def a29_cost(spark, sf_dir):
    u = scene.read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("horizons"), F.col("l_quantity").cast("long").alias("frames"), (F.col("l_suppkey") % 2).alias("hits"))
    c = tasks.cost(u, {"horizon": 10.0, "frame": 0.25, "hit": 0.03125}, 0.625)
    return c.select(*[_r(x, 3).alias(x) for x in c.columns])


@query
def a29_estimator_errors(spark, sf_dir):
    x = scene.read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("p"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("o"))
    e = tasks.percentage_errors(x, "p", "o")
    return e.select(_r("median_pct", 4).alias("median_pct"), _r("max_pct", 4).alias("max_pct"))


# --- scalar functions


def _sites(spark, sf_dir):
    c = scene.read(spark, sf_dir, "customer")
    return c.select("c_custkey", (22.2 + (F.col("c_custkey") % 400) / 1000.0).alias("lat"), (113.9 + (F.col("c_custkey") * 7 % 500) / 1000.0).alias("lon"))


@query
def f13_grid(spark, sf_dir):
    e, n = lattice.to_grid(F.col("lat"), F.col("lon"))
    return _sites(spark, sf_dir).select("c_custkey", _r(e, 3).alias("east"), _r(n, 3).alias("north"))


@query
def f13_grid_back(spark, sf_dir):
    """Degrees that are turned into metres and back; sixth places."""
    e, n = lattice.to_grid(F.col("lat"), F.col("lon"))
    m = _sites(spark, sf_dir).select("c_custkey", e.alias("e"), n.alias("n"))
    return lattice.with_geographic(m, "e", "n").select("c_custkey", _r("latitude", 5).alias("lat"), _r("longitude", 5).alias("lon"))


@query
def f11_snap(spark, sf_dir):
    x = scene.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7 - 1000).alias("left"), (F.col("l_quantity") / 3 - 9).alias("bottom"))
    s = lattice.snapped("left", "bottom", F.col("left") + 3.3, F.col("bottom") + 2.2)
    return x.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in s.items()])


@query
def f15_coordinates(spark, sf_dir):
    c = scene.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("["), (k % 90).cast("string"), F.lit(" 30 18.5 S]"))).when(k % 4 == 1, F.concat((k % 90).cast("string"), F.lit(".5"))).when(k % 4 == 2, F.concat((k % 90).cast("string"), F.lit(" 75 1"))).otherwise(F.concat(F.lit("West "), (k % 180).cast("string")))
    return c.select("c_custkey", _r(lattice.degrees_of(text)).alias("degrees"))


@query
def f16_addresses(spark, sf_dir):
    x = scene.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 30000).alias("e"), (20000 - F.col("l_extendedprice")).alias("n"))
    return x.select("l_orderkey", "l_linenumber", lattice.bin_of("e", 750.0).alias("cx"), lattice.bin_of("n", 600.0).alias("cy"), lattice.parity(F.floor("e").cast("long")).alias("parity"))


@query
def f17_names(spark, sf_dir):
    t = scene.tiles(spark)
    f = scene.frames(spark, sf_dir)
    return f.select("frame", F.date_format("utc", "yyyyMMdd").alias("day"), F.date_format("utc", "HHmm").alias("hhmm")).crossJoin(t.select(lattice.cell_name("left", "bottom").alias("cell")))


@query
def f18_identity(spark, sf_dir):
    return scene.read(spark, sf_dir, "nation").select("n_nationkey", codes.identity("n_name", "n_nationkey", "n_regionkey").alias("id"))


@query
def f19_safe_paths(spark, sf_dir):
    p = scene.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("../"), "p_brand")).when(k % 5 == 1, F.concat(F.lit("/"), "p_brand")).when(k % 5 == 2, F.concat("p_brand", F.lit("//x"))).when(k % 5 == 3, F.concat("p_brand", F.lit("/./x"))).otherwise(F.concat("p_brand", F.lit("/tiles/e1n2.tif")))
    return p.select("p_partkey", lattice.safe_relative(path).alias("safe"))


@query
def f20_array_functions(spark, sf_dir):
    px = scene.pixels(spark, sf_dir).groupBy("tile").agg(F.array_sort(F.collect_set("row")).alias("rows"))
    return px.select("tile", F.size("rows").cast("long").alias("n"), F.element_at("rows", 1).alias("first"), F.element_at("rows", -1).alias("last"), F.size(F.filter("rows", lambda r: r % 2 == 0)).cast("long").alias("even"))


@query
def f21_count_maps(spark, sf_dir):
    n = scene.read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("int"), F.col("n")))).alias("m"))
    return m.select("l_returnflag", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).cast("long").alias(f"n{k}") for k in (1, 4, 9)])


@query
def f22_json(spark, sf_dir):
    e = scene.read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"), "props")
    return e.select("event_id", F.col("p.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("no_other"))


@query
def j10_direction_equi_join(spark, sf_dir):
    """How many pixels meet a horizon in each frame, and how many of those horizons are above the Sun."""
    sun = store.cut(_sun_frames(spark, sf_dir).where("apparent > 0"))
    px = scene.pixels(spark, sf_dir).join(F.broadcast(scene.tiles(spark).select("tile")), "tile")
    h = rays.block_horizons(px, frames.needed_directions(sun), RADIUS, side=32)
    met = sun.select("frame", "tile", "direction", "apparent").join(h, ["tile", "direction"])
    return met.groupBy("frame").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("horizon") > F.col("apparent").cast("float")).alias("below"))


@query
def j21_solar_by_source(spark, sf_dir):
    """The Sun of each tile as two batches give it, which share tiles and disagree on one in some frames; a tile that neither has."""
    sun = store.cut(_sun_frames(spark, sf_dir).select("frame", "tile", "azimuth", "apparent"))
    column = F.split("tile", "_")[1].cast("int")
    first, second = sun.where(column < 2), sun.where(column.between(1, 2))
    other = F.when((F.col("tile") == "t1_1") & (F.hour(F.col("utc")) == 12), 0.5).otherwise(0.0)
    second = second.join(scene.frames(spark, sf_dir), "frame").withColumn("apparent", F.col("apparent") + other).drop("utc")
    found = frames.sun_of_sources(first.unionByName(second), scene.tiles(spark))
    return found.groupBy("tile").agg(F.count("apparent").alias("frames"), F.count_if("conflict").alias("conflicts"), _r(F.max("apparent")).alias("highest"))


@query
def j29_interval_join(spark, sf_dir):
    """Events within the week of an order: bins of a day make it an equality join."""
    o = scene.read(spark, sf_dir, "orders").select("o_orderkey", (F.dayofyear("o_orderdate") % 30).alias("d0"))
    spans = o.withColumn("day", F.explode(F.sequence(F.col("d0"), F.col("d0") + 6)))
    e = scene.read(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spans.join(e, "day").groupBy("o_orderkey").agg(F.sum("n").alias("events"))


# --- further operators


@query
def j13_explained_losses(spark, sf_dir):
    """Pixels that were sunlit on raw heights and aren't on filled ones, by what explains them."""
    both, now, view = _two_runs(spark, sf_dir, 31.0)
    h = impact.blocker_surfaces(now.where(F.col("blocker") > 0).withColumn("direction", F.lit(115.0)), view).select("row", "col", "blocker_surface")
    lost = both.where("surface = 0 and raw_shade = 0 and shade <> 0").select("row", "col", "shade", "quality")
    lost = lost.join(now.select("row", "col", "z", "horizon", "blocker"), ["row", "col"]).join(h, ["row", "col"], "left")
    lost = lost.withColumns({"apparent": F.lit(30.0), "old_threshold": F.lit(2.0), "new_threshold": F.lit(31.0)})
    return impact.explained(lost, PROFILE.sea_m).groupBy("cause").agg(F.count(F.lit(1)).alias("pixels"))


@query
def a22_equality_neighbourhood(spark, sf_dir):
    """Horizons so near to the Sun's elevation that rounding decides, and how many there are in all."""
    px = scene.pixels(spark, sf_dir)
    h = rays.horizons(px, px, rays.offsets_of(_directions(spark), RADIUS))
    return h.groupBy("direction").agg(F.count_if(F.abs(F.col("horizon").cast("double") - 80.0) <= 1.0).alias("near"), F.count(F.lit(1)).alias("n"))


@query
def a25_chunk_equality(spark, sf_dir):
    """Fields that differ between the join form and the block form of the ray operator."""
    px = scene.pixels(spark, sf_dir)
    a = rays.horizons(px, px, rays.offsets_of(_directions(spark), RADIUS))
    b = rays.block_horizons(px, list(DIRECTIONS), RADIUS, side=20)
    d = impact.differences(a, b, ["row", "col", "direction"], ["slope", "support", "blocker"])
    return d.select("only_a", "only_b", "slope_beyond", "support_beyond", "blocker_beyond")


@query
def a17_scope_ratios(spark, sf_dir):
    """Surfaces of each tile of the filled view, with shares."""
    v = _view(spark, sf_dir)
    t = impact.scope_report(v, ["tile"]).unionByName(impact.scope_report(v.where("surface = 0"), ["tile"]).withColumn("tile", F.concat(F.lit("known "), "tile")))
    return t.withColumns({c: _r(c) for c in ("water_share", "synthetic_share")})


@query
def a35_unique_items(spark, sf_dir):
    """Orders whose lists of part numbers, modulo 20, name one twice."""
    x = scene.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 20).alias("items"))
    return x.select("l_orderkey", F.size("items").cast("long").alias("n"), (F.size(F.array_distinct("items")) < F.size("items")).alias("twice"))


def _files(spark, sf_dir, where=None):
    """A new folder with the gappy scene's supplied tiles (or those of a condition) as GeoTIFFs, no-data in their gaps."""
    to = store.place(spark, "tiles")
    g = scene.gappy(spark, sf_dir).where("supplied")
    geotiff.export(geotiff.encoded(g if where is None else g.where(where), "z", "f4", codes.NODATA, epsg=2326), to)
    return to


@query
def s1_catalogue(spark, sf_dir):
    """What a scan of GeoTIFFs that were written just now says of them."""
    found = geotiff.inventory(spark, _files(spark, sf_dir))
    bad = catalogue.problems(found, epsg=2326, size=BIN)
    return found.join(bad.withColumnRenamed("problem", "why"), "name", "left").select("name", "width", "height", "left", "bottom", "right", "top", "nodata", "epsg", "why")


@query
def s2_refreshed_catalogue(spark, sf_dir):
    """A kept catalogue after a file was added: only that one is opened again."""
    to, table = _files(spark, sf_dir, "tile <> 't1_1'"), store.place(spark, "catalogue")
    first = store.cut(catalogue.refresh(spark, to, table))
    geotiff.export(geotiff.encoded(scene.gappy(spark, sf_dir).where("tile = 't1_1'"), "z", "f4", codes.NODATA, epsg=2326), to)
    return catalogue.refresh(spark, to, table).join(first.select("name", F.lit(True).alias("known")), "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"))


@query
def s5_pixels_of_files(spark, sf_dir):
    """The heights of the tiles within 4 m of a rectangle, out of their files."""
    return catalogue.RawSource(spark, _files(spark, sf_dir)).pixels((8.5, -7.5, 9.0, -7.0), 4.0).select(F.regexp_replace("tile", r"\.tif$", "").alias("tile"), "row", "col", F.col("z").cast("double").alias("z"))


@query
def s7_cells(spark, sf_dir):
    """Cells of 8 m of the files, the domain around them, and the cells without a file."""
    found = geotiff.inventory(spark, _files(spark, sf_dir, "tile not in ('t1_1', 't2_0')"))
    have = catalogue.cells(found, 8.0, 8.0, 100.0).select("cx", "cy", F.lit(True).alias("file"), "shifted", "d_left", "d_top")
    return have.unionByName(catalogue.missing_cells(found, 8.0, 8.0).withColumn("file", F.lit(False)), allowMissingColumns=True)


@query
def s9_sheet_check(spark, sf_dir):
    """A delivery against its list: a file is missing, one too many, one of another size, one of another hash."""
    found = store.cut(geotiff.inventory(spark, _files(spark, sf_dir, "tile <> 't0_0'")))
    expected = found.where("name <> 't0_1.tif'").select("name", (F.col("bytes") + F.when(F.col("name") == "t1_0.tif", 1).otherwise(0)).alias("bytes"), F.when(F.col("name") == "t2_2.tif", "0").otherwise(F.col("sha256")).alias("sha256"))
    expected = expected.unionByName(spark.createDataFrame([("t0_0.tif", 1, "0")], "name string, bytes long, sha256 string"))
    return catalogue.sheet_problems(expected, found, epsg=2326, size=BIN)


@query
def k15_ingest(spark, sf_dir):
    """Sheets to native cells of 10 x 24 pixels, published and read back: each cell's pixels and heights."""
    to = _files(spark, sf_dir)
    back = catalogue.ingest(spark, to, None, store.place(spark, "city"), (10, 24), "one", epsg=2326, size=BIN)
    return back.groupBy("cell").agg(F.count(F.lit(1)).alias("pixels"), F.count("z").alias("heights"), F.sum(F.col("z").cast("double")).alias("total"))


def _built(spark, sf_dir):
    """The published filled view of the files."""
    raw, root = catalogue.RawSource(spark, _files(spark, sf_dir)), store.place(spark, "view")
    catalogue.build_view(spark, raw, root, "one", PROFILE, (scene.TILE, scene.TILE), side=32)
    view = catalogue.FilledSource(spark, root, raw)
    view.check()
    return view


@query
def k16_view(spark, sf_dir):
    """Surfaces of a filled view that was built from files, written, and read back by its provider."""
    view = _built(spark, sf_dir)
    return view.surface().join(view.pixels().select("row", "col", "z"), ["row", "col"]).groupBy("surface").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("z").cast("double")).alias("total")).withColumn("surface", F.col("surface").cast("int"))


@query
def s13_view_window(spark, sf_dir):
    """A window that hangs over the view's edge, checked against the manifest; 255 outside."""
    return _codes_int(_built(spark, sf_dir).window(40, 30, 40, 40))


@query
def k8_publication(spark, sf_dir):
    """Files to published frames and back: the summary of a publication, as its JSON says."""
    to, root = _files(spark, sf_dir), store.place(spark, "published")
    source = catalogue.RawSource(spark, to, 2326)
    times = store.cut(scene.frames(spark, sf_dir))
    sites = scene.tiles(spark).withColumn("tile", F.concat("tile", F.lit(".tif"))).drop("ty", "tx")
    whole = (0.0, -32.0, 24.0, 0.0)
    found = store.cut(publish.labels(source, whole, times, run.Request(RADIUS, block=32, bin_m=BIN), sites))
    publish.write(spark, found, source.surface(), times, root, "one", rasters=False)
    back = spark.read.schema("frame int, grp string, pixels long, sunlit long, shaded long, uncertain long").json(f"{root}/one/summary-json")
    return back


@query
def j23_city(spark, sf_dir):
    """Which city holds each customer's site: exactly one, or none."""
    cities = spark.createDataFrame([("east", 114.2, 22.0, 114.3, 22.5), ("west", 113.9, 22.0, 114.1, 22.5), ("north", 114.25, 22.4, 114.5, 22.9)], "city string, left double, bottom double, right double, top double")
    inside = lattice.within_closed(tuple(F.col(s) for s in tiles.SIDES), F.col("lon"), F.col("lat"))
    met = _sites(spark, sf_dir).join(F.broadcast(cities), inside, "left").groupBy("c_custkey").agg(F.count("city").alias("n"), F.min("city").alias("city"))
    return met.select("c_custkey", "n", F.when(F.col("n") == 1, F.col("city")).alias("city"))


@query
def f14_centres(spark, sf_dir):
    """Degrees of tiles' centres, for the Sun's place."""
    moved = scene.tiles(spark).select(F.col("tile").alias("name"), *[(F.col(c) * 100 + o).alias(c) for c, o in (("left", 836000.0), ("bottom", 818000.0), ("right", 836000.0), ("top", 818000.0))])
    e, n = lattice.to_grid(F.col("latitude"), F.col("longitude"))
    return publish.sites(moved).select("tile", _r(e, 2).alias("east"), _r(n, 2).alias("north"))


def _batches(spark, sf_dir):
    """Tiles and shifted ones as batches, and the layers of those whose heights are 11 or more in the mean."""
    boxes, px = _shifted(spark), scene.pixels(spark, sf_dir)
    at = px.select("row", "col", "z", ((F.col("col") + 0.5) * 0.5).alias("x"), (-(F.col("row") + 0.5) * 0.5).alias("y"))
    layers = tiles.of_points(at, boxes, BIN).where("tile is not null")
    kept = layers.groupBy("tile").agg(F.avg(F.col("z").cast("double")).alias("mean")).where("mean >= 11").select("tile")
    return boxes, layers.join(kept, "tile", "left_semi")


@query
def s15_required_batches(spark, sf_dir):
    """Batches that a region needs, and whether they are there."""
    boxes, layers = _batches(spark, sf_dir)
    need = catalogue.needed_batches(boxes, (5.0, -21.0, 19.0, -3.0)).select("tile")
    return need.join(layers.select("tile", F.lit(True).alias("there")).distinct(), "tile", "left").select("tile", F.coalesce("there", F.lit(False)).alias("there"))


@query
def s15_batch_window(spark, sf_dir):
    """The heights of a rectangle out of all batches that it needs, which overlap and agree."""
    boxes, px = _shifted(spark), scene.pixels(spark, sf_dir).drop("tile")
    layers = tiles.of_points(_centres(px).join(px, ["row", "col"]), boxes, BIN).where("tile is not null")
    return catalogue.batch_window(boxes, layers, (5.0, -21.0, 19.0, -3.0), [], ["z"]).select("row", "col", F.col("z").cast("double").alias("z"))


@query
def u5_subset(spark, sf_dir):
    """Whether all customers with orders are in the table of customers, and how many aren't."""
    missing = scene.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().join(scene.read(spark, sf_dir, "customer").where("c_custkey % 500 <> 7").select(F.col("c_custkey").alias("k")), "k", "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("missing")).withColumn("subset", F.col("missing") == 0)


@query
def u8_listing_difference(spark, sf_dir):
    """Lines of two listings, as often as they stand, that only the first has."""
    p = scene.read(spark, sf_dir, "part")
    return p.select("p_brand", "p_size").exceptAll(p.where("p_partkey % 3 <> 0").select("p_brand", "p_size"))


@query
def k10_two_row_shapes(spark, sf_dir):
    """Dependency counts and transitions in one table, each with the columns that it has."""
    both, _, _ = _two_runs(spark, sf_dir)
    a = impact.dependency_counts(impact.dependencies(both)).select("frame", "grp", F.col("code").cast("int").alias("code"), "pixels")
    b = _codes_int(impact.transitions(both))
    return a.unionByName(b, allowMissingColumns=True)


@query
def p10_time_filter(spark, sf_dir):
    """Frames at given times of day, and given times without a frame."""
    f = scene.frames(spark, sf_dir).withColumn("hhmm", F.date_format("utc", "HHmm"))
    asked = spark.createDataFrame([("0300",), ("1200",), ("1215",)], "hhmm string")
    return asked.join(f, "hhmm", "left").select("hhmm", "frame")


@query
def p7_exclusions(spark, sf_dir):
    """Pixels whose centre is in a closed rectangle."""
    px = _centres(scene.pixels(spark, sf_dir))
    return px.where(lattice.within_closed(PROFILE.exclusions[0], "x", "y")).select("row", "col")


@query
def j31_blocked_exceptions(spark, sf_dir):
    """Tiles that a request may not use, as one of the exceptions is within reach."""
    t = scene.tiles(spark)
    bad = t.where("tile in ('t1_1')").select("left", "bottom", "right", "top")
    return tiles.range_join(bad, tiles.prefixed(t), BIN, 2.0).select(F.col("b_tile").alias("tile")).distinct()


@query
def a13_recount(spark, sf_dir):
    """Counts that were written against a recount of the written layers, pixel by pixel; two counts were changed on the way."""
    root = store.place(spark, "recount")
    layers = _labels(spark, sf_dir)
    layers.write.parquet(f"{root}/layers")
    back = spark.read.parquet(f"{root}/layers")
    wrong = frames.contingency(back).withColumn("pixels", F.col("pixels") + F.when((F.col("frame") % 300 == 7) & (F.col("quality") == 4), 1).otherwise(0))
    wrong.write.parquet(f"{root}/counts")
    return _codes_int(frames.recounted(back, spark.read.parquet(f"{root}/counts")))


# --- places, polygons and diagnostics


def _places(spark, sf_dir):
    """A place on the map for each customer, within and around the scene, some of them on edges of tiles."""
    c = scene.read(spark, sf_dir, "customer").select("c_custkey")
    return c.select("c_custkey", ((F.col("c_custkey") * 37 % 340) / 10.0 - 1.0).alias("x"), (1.0 - (F.col("c_custkey") * 53 % 340) / 10.0).alias("y"))


@query
def p3_point_in_tile(spark, sf_dir):
    return tiles.of_points(_places(spark, sf_dir), scene.tiles(spark), BIN).select("c_custkey", "tile")


@query
def p19_pixel_hit(spark, sf_dir):
    """The pixel of a tile that a place falls on, counted from the tile's corner."""
    h = lattice.hit((8.0, -16.0, 16.0, -8.0), F.col("x"), F.col("y"))
    return _places(spark, sf_dir).withColumn("h", h).where("h is not null").select("c_custkey", F.col("h.row").alias("row"), F.col("h.col").alias("col"))


@query
def f3_daylight_samples(spark, sf_dir):
    """Quarter hours between sunrise and sunset of each day that has events."""
    days = store.cut(scene.read(spark, sf_dir, "events").where("ts is not null").select(F.to_date("ts").alias("day")).distinct())
    each = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("quarter"))
    each = each.withColumn("t", F.unix_timestamp(F.col("day").cast("timestamp")).cast("double") + F.col("quarter") * 900.0)
    kept = ordered.within_daylight(each, solar.daylight(days, "day", F.lit(scene.LATITUDE), F.lit(0.0))).where("kept")
    return kept.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("samples"), F.min("quarter").cast("int").alias("first"), F.max("quarter").cast("int").alias("last"))


@query
def w8_date_groups(spark, sf_dir):
    """Days of a request in groups of at most 100 frames."""
    sizes = scene.frames(spark, sf_dir).groupBy(F.to_date("utc").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()
    groups = ordered.date_groups([(r["day"], r["n"]) for r in sizes], 100)
    return spark.createDataFrame([(d, g) for g, days in enumerate(groups, 1) for d in days], "day string, number int")


@query
def a21_shore_gate(spark, sf_dir):
    """Heights along shores, and whether their median fits the sea's height."""
    g = fill.shore_gate(fill.shores(scene.gappy(spark, sf_dir), PROFILE), 1.3, 4.0)
    return g.select("n", *[_r(f"p{q}").alias(f"p{q}") for q in (5, 25, 50, 75, 95)], "accepted")


@query
def g7_window_horizons(spark, sf_dir):
    h = rays.of_window(scene.pixels(spark, sf_dir), (18, 27, 9, 11), _directions(spark), RADIUS)
    return h.select("row", "col", "direction", _r("slope").alias("slope"), F.col("support").cast("int").alias("support"), F.col("blocker").cast("double").alias("blocker"))


@query
def j8_rotated_strip(spark, sf_dir):
    """Horizons along a strip that is turned by 37 degrees."""
    px = scene.pixels(spark, sf_dir)
    middle = (scene.SIDE - 1) / 2
    h = strips.scanned(strips.turned(px, 37.0, (middle, middle), (-14.0, 9.0), (-8.0, 8.0)), 4.0, 10.0)
    return h.select("i", "j", _r("slope").alias("slope"), "support", F.col("blocker").alias("blocker"))


def _polygons(spark, sf_dir):
    """A folder of features, one a line: a kite around each nation's place with a hole in the larger ones, rings written in either way, one in five a multipolygon of two."""
    to = store.place(spark, "features")
    n = scene.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 7 % 29 + 1.3).alias("x"), (-(F.col("n_nationkey") * 11 % 27 + 3.7)).alias("y"), (F.col("n_regionkey") + 1.5).alias("r"))
    at = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    kite = lambda size, by=0.0: [at(size + by, 0.0), at(F.lit(by), size), at(by - size, F.lit(0.0)), at(F.lit(by), -size), at(size + by, 0.0)]
    outer = F.when(F.col("k") % 2 == 0, F.array(*kite(F.col("r")))).otherwise(F.reverse(F.array(*kite(F.col("r")))))
    rings = F.when(F.col("r") > 3, F.array(outer, F.array(*kite(F.lit(0.75))))).otherwise(F.array(outer))
    second = F.array(F.array(*kite(F.lit(1.0), 40.0)))
    many = F.col("k") % 5 == 0
    coordinates = F.when(many, F.to_json(F.array(rings, second))).otherwise(F.to_json(rings))
    kind = F.when(many, "MultiPolygon").otherwise("Polygon")
    code, state = F.element_at(F.array(F.lit("SEA"), F.lit("LAND"), F.lit("ROAD")), (F.col("k") % 3 + 1).cast("int")), F.when(F.col("k") % 4 == 3, "old").otherwise("valid")
    line = F.format_string('{"type": "Feature", "id": "%d", "properties": {"code": "%s", "state": "%s", "level": %d}, "geometry": {"type": "%s", "coordinates": %s}}', "k", code, state, "k", kind, coordinates)
    n.select(line.alias("value")).write.text(to)
    return to


def _polygon_edges(spark, sf_dir):
    found = vector.features(spark, _polygons(spark, sf_dir)).where("properties['state'] = 'valid' and properties['code'] in ('SEA', 'LAND')")
    return vector.edges(found.select("id", F.col("properties")["code"].alias("polygon"), "geometry"), "id", "polygon")


@query
def s21_vector_scan(spark, sf_dir):
    """Valid features of two codes out of GeoJSON: parts, edges and area of each."""
    e = store.cut(_polygon_edges(spark, sf_dir))
    n = e.groupBy("id", "polygon").agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("edges"))
    return n.join(vector.areas(e, "id"), "id").select("id", F.col("polygon").alias("code"), "parts", "edges", _r("area").alias("area"))


@query
def j26_clipped_areas(spark, sf_dir):
    """Polygons clipped to cells: the area of each within each."""
    e = _polygon_edges(spark, sf_dir).select(F.col("id").alias("polygon"), "x1", "y1", "x2", "y2")
    return tiles.clipped_areas(e, 2.0).select(F.col("polygon").alias("id"), "x", "y", _r("area").alias("area")).where("area > 0")


@query
def g14_mapped_fill(spark, sf_dir):
    """The older fill: missing pixels in the mapped sea and not in the mapped land."""
    g = scene.gappy(spark, sf_dir)
    placed = g.join(_centres(g), ["row", "col"]).select("row", "col", "z", "x", "y")
    return fill.mapped(placed, _edges(spark), "outer", "small", 1.6, 4.0).select("row", "col", _r("z").alias("z"), F.col("surface").cast("int").alias("surface"))


@query
def l9_ray_audit(spark, sf_dir):
    """Three pixels of each tile: the block form of the ray operator against the join form."""
    px = store.cut(scene.pixels(spark, sf_dir))
    some = ordered.stratified_sample(px.where("z is not null"), ["tile"], ["row", "col"], 3, 29)
    direct = rays.horizons(some, px, rays.offsets_of(_directions(spark), RADIUS))
    block = rays.block_horizons(px, list(DIRECTIONS), RADIUS, side=32).join(some.select("row", "col"), ["row", "col"], "left_semi")
    bad = impact.differences(direct, block, ["row", "col", "direction"], ["horizon", "support", "blocker"])
    n = direct.agg(F.count(F.lit(1)).alias("rays"), _r(F.sum(F.round(F.col("horizon").cast("double"), 4)), 4).alias("horizon_sum"))
    return n.join(bad.select("only_a", "only_b", "horizon_beyond", "support_beyond", "blocker_beyond"))


@query
def o2_identity(spark, sf_dir):
    """Whether a catalogue's identity changes with its order, its folder, and one height."""
    a, b = geotiff.inventory(spark, _files(spark, sf_dir)), geotiff.inventory(spark, _files(spark, sf_dir))
    to = store.place(spark, "tiles")
    other = scene.gappy(spark, sf_dir).where("supplied").withColumn("z", F.when((F.col("row") == 5) & (F.col("col") == 5), 77.0).otherwise(F.col("z")).cast("float"))
    geotiff.export(geotiff.encoded(other, "z", "f4", codes.NODATA, epsg=2326), to)
    first = catalogue.identity(a)
    same = {"order": first == catalogue.identity(a.orderBy(F.desc("name"))), "folder": first == catalogue.identity(b), "height": first == catalogue.identity(geotiff.inventory(spark, to)), "namespace": first == catalogue.identity(a, "other")}
    return spark.createDataFrame(list(same.items()), "changed string, same boolean")


@query
def s16_cache_check(spark, sf_dir):
    """Kept horizons of which one direction of a tile lost rows, and another's are out of range."""
    px = store.cut(scene.pixels(spark, sf_dir).join(F.broadcast(scene.tiles(spark).select("tile")), "tile").select("tile", "row", "col", "z"))
    kept = store.HorizonStore(spark, store.place(spark, "horizons"))
    wanted = scene.tiles(spark).select("tile", F.explode(F.array(F.lit(45.0), F.lit(215.0))).alias("direction"))
    h = store.cut(run.horizons(px, wanted, run.Request(RADIUS, block=32)))
    lost = (F.col("tile") == "t1_1") & (F.col("direction") == 45.0) & (F.col("row") % 5 == 0)
    wrong = (F.col("tile") == "t2_0") & (F.col("direction") == 215.0) & (F.col("row") > 40)
    kept.put(h.where(~lost).withColumn("horizon", F.when(wrong, F.lit(95.0)).otherwise(F.col("horizon")).cast("float")))
    return kept.problems(px, RADIUS)


@query
def t7_resumed_run(spark, sf_dir):
    """A publication that was left after its first frames, then resumed: the labels of every frame, counted from what is published."""
    to, root = _files(spark, sf_dir), store.place(spark, "published")
    source = catalogue.RawSource(spark, to, 2326)
    times = store.cut(scene.frames(spark, sf_dir))
    sites = scene.tiles(spark).withColumn("tile", F.concat("tile", F.lit(".tif"))).drop("ty", "tx")
    asked = run.Request(RADIUS, block=32, bin_m=BIN)
    kept = store.HorizonStore(spark, store.place(spark, "horizons"))
    first = times.orderBy("frame").limit(100)  # where the first run was lost
    publish.resume(spark, source, (0.0, -32.0, 24.0, 0.0), first, root, "one", asked, sites, kept, at_once=1000, rasters=False)
    publish.resume(spark, source, (0.0, -32.0, 24.0, 0.0), times, root, "one", asked, sites, kept, at_once=1000, rasters=False)
    layers = spark.read.parquet(f"{root}/one/layers")
    return _codes_int(frames.contingency(layers).groupBy("frame", "shade", "quality").agg(F.sum("pixels").alias("pixels")))


@query
def l5_views(spark, sf_dir):
    """Which filled view each result's index names, however deep."""
    o = scene.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("result"), (F.col("o_custkey") % 7).alias("v"))
    line = F.format_string('{"frames": [{"path": "layers/1"}, {"dependencies": {"a": "views/v%d/tiles/t1.tif", "b": ["views/v%d/tiles"]}}], "note": "views/v%d"}', "v", "v", "v")
    views = spark.createDataFrame([(f"views/v{i}",) for i in range(5)], "view string")
    return catalogue.views_of(o.select("result", line.alias("index")), views)
