"""Tiles: range joins as joins of bins, halos, seams, thresholds, owners, mosaics.

Spark has no range join: a bare rectangle predicate compares all pairs. Here each rectangle is listed under the bins that it touches, bins are joined by
equality and the predicate is checked on what meets; a pair is kept in the first bin that both touch, so nothing has to be deduplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import lattice, solar

SIDES = ("left", "bottom", "right", "top")


def range_join(a: DataFrame, b: DataFrame, size: float, buffer: float = 0.0) -> DataFrame:
    """Pairs of rectangles (columns left, bottom, right, top, the ones of b named b_left ...) that intersect, a's widened by buffer. size: of a bin, about a rectangle's."""
    wide = a.withColumns({"_l": F.col("left") - buffer, "_b": F.col("bottom") - buffer, "_r": F.col("right") + buffer, "_t": F.col("top") + buffer})
    wide = wide.withColumn("_x", F.explode(lattice.bins_between("_l", "_r", size))).withColumn("_y", F.explode(lattice.bins_between("_b", "_t", size)))
    other = b.withColumn("_x", F.explode(lattice.bins_between("b_left", "b_right", size))).withColumn("_y", F.explode(lattice.bins_between("b_bottom", "b_top", size)))
    first = (F.col("_x") == F.greatest(lattice.bin_of("_l", size), lattice.bin_of("b_left", size))) & (F.col("_y") == F.greatest(lattice.bin_of("_b", size), lattice.bin_of("b_bottom", size)))
    meet = lattice.intersects(("_l", "_b", "_r", "_t"), tuple(f"b_{s}" for s in SIDES))
    return wide.join(other, ["_x", "_y"]).where(first & meet).drop("_x", "_y", "_l", "_b", "_r", "_t")


def prefixed(df: DataFrame, prefix: str = "b_") -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def touching(tiles: DataFrame, rectangle: tuple[float, float, float, float], buffer: float = 0.0) -> DataFrame:
    """Tiles that a given rectangle, widened by buffer, intersects: a plain filter, which the scan may prune by."""
    l, b, r, t = rectangle
    return tiles.where(lattice.intersects(SIDES, tuple(map(F.lit, (l - buffer, b - buffer, r + buffer, t + buffer)))))


def overlaps(tiles: DataFrame, size: float) -> DataFrame:
    """Pairs of different tiles (tile < b_tile) that share area."""
    return range_join(tiles, prefixed(tiles), size).where(F.col("tile") < F.col("b_tile"))


def halo_members(tiles: DataFrame, centres: DataFrame, size: float, buffer: float) -> DataFrame:
    """Tiles within buffer of any of the centres' rectangles, each once."""
    near = range_join(centres, prefixed(tiles), size, buffer).select(F.col("b_tile").alias("tile")).distinct()
    return tiles.join(near, "tile", "left_semi")


def seams(tiles: DataFrame) -> DataFrame:
    """(tile, b_tile, vertical, low, high): pairs whose edges meet, and the shared span, east-west neighbours by x and north-south ones by y.
    An equality join on the shared edge in half metres, then the overlap."""
    key = lambda c: F.rint(F.col(c) * 2).cast("long")
    other = prefixed(tiles)
    side = tiles.withColumn("_k", key("right")).join(other.withColumn("_k", key("b_left")), "_k").where((F.least("top", "b_top") > F.greatest("bottom", "b_bottom")) & (F.col("tile") != F.col("b_tile")))
    above = tiles.withColumn("_k", key("bottom")).join(other.withColumn("_k", key("b_top")), "_k").where((F.least("right", "b_right") > F.greatest("left", "b_left")) & (F.col("tile") != F.col("b_tile")))
    return side.select("tile", "b_tile", F.lit(True).alias("vertical"), F.greatest("bottom", "b_bottom").alias("low"), F.least("top", "b_top").alias("high")).unionByName(
        above.select("tile", "b_tile", F.lit(False).alias("vertical"), F.greatest("left", "b_left").alias("low"), F.least("right", "b_right").alias("high"))
    )


def seam_differences(pixels: DataFrame) -> DataFrame:
    """(vertical, diff): absolute height differences of neighbouring pixels of different tiles. pixels: tile, row, col, z."""
    own = pixels.where(F.col("z").isNotNull()).select("tile", "row", "col", "z")
    east = own.select(F.col("tile").alias("t2"), "row", (F.col("col") - 1).alias("col"), F.col("z").alias("z2"))
    south = own.select(F.col("tile").alias("t2"), (F.col("row") - 1).alias("row"), "col", F.col("z").alias("z2"))
    diff = F.abs(F.col("z") - F.col("z2")).alias("diff")
    return own.join(east, ["row", "col"]).where(F.col("tile") != F.col("t2")).select(F.lit(True).alias("vertical"), diff).unionByName(own.join(south, ["row", "col"]).where(F.col("tile") != F.col("t2")).select(F.lit(False).alias("vertical"), diff))


def histogram(values: DataFrame, value: str = "diff", width: float = 0.01, most: int = 100_000) -> DataFrame:
    """(bin, n): counts in bins of a width; values from most x width on are in the last bin."""
    return values.groupBy(F.least(F.floor(F.col(value).cast("float") / F.lit(width).cast("float")).cast("long"), F.lit(most).cast("long")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(bins: DataFrame, q: float, width: float = 0.01) -> DataFrame:
    """(quantile): the lower edge of the first bin up to which a share q of the counts lies. A window over bins, which are few whatever the data."""
    from pyspark.sql import Window

    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = bins.agg(F.sum("n").alias("total"))
    return bins.withColumn("c", F.sum("n").over(w)).join(F.broadcast(total)).where(F.col("c") >= F.col("total") * q).agg((F.min("bin") * width).alias("quantile"))


def statistics(pixels: DataFrame) -> DataFrame:
    """(tile, valid, lowest, highest)."""
    return pixels.groupBy("tile").agg(F.count("z").alias("valid"), F.min("z").alias("lowest"), F.max("z").alias("highest"))


#: Side, in pixels, of the cells whose extremes thresholds() keeps.
CELL = 64


def thresholds(tiles: DataFrame, pixels: DataFrame, size: float, buffer: float, distance_m: float = 1000.0) -> DataFrame:
    """(tile, valid, lowest, highest_near, threshold): the highest is looked for in all tiles' pixels within buffer of the tile.

    Pixels are first summed up in cells of CELL x CELL. A cell that is wholly within a tile's buffer answers with its highest pixel; of those that the
    buffer's edge cuts only the ones that are higher than that look at their pixels, so a pixel is read twice at most and copied to few tiles."""
    x, y = (F.col("col") + 0.5) * lattice.RESOLUTION, -(F.col("row") + 0.5) * lattice.RESOLUTION
    z = pixels.where(F.col("z").isNotNull()).select("tile", x.alias("x"), y.alias("y"), "z", F.floor(F.col("row") / CELL).alias("cr"), F.floor(F.col("col") / CELL).alias("cc"))
    cells = store.cut(z.groupBy("tile", "cr", "cc").agg(F.count("z").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"), *[f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))]))
    own = cells.groupBy("tile").agg(F.sum("n").alias("valid"), F.min("low").alias("lowest"))
    boxes = cells.select(F.col("tile").alias("b_tile"), "cr", "cc", "high", *[F.col(c).alias(f"b_{s}") for c, s in zip(("x0", "y0", "x1", "y1"), SIDES, strict=True)])
    # a cell's box may be a single point, which range_join's open rectangles would miss
    eps = lattice.RESOLUTION / 4
    near = range_join(tiles.select("tile", *SIDES), boxes.withColumns({"b_left": F.col("b_left") - eps, "b_bottom": F.col("b_bottom") - eps, "b_right": F.col("b_right") + eps, "b_top": F.col("b_top") + eps}), size, buffer)
    reach = {"left": F.col("left") - buffer, "bottom": F.col("bottom") - buffer, "right": F.col("right") + buffer, "top": F.col("top") + buffer}
    whole = (F.col("b_left") + eps > reach["left"]) & (F.col("b_right") - eps < reach["right"]) & (F.col("b_bottom") + eps > reach["bottom"]) & (F.col("b_top") - eps < reach["top"])
    near = store.cut(near.withColumn("whole", whole))
    sure = near.where("whole").groupBy("tile").agg(F.max("high").alias("sure"))
    cut = near.where("not whole").join(sure, "tile", "left").where("sure is null or high > sure").select(F.col("tile").alias("of"), *[reach[s].alias(s) for s in SIDES], F.col("b_tile").alias("tile"), "cr", "cc")
    inside = (F.col("x") > F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") > F.col("bottom")) & (F.col("y") < F.col("top"))
    edge = z.join(cut, ["tile", "cr", "cc"]).where(inside).groupBy(F.col("of").alias("tile")).agg(F.max("z").alias("edge"))
    out = own.join(sure, "tile", "left").join(edge, "tile", "left").withColumn("highest_near", F.greatest("sure", "edge")).where(F.col("highest_near").isNotNull())
    return out.select("tile", "valid", "lowest", "highest_near", solar.threshold(F.col("highest_near"), F.col("lowest"), distance_m).alias("threshold"))


def region(pixels: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """One row: valid, total, coverage, lowest, highest of a window."""
    inside = pixels.where(F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1))
    return inside.agg(F.count("z").alias("valid"), F.lit(height * width).cast("long").alias("total"), (F.count("z") / F.lit(float(height * width))).alias("coverage"), F.min("z").alias("lowest"), F.max("z").alias("highest"))


def lattice_window(pixels: DataFrame, row0: int, col0: int, height: int, width: int, **fill: object) -> DataFrame:
    """Every address of a window, with the columns of pixels; columns named in fill have that value where there is no pixel."""
    spark = pixels.sparkSession
    grid = spark.range(height * width).select((F.floor(F.col("id") / width) + row0).alias("row"), (F.col("id") % width + col0).alias("col"))
    out = grid.join(pixels.where(F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1)), ["row", "col"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(dict(pixels.dtypes)[c])) for c, v in fill.items()})


def mosaic(layers: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each key of overlapping layers, conflict: whether their values differ."""
    same = F.lit(False)
    for v in values:
        same = same | ~F.min(v).eqNullSafe(F.max(v)) | ((F.count(v) > 0) & (F.count(v) < F.count(F.lit(1))))
    return layers.groupBy(*keys).agg(*[F.min(v).alias(v) for v in values], same.alias("conflict"))


def owners(cells: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """(cell, n, tile): how many tiles own each cell, and which if one does. Cells without a tile stay."""
    found = range_join(cells, prefixed(tiles), size).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("b_tile").alias("t"))
    return cells.select("cell").join(found, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") == 1, F.col("t")).alias("tile"))


def covered_cells(rectangles: DataFrame, size: float) -> DataFrame:
    """(x, y): cells of a lattice that any rectangle touches, each once."""
    return rectangles.withColumn("x", F.explode(lattice.bins_between("left", "right", size))).withColumn("y", F.explode(lattice.bins_between("bottom", "top", size))).select("x", "y").distinct()


def _crossings(points: DataFrame, edges: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """points with each polygon of which an odd number of edges is crossed by the ray to the right of x, y."""
    cut = F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    hit = points.join(edges, on).where((F.col("y") >= F.col("lo")) & (F.col("y") < F.col("hi")) & (cut > F.col("x")))
    return hit.groupBy(*by, "polygon").agg((F.count(F.lit(1)) % 2 == 1).alias("_odd")).where("_odd").drop("_odd")


def inside_polygon(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """points (x, y) with polygon for each polygon that holds them, by the even-odd rule; holes are edges like others.
    edges: polygon, x1, y1, x2, y2.

    In a cell of the size that no edge of a polygon touches, all points are alike: they are decided once, by the cell's centre. Only points in cells along
    a polygon's edges meet that polygon's edges of their band of y."""
    e = edges.where(F.col("y1") != F.col("y2")).withColumns({"lo": F.least("y1", "y2"), "hi": F.greatest("y1", "y2")}).withColumn("_y", F.explode(lattice.bins_between("lo", "hi", size)))
    p = points.withColumns({"_x": lattice.bin_of("x", size), "_y": lattice.bin_of("y", size)})
    cells = p.select("_x", "_y").distinct().withColumns({"x": (F.col("_x") + 0.5) * size, "y": (F.col("_y") + 0.5) * size})
    # the part of an edge within a band, a little widened, and the cells along it; level edges lie in one band
    slant = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    band = edges.withColumn("_y", F.explode(F.sequence(lattice.bin_of(F.least("y1", "y2") - size / 1024, size), lattice.bin_of(F.greatest("y1", "y2") + size / 1024, size))))
    at = lambda y: F.coalesce(F.col("x1") + (y - F.col("y1")) * slant, F.col("x1"))
    y_low, y_high = F.greatest(F.least("y1", "y2"), F.col("_y") * size), F.least(F.greatest("y1", "y2"), (F.col("_y") + 1) * size)
    level = F.col("y1") == F.col("y2")
    ends = F.when(level, F.col("x1")).otherwise(at(y_low)), F.when(level, F.col("x2")).otherwise(at(y_high))
    rim = band.withColumns({"_a": F.least(*ends) - size / 1024, "_b": F.greatest(*ends) + size / 1024})
    rim = rim.select("polygon", "_y", F.explode(F.sequence(lattice.bin_of("_a", size), lattice.bin_of("_b", size))).alias("_x")).distinct()
    full = _crossings(cells, e, ["_y"], ["_x", "_y"]).join(rim, ["polygon", "_x", "_y"], "left_anti")
    sure = p.join(full, ["_x", "_y"]).select(*points.columns, "polygon")
    near = _crossings(p.join(rim, ["_x", "_y"]), e, ["polygon", "_y"], points.columns)
    return sure.unionByName(near.select(*points.columns, "polygon"))


def clipped_areas(edges: DataFrame, size: float) -> DataFrame:
    """(polygon, x, y, area): how much of each cell of the size a polygon covers, for the cells that it covers at all. edges: polygon, x1, y1, x2, y2, with the inside to
    their left (sources.vector.edges).

    An edge counts in the cells that it runs through, by the area under it there, and with its whole width in all cells below: those aren't listed but summed up
    downwards in each column of cells. Only cells that are covered whole, between two edges, are filled in."""
    s, tiny = F.lit(float(size)), 1e-9 * size * size
    e = edges.where(F.col("x1") != F.col("x2")).withColumn("way", F.when(F.col("x2") < F.col("x1"), 1.0).otherwise(-1.0))
    e = e.withColumns({"a": F.least("x1", "x2"), "b": F.greatest("x1", "x2"), "slant": (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))})
    e = e.withColumn("x", F.explode(F.sequence(lattice.bin_of("a", size), lattice.bin_of("b", size))))
    e = e.withColumns({"xa": F.greatest("a", F.col("x") * s), "xb": F.least("b", (F.col("x") + 1) * s)}).where("xa < xb")
    e = e.withColumns({n: F.col("y1") + (F.col(c) - F.col("x1")) * F.col("slant") for n, c in (("ya", "xa"), ("yb", "xb"))})
    e = e.withColumns({"width": F.col("way") * (F.col("xb") - F.col("xa")), "low": lattice.bin_of(F.least("ya", "yb"), size), "high": lattice.bin_of(F.greatest("ya", "yb"), size)})
    run = e.withColumn("y", F.explode(F.sequence(F.col("low"), F.col("high"))))
    bottom, top = F.col("y") * s, (F.col("y") + 1) * s
    within = lambda v: F.least(F.greatest(F.col(v), bottom), top) - bottom
    under = lambda v: within(v) * within(v) / 2 + F.greatest(F.col(v) - top, F.lit(0.0)) * s
    mean = F.when(F.abs(F.col("yb") - F.col("ya")) > 1e-9 * size, (under("yb") - under("ya")) / F.nullif(F.col("yb") - F.col("ya"), F.lit(0.0))).otherwise((within("ya") + within("yb")) / 2)
    there = run.select("polygon", "x", "y", (F.col("width") * mean).alias("part"), F.lit(0.0).alias("below"))
    below = e.select("polygon", "x", (F.col("low") - 1).alias("y"), F.lit(0.0).alias("part"), (F.col("width") * s).alias("below"))
    cell = there.unionByName(below).groupBy("polygon", "x", "y").agg(F.sum("part").alias("part"), F.sum("below").alias("below"))
    down = Window.partitionBy("polygon", "x").orderBy(F.col("y").desc())
    cell = cell.withColumns({"whole": F.sum("below").over(down), "next": F.lead("y").over(down)})
    own = cell.select("polygon", "x", "y", (F.col("part") + F.col("whole")).alias("area"))
    gap = cell.where((F.col("whole") > tiny) & (F.col("next") < F.col("y") - 1)).select("polygon", "x", F.explode(F.sequence(F.col("next") + 1, F.col("y") - 1)).alias("y"), F.col("whole").alias("area"))
    return own.unionByName(gap).where(F.col("area") > tiny)


def of_points(points: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """points (x, y) with the tile that holds them, null in none: west and north edges belong to a tile. Of tiles that overlap each one counts."""
    listed = tiles.withColumns({"_x": F.explode(lattice.bins_between("left", "right", size))}).withColumn("_y", F.explode(F.sequence(lattice.bin_of("bottom", size), lattice.bin_of("top", size))))
    listed = listed.select("_x", "_y", "tile", *SIDES)
    binned = points.withColumns({"_x": lattice.bin_of("x", size), "_y": lattice.bin_of("y", size)})
    on = [binned[c] == listed[c] for c in ("_x", "_y")] + [lattice.holds_point(tuple(listed[c] for c in SIDES), binned["x"], binned["y"])]
    return binned.join(listed, on, "left").select(*[binned[c] for c in points.columns], listed["tile"])


def pitch(tiles: DataFrame) -> Column:
    """The greatest common divisor, in half metres, of tiles' sizes and of their offsets from the least corner; an aggregate column.

    The distinct values are few (they divide a lattice); they are folded by Euclid's steps, of which 64 are enough for any long."""
    step = "aggregate(sequence(1, 64), struct(a AS x, b AS y), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE struct(s.y AS x, s.x % s.y AS y) END, s -> s.x)"
    return F.expr(f"aggregate(array_sort(collect_set(v)), 0L, (a, b) -> {step})")
