"""The fill view: which missing pixels are water, by their distance to low and high shores and whether they are open to the outside."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..functions import codes, lattice
from . import blocks, quantiles, tiles

STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))
DIAGONALS = ((-1, -1), (-1, 1), (1, -1), (1, 1))


@dataclass(frozen=True)
class Profile:
    """Metres. Water is at most max_shore_m from a low shore, and no more than preference_m farther from it than from a high one."""

    sea_m: float
    low_margin_m: float
    max_shore_m: float
    preference_m: float
    exclusions: tuple[tuple[float, float, float, float], ...] = ()


def neighbours(cells: DataFrame, eight: bool = False) -> DataFrame:
    """(row, col, nr, nc): each cell with the addresses beside it."""
    steps = STEPS + (DIAGONALS if eight else ())
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps]))
    return cells.select("row", "col", each.alias("s")).select("row", "col", (F.col("row") + F.col("s.r")).alias("nr"), (F.col("col") + F.col("s.c")).alias("nc"))


def beside(cells: DataFrame, others: DataFrame, eight: bool = False) -> DataFrame:
    """Cells (row, col) that are beside one of the others."""
    at = neighbours(others.select("row", "col"), eight).select(F.col("nr").alias("row"), F.col("nc").alias("col")).distinct()
    return cells.join(at, ["row", "col"], "left_semi")


def shores(pixels: DataFrame, profile: Profile) -> DataFrame:
    """(row, col, z, low): observed pixels beside a missing one; what lies outside the scene isn't missing. pixels: every address, z."""
    bad = codes.missing_literal(F.col("z"))
    return beside(pixels.where(~bad), pixels.where(bad)).select("row", "col", "z", (F.col("z") <= F.lit(profile.sea_m + profile.low_margin_m)).alias("low"))


def shore_gate(shore: DataFrame, lowest: float, highest: float) -> DataFrame:
    """One row: the shore's heights as quantiles, their number, and whether the median is in the range that a policy's sea height was chosen for; not where there are none."""
    names = {f"p{q}": q / 100 for q in (5, 25, 50, 75, 95)}
    z = store.cut(shore.select(F.col("z").cast("double").alias("z")))
    n = z.agg(F.count("z").alias("n"))
    return n.join(quantiles.exact(z, "z", names)).withColumn("accepted", F.coalesce(F.col("p50").between(lowest, highest), F.lit(False)))


def mapped(pixels: DataFrame, edges: DataFrame, sea: str, land: str, sea_m: float, size: float) -> DataFrame:
    """(row, col, z, surface): a fill by a mapped coastline instead of by shores. A missing pixel whose centre is in a polygon of the sea and in none of the land takes
    the sea's height and surface 1; other missing ones are 255, observed ones 0. pixels: row, col, z, x, y; edges: polygon (its code), x1, y1, x2, y2."""
    gaps = pixels.where(codes.missing_literal(F.col("z"))).select("row", "col", "x", "y")
    met = tiles.inside_polygon(gaps, edges.where(F.col("polygon").isin(sea, land)), size).groupBy("row", "col").agg(F.max(F.col("polygon") == land).alias("_land"))
    both = pixels.join(met, ["row", "col"], "left")
    missing = codes.missing_literal(F.col("z"))
    water = missing & F.coalesce(~F.col("_land"), F.lit(False))
    surface = F.when(water, 1).when(missing, 255).otherwise(0).cast("smallint")
    return both.select("row", "col", F.when(water, F.lit(sea_m).cast("float")).when(~missing, F.col("z")).alias("z"), surface.alias("surface"))


def _label(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, as the least flat index of each; -1 outside. Rounds of minima along runs: as many as the windings of a component."""
    h, w = mask.shape
    out = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        was = out.copy()
        for axis in (0, 1):
            a = out if axis == 1 else out.T
            m = mask if axis == 1 else mask.T
            for flip in (False, True):
                x, y = (a[:, ::-1], m[:, ::-1]) if flip else (a, m)
                # a minimum along each run of the mask: runs are told apart by a growing offset
                run = np.cumsum(~y, axis=1)
                key = x.astype(np.int64) - run.astype(np.int64) * (h * w + 1)
                best = np.minimum.accumulate(key, axis=1) + run.astype(np.int64) * (h * w + 1)
                x[...] = np.where(y, best, x)
        if (out == was).all():
            return np.where(mask, out, -1)


def components(cells: DataFrame, side: int = 1024, name: str = "component") -> DataFrame:
    """cells (row, col) with component: the smallest address of its 4-connected component, as row * 2^32 + col.

    Blocks of side x side cells are labelled as arrays; the labels that touch across block edges are merged by rounds of least neighbours over
    those edges only, which are as many as blocks' borders are long."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["row"].min()), int(pdf["col"].min())
        r, c = pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left
        mask = np.zeros((r.max() + 1, c.max() + 1), bool)
        mask[r, c] = True
        lab = _label(mask)[r, c]
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "local": (lab // mask.shape[1] + top) * (1 << 32) + lab % mask.shape[1] + left})

    keyed = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.floor(F.col("row") / side).alias("br"), F.floor(F.col("col") / side).alias("bc"))
    local = store.cut(keyed.groupBy("br", "bc").applyInPandas(block, "row long, col long, local long"))
    edge = lambda c: (F.pmod(F.col(c), F.lit(side)) == 0) | (F.pmod(F.col(c), F.lit(side)) == side - 1)
    border = local.where(edge("row") | edge("col"))
    across = neighbours(border).join(border.select(F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("local").alias("b")), ["nr", "nc"]).join(border, ["row", "col"]).where("local <> b").select(F.col("local").alias("a"), "b").distinct()
    roots = merge(across)
    return local.join(roots, local["local"] == roots["node"], "left").select("row", "col", F.coalesce("root", "local").alias(name))


def merge(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of symmetric links (a, b). Each round takes the least root beside a node, then that root's own root, until
    nothing changes."""
    nodes = store.cut(links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")))
    both = store.cut(links.union(links.select("b", "a")).distinct().toDF("a", "b"))
    while True:
        near = both.join(nodes.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        low = nodes.join(near, "node", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("was"))
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("r2"))
        after = store.cut(low.join(jump, "root", "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root"), "was"))
        if after.where("root <> was").isEmpty():
            store.drop(both)
            return after.drop("was")
        store.drop(nodes)
        nodes = after.drop("was")
        nodes._sunlattice_path = after._sunlattice_path


def opened(cells: DataFrame, row0: int, col0: int, height: int, width: int, side: int = 1024) -> DataFrame:
    """cells (row, col) with component and open: whether its component reaches the domain's edge."""
    found = components(cells, side)
    rim = (F.col("row") == row0) | (F.col("row") == row0 + height - 1) | (F.col("col") == col0) | (F.col("col") == col0 + width - 1)
    reach = found.groupBy("component").agg(F.max(rim).alias("open"))
    return found.join(reach, "component")


def nearest(points: DataFrame, shore: DataFrame, most: float, name: str, side: int = 1024) -> DataFrame:
    """points (row, col, ...) with name: the distance in pixels to the nearest shore pixel within most, else null.

    Blocks with a halo of the distance (blocks.py), in which the exact transform is taken in two passes: the nearest shore pixel of each column, then the
    least over columns, from the near ones outwards until none can be nearer. A task's time is side x (side + 2 most) x most at worst, whatever the shores."""
    halo = int(math.ceil(most))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields if f.name not in ("row", "col")], f"{name} double"])
    at = lambda df: df.withColumns({"row": F.col("row").cast("long"), "col": F.col("col").cast("long")})
    both = at(points).withColumn("_shore", F.lit(False)).unionByName(at(shore).select("row", "col", F.lit(True).alias("_shore")), allowMissingColumns=True)

    def kernel(br, bc, mine, pieces):
        asked = mine.filter(pc.invert(mine["_shore"]))
        if not asked.num_rows:
            return
        land = np.zeros((side + 2 * halo,) * 2, bool)
        for t in (mine.filter(mine["_shore"]), *pieces):
            land[t["row"].to_numpy() + halo, t["col"].to_numpy() + halo] = True
        r, c = asked["row"].to_numpy(), asked["col"].to_numpy()
        d2 = _squares(land, halo, side, int(most * most + 1e-6))[r, c]
        t = asked.drop_columns(["_shore"]).append_column(name, pa.array(np.sqrt(d2.astype(float)), mask=d2 == FAR))
        yield t.set_column(t.column_names.index("row"), "row", pa.array(r + np.int64(br * side))).set_column(t.column_names.index("col"), "col", pa.array(c + np.int64(bc * side)))

    return blocks.apply(blocks.with_halo(both, side, halo, (), "_shore"), kernel, "row long, col long, " + schema).select(*points.columns, name)


#: A squared distance that stands for none.
FAR = 1 << 40


def _squares(land: np.ndarray, halo: int, side: int, most2: int) -> np.ndarray:
    """Squared distances of the inner side x side pixels to the nearest True one, up to most2; FAR beyond."""
    i = np.arange(land.shape[0], dtype=np.int64)[:, None]
    above = np.maximum.accumulate(np.where(land, i, -FAR), axis=0)
    below = np.minimum.accumulate(np.where(land, i, FAR)[::-1], axis=0)[::-1]
    gap = np.minimum(np.minimum(i - above, below - i)[halo : halo + side], 1 << 20)
    column = np.where(gap == 1 << 20, FAR, gap * gap)
    best = column[:, halo : halo + side].copy()
    for x in range(1, halo + 1):
        if x * x >= best.max() or x * x > most2:
            break
        for shift in (-x, x):
            np.minimum(best, column[:, halo + shift : halo + shift + side] + x * x, out=best)
    return np.where(best <= most2, best, FAR)


def surface(pixels: DataFrame, profile: Profile, row0: int, col0: int, height: int, width: int, resolution: float = lattice.RESOLUTION, side: int = 1024) -> DataFrame:
    """pixels with surface: 0 observed, 1 water, 2 water without a tile, 3 enclosed, 4 other gap. pixels: every address of the domain, z, supplied."""
    bad = codes.missing_literal(F.col("z"))
    gaps = opened(pixels.where(bad).select("row", "col"), row0, col0, height, width, side)
    shore = shores(pixels, profile)
    x, y = (F.col("col") + 0.5) * resolution, -(F.col("row") + 0.5) * resolution
    out = F.lit(False)
    for zone in profile.exclusions:
        out = out | lattice.within_closed(zone, x, y)
    asked = gaps.where(F.col("open") & ~out).select("row", "col")
    most, prefer = profile.max_shore_m / resolution, profile.preference_m / resolution
    near = nearest(nearest(asked, shore.where("low"), most, "dl").where(F.col("dl").isNotNull()), shore.where(~F.col("low")), most + prefer, "dh")
    water = near.where((F.col("dl") <= most) & (F.col("dh").isNull() | (F.col("dl") <= F.col("dh") + prefer))).select("row", "col", F.lit(True).alias("water"))
    joined = pixels.join(gaps.select("row", "col", "open", "component"), ["row", "col"], "left").join(water, ["row", "col"], "left")
    code = F.when(~bad, 0).when(F.col("water"), F.when(F.col("supplied"), 1).otherwise(2)).when(F.col("open"), 4).otherwise(3)
    return joined.select(*pixels.columns, "component", code.cast("smallint").alias("surface"))


def filled(view: DataFrame, sea_m: float) -> DataFrame:
    """view with z of the sea's height on water; other heights keep their bits, other gaps stay gaps."""
    return view.withColumn("z", F.when(F.col("surface").isin(1, 2), F.lit(sea_m).cast("float")).when(F.col("surface") == 0, F.col("z")))


def component_statistics(labelled: DataFrame, least: int = 1, tile: str = "tile") -> DataFrame:
    """(component, pixels, row_min, row_max, col_min, col_max, tiles) of components of at least so many pixels."""
    agg = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("pixels"), *[f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))], F.countDistinct(tile).alias("tiles"))
    return agg.where(F.col("pixels") >= least)


def enclosed_shores(labelled: DataFrame, pixels: DataFrame) -> DataFrame:
    """(component, shore_pixels, p10, p50, p90) of the observed pixels around each component, each counted once for a component it touches."""
    at = neighbours(labelled.select("row", "col")).join(labelled.select("row", "col", "component"), ["row", "col"]).select("component", F.col("nr").alias("row"), F.col("nc").alias("col")).distinct()
    z = F.col("z").cast("double")
    seen = at.join(pixels.where(~codes.missing_literal(F.col("z"))).select("row", "col", "z"), ["row", "col"])
    p = F.percentile(z, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return seen.groupBy("component").agg(F.count(F.lit(1)).alias("shore_pixels"), p.alias("p")).select("component", "shore_pixels", *[F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])
