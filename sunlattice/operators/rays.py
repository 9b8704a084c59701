"""Horizons along rays: for each pixel and direction the steepest slope to a sample within a distance, whether all samples were there, and how far the steepest is.

Two forms of the same operator. `horizons` is a join with a small table of offsets and one aggregation, for small scenes. `block_horizons`
is for tiles of real size: pixels are dealt to blocks with a halo of the search distance, and each block is worked on as arrays.

A ray is sampled every STEP_M; a sample is the pixel nearest to it, ties going to the even address, so results don't depend on how the pixels
are cut. Consecutive samples often hit the same pixel; only the nearest of those can decide (a slope above 0 falls with distance), so one
offset is kept for each pixel hit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks

STEP_M = 0.25
RESOLUTION = 0.5
ZERO = 1e-14
#: Rows of an offset table that is broadcast: directions x 4 parities x samples. More are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Pixels of a strip of the kernel: its six arrays take 3 MB.
STRIP = 1 << 17


def offset_rows(directions: list[float], radius_m: float, step_m: float = STEP_M, resolution: float = RESOLUTION) -> list[tuple[float, int, int, int, int, float]]:
    """(direction, row parity, column parity, rows off, columns off, nominal distance), the nearest for each pixel hit."""
    return [(a, rp, cp, r, c, d) for a in directions for (rp, cp), xs in ray(a, radius_m, step_m, resolution).items() for r, c, d in zip(*(x.tolist() for x in xs), strict=True)]


def ray(direction: float, radius_m: float, step_m: float = STEP_M, resolution: float = RESOLUTION) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{(row parity, column parity): (rows off, columns off, distance)} of one direction, by rising distance."""
    distance = np.arange(1, int(math.floor(radius_m / step_m + 1e-10)) + 1) * step_m
    down, right = (0.0 if abs(v) < ZERO else v for v in (-math.cos(math.radians(direction)), math.sin(math.radians(direction))))
    out = {}
    for rp in (0, 1):
        for cp in (0, 1):
            # numpy rounds half to even
            rd, cd = np.rint(rp + down * distance / resolution).astype(np.int64) - rp, np.rint(cp + right * distance / resolution).astype(np.int64) - cp
            near = np.nonzero((rd * rd + cd * cd) * resolution * resolution <= radius_m * radius_m + 1e-9)[0]
            # the first sample of each pixel hit
            first = near[np.sort(np.unique(rd[near] * (1 << 32) + cd[near], return_index=True)[1])]
            out[rp, cp] = rd[first], cd[first], distance[first]
    return out


def offsets(spark: SparkSession, directions: list[float], radius_m: float) -> DataFrame:
    return spark.createDataFrame(offset_rows(sorted(set(directions)), radius_m), "direction double, rp int, cp int, rd int, cd int, dist double")


def offsets_of(directions: DataFrame, radius_m: float, step_m: float = STEP_M, resolution: float = RESOLUTION) -> DataFrame:
    """offset_rows() of a table's distinct `direction`s, in DataFrame functions."""
    snap = lambda c: F.when(F.abs(c) < ZERO, F.lit(0.0)).otherwise(c)
    d = directions.select("direction").distinct().withColumns({"dr": snap(-F.cos(F.radians("direction"))), "dc": snap(F.sin(F.radians("direction")))})
    steps = int(math.floor(radius_m / step_m + 1e-10))
    d = d.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"rp": F.floor(F.col("p") / 2).cast("int"), "cp": (F.col("p") % 2).cast("int")})
    d = d.withColumn("dist", F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: i * F.lit(step_m))))
    at = lambda p, v: (F.rint(F.col(p) + F.col(v) * F.col("dist") / resolution).cast("int") - F.col(p)).cast("int")
    d = d.withColumns({"rd": at("rp", "dr"), "cd": at("cp", "dc")}).where((F.col("rd") * F.col("rd") + F.col("cd") * F.col("cd")) * resolution**2 <= radius_m**2 + 1e-9)
    return d.groupBy("direction", "rp", "cp", "rd", "cd").agg(F.min("dist").alias("dist"))


def horizons(targets: DataFrame, samples: DataFrame, offs: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """(row, col, z, direction, slope, horizon, support, blocker) of each target with a height, in each direction of the offsets.

    targets: row, col, z, and direction if each has directions of its own; samples: row, col, z. A target whose samples are all missing stays, with slope 0.
    Offsets are broadcast if they are at most MOST_BROADCAST rows, which is counted unless broadcast says."""
    if broadcast is None:
        broadcast = offs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    own = "direction" in targets.columns
    t = targets.where(F.col("z").isNotNull()).select("row", "col", "z", *(["direction"] if own else []), F.pmod("row", F.lit(2)).cast("int").alias("rp"), F.pmod("col", F.lit(2)).cast("int").alias("cp"))
    o = F.broadcast(offs) if broadcast else offs
    rays = t.join(o, ["rp", "cp", "direction"] if own else ["rp", "cp"]).withColumns({"sr": F.col("row") + F.col("rd"), "sc": F.col("col") + F.col("cd")})
    there = samples.where(F.col("z").isNotNull()).select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col("z").alias("sz"))
    # heights are subtracted in single precision, then divided in double
    slope = (F.col("sz") - F.col("z")).cast("double") / F.col("dist")
    seen = rays.join(there, ["sr", "sc"], "left").withColumn("s", slope)
    # the steepest, and of equal ones the nearest, as one maximum: partial aggregates stay one row a pixel and direction
    best = F.max(F.when(F.col("s") > 0, F.struct(F.col("s").alias("slope"), (-F.col("dist")).alias("near"))))
    out = seen.groupBy("row", "col", "z", "direction").agg(best.alias("b"), F.min(F.when(F.col("sz").isNull(), 0).otherwise(1)).cast("smallint").alias("support"))
    return out.select("row", "col", "z", "direction", F.coalesce("b.slope", F.lit(0.0)).alias("slope"), "support", F.coalesce(-F.col("b.near"), F.lit(0.0)).cast("float").alias("blocker")).withColumn("horizon", F.degrees(F.atan("slope")).cast("float"))


def of_window(pixels: DataFrame, window: tuple[int, int, int, int], directions: DataFrame, radius_m: float, resolution: float = RESOLUTION) -> DataFrame:
    """horizons() of the pixels of a window (first row, first column, height, width) alone; of the others only those within the radius are read."""
    row, col, height, width = window
    reach = math.ceil(radius_m / resolution) + 1
    inside = lambda by: F.col("row").between(row - by, row + height - 1 + by) & F.col("col").between(col - by, col + width - 1 + by)
    return horizons(pixels.where(inside(0)), pixels.where(inside(reach)), offsets_of(directions, radius_m, resolution=resolution))


def coarse_offsets(directions: DataFrame, radius_m: float) -> DataFrame:
    """Offsets of the independent check: samples every pixel from the target's own centre, whatever its parity; a farther sample may hit a pixel twice."""
    d = directions.select("direction").distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(int(radius_m / RESOLUTION)))))
    at = lambda v, p: (F.rint(p + v * F.col("i")).cast("int") - p).cast("int")
    rad = F.radians("direction")
    d = d.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"rp": F.floor(F.col("p") / 2).cast("int"), "cp": (F.col("p") % 2).cast("int")})
    d = d.withColumns({"rd": at(-F.cos(rad), F.col("rp")), "cd": at(F.sin(rad), F.col("cp"))}).where((F.col("rd") * F.col("rd") + F.col("cd") * F.col("cd")) * 0.25 <= radius_m**2 + 1e-9)
    return d.groupBy("direction", "rp", "cp", "rd", "cd").agg((F.min("i") * RESOLUTION).alias("dist"))


def scan_array(z: np.ndarray, own: tuple[slice, slice], offs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]], row0: int, col0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slope, support, blocker) of the part `own` of a block of heights (NaN: missing) whose first pixel has the address row0, col0, along one ray().
    What lies outside the block is missing.

    Pixels of equal parities are a plane, in which a ray's offset is a plain shift; planes are worked on in strips that fit a core's cache."""
    height, width = own[0].stop - own[0].start, own[1].stop - own[1].start
    pad = max([2, *(int(np.abs(x).max()) for rd, cd, _ in offs.values() for x in (rd, cd) if len(x))])
    rows, cols = (max(0, pad - own[0].start), max(0, pad - (z.shape[0] - own[0].stop))), (max(0, pad - own[1].start), max(0, pad - (z.shape[1] - own[1].stop)))
    whole = np.pad(z, (rows, cols), constant_values=np.nan) if any(rows + cols) else z
    r0, c0 = own[0].start + rows[0], own[1].start + cols[0]
    planes = {(a, b): np.ascontiguousarray(whole[a::2, b::2]) for a in (0, 1) for b in (0, 1)}
    gaps, top = bool(np.isnan(whole).any()), np.nanmax(whole) if not np.isnan(whole).all() else np.nan
    slope, support, blocker = np.zeros((height, width)), np.ones((height, width), bool), np.zeros((height, width), np.float32)
    for (rp, cp), (rd, cd, dist) in offs.items():
        a, b = (rp - (row0 + own[0].start)) % 2, (cp - (col0 + own[1].start)) % 2
        n, m = len(range(a, height, 2)), len(range(b, width, 2))
        if not n or not m:
            continue
        mine = planes[(r0 + a) % 2, (c0 + b) % 2][(r0 + a) // 2 :, (c0 + b) // 2 :]
        shifts = [(planes[(r0 + a + r) % 2, (c0 + b + c) % 2], (r0 + a + r) // 2, (c0 + b + c) // 2, d) for r, c, d in zip(rd.tolist(), cd.tolist(), dist.tolist(), strict=True)]
        strip = max(1, STRIP // m)
        for i in range(0, n, strip):
            k = min(strip, n - i)
            t = np.ascontiguousarray(mine[i : i + k, :m])
            low = np.nanmin(t) if not np.isnan(t).all() else np.nan
            rise, least, up = np.empty((k, m), np.float32), np.empty((k, m), np.float32), np.empty((k, m), bool)
            best, far, seen = np.zeros((k, m)), np.zeros((k, m), np.float32), np.full((k, m), -np.inf, np.float32)
            rough = np.zeros((k, m), np.float32)  # best in single precision, to tell cheaply what can't be steeper
            climbing = not np.isnan(low)
            with np.errstate(invalid="ignore"):
                for j, (plane, y, x, d) in enumerate(shifts):
                    s = plane[y + i : y + i + k, x : x + m]
                    if climbing:
                        np.subtract(s, t, out=rise)
                        np.multiply(rough, np.float32(d * (1 - 1e-6)), out=least)
                        np.greater(rise, least, out=up)
                        some = np.flatnonzero(up)
                        if len(some):
                            steep = rise.ravel()[some].astype(np.float64) / d
                            new = steep > best.ravel()[some]
                            some, steep = some[new], steep[new]
                            best.ravel()[some], rough.ravel()[some], far.ravel()[some] = steep, steep, d
                        if j % 64 == 63:  # nothing beyond can be steeper than the highest pixel would be
                            climbing = float(top - low) / d * (1 + 1e-6) > best[~np.isnan(t)].min()
                    if gaps:
                        np.maximum(seen, s, out=seen)  # NaN stays
                    elif not climbing:
                        break
            slope[a::2, b::2][i : i + k], blocker[a::2, b::2][i : i + k] = best, far
            support[a::2, b::2][i : i + k] = ~np.isnan(seen)
    return slope, support, blocker


def block_horizons(pixels: DataFrame, wanted: DataFrame | list[float], radius_m: float, side: int = 2048, resolution: float = RESOLUTION, split: int = 1) -> DataFrame:
    """horizons() of every pixel with a height, by blocks of side x side pixels with a halo of the search distance (blocks.py).

    pixels: row, col, z, and further columns, which are kept. wanted: directions, or a table of direction, or of (tile, direction): then a pixel gets its
    tile's directions only. All directions of a block are worked on in one task, one after the other, so its memory is that of a block and halo and of one
    direction's rows, however many there are; with split, they are dealt to so many tasks."""
    halo = int(math.ceil(radius_m / resolution))
    spark = pixels.sparkSession
    if isinstance(wanted, list):
        wanted = spark.createDataFrame([(float(v),) for v in sorted(set(wanted))], "direction double")
    own = "tile" in wanted.columns
    there = pixels.where(F.col("z").isNotNull()).withColumn("z", F.col("z").cast("float"))
    kept = [f for f in there.schema.fields if f.name not in ("row", "col", "z")]
    packed = blocks.with_halo(there, side, halo, ("z",))
    what = F.collect_set(F.struct(*([F.col("tile")] if own else [F.lit("").alias("tile")]), "direction")).alias("wanted")
    part = F.pmod(F.xxhash64("direction"), F.lit(split)).alias("part")
    if own:
        at = there.select(F.floor(F.col("row") / side).alias("br"), F.floor(F.col("col") / side).alias("bc"), "tile").distinct()
        asked = at.join(wanted.select("tile", "direction").distinct(), "tile").groupBy("br", "bc", part).agg(what)
        packed = packed.join(asked, ["br", "bc"])
    else:
        packed = packed.join(wanted.select("direction").distinct().groupBy(part).agg(what))

    def kernel(br, bc, mine, pieces, _part, wanted_):
        field = blocks.field(mine, pieces, side, halo, "z")
        r, c = mine["row"].to_numpy(), mine["col"].to_numpy()
        tall, wide = int(r.max()) + 1, int(c.max()) + 1  # of the block's pixels; the rest of a block at the scene's edge is empty
        by: dict[float, list[str]] = {}
        for w in wanted_:
            by.setdefault(w["direction"], []).append(w["tile"])
        for a in sorted(by):
            slope, support, blocker = (x[r, c] for x in scan_array(field, (slice(halo, halo + tall), slice(halo, halo + wide)), ray(a, radius_m, resolution=resolution), br * side - halo, bc * side - halo))
            t = mine
            for name, values in (("direction", np.full(len(r), a)), ("slope", slope), ("support", support.astype(np.int16)), ("blocker", blocker), ("horizon", np.degrees(np.arctan(slope)).astype(np.float32))):
                t = t.append_column(name, pa.array(values))
            t = t.set_column(t.column_names.index("row"), "row", pa.array(r + np.int64(br * side))).set_column(t.column_names.index("col"), "col", pa.array(c + np.int64(bc * side)))
            yield t.filter(pc.is_in(t["tile"], pa.array(by[a]))) if own else t

    schema = ", ".join(["row long", "col long", "z float", *[f"{f.name} {f.dataType.simpleString()}" for f in kept], "direction double", "slope double", "support smallint", "blocker float", "horizon float"])
    return blocks.apply(packed, kernel, schema, ("part",), ("wanted",))
