"""Strips turned towards the Sun: a diagnostic beside the rays of pixels' own centres.

A strip is a grid whose columns run along a direction, its rows away from it; each of its cells takes the height of the pixel it falls on. A cell's horizon is
the steepest rise to the cells before it in its column, so a column is worked on by itself and holds no more cells than the strip is long."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lattice


def turned(pixels: DataFrame, direction: float, centre: tuple[float, float], along: tuple[float, float], across: tuple[float, float], resolution: float = lattice.RESOLUTION) -> DataFrame:
    """(i, j, z) of every cell of a strip. pixels: row, col, z; centre: the row and column that it turns about; along and across: its ends in metres from
    there, along growing away from the direction. Heights outside of the pixels are null."""
    rows, columns = (round((b - a) / resolution) for a, b in (along, across))
    sine, cosine = math.sin(math.radians(direction)), math.cos(math.radians(direction))
    i, j = F.floor(F.col("id") / columns), F.col("id") % columns
    cells = pixels.sparkSession.range(rows * columns).select(i.alias("i"), j.alias("j"))
    t, s = (F.col("i") + 0.5) * resolution + along[0], (F.col("j") + 0.5) * resolution + across[0]
    at = lambda c: F.rint(c).cast("long")
    placed = cells.select("i", "j", at(centre[0] + (t * cosine + s * sine) / resolution).alias("row"), at(centre[1] + (s * cosine - t * sine) / resolution).alias("col"))
    return placed.join(pixels.select("row", "col", "z"), ["row", "col"], "left").select("i", "j", F.col("z").cast("float").alias("z"))


def _rises(z: np.ndarray, support: int, most: int, resolution: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell of a column: the steepest rise (0 at least) to one of `most` cells before it, whether `support` cells before it are known, and the rise's
    distance, the farthest of equal ones."""
    slope, far = np.zeros(len(z)), np.zeros(len(z))
    for d in range(min(most, len(z) - 1), 0, -1):
        v = (z[:-d] - z[d:]) / (d * resolution)
        better = v > slope[d:]
        slope[d:][better] = v[better]
        far[d:][better] = d * resolution
    known = np.concatenate([[0], np.cumsum(np.isfinite(z))])
    i = np.arange(len(z))
    whole = (i >= support) & (known[i] - known[np.maximum(i - support, 0)] == np.minimum(support, i))
    return slope, whole, far


def scanned(strip: DataFrame, support_m: float, most_m: float, resolution: float = lattice.RESOLUTION) -> DataFrame:
    """(i, j, z, slope, support, blocker) of the strip's cells with a height; those before a cell are looked at as far as most_m. A strip's columns start at i = 0."""
    support, most = round(support_m / resolution), int(most_m / resolution)

    def column(c: pd.DataFrame) -> pd.DataFrame:
        z = np.full(int(c["i"].max()) + 1, np.nan)
        z[c["i"].to_numpy()] = c["z"].to_numpy(dtype=float)
        slope, whole, far = _rises(z, support, most, resolution)
        there = np.flatnonzero(np.isfinite(z))
        return pd.DataFrame({"i": there, "j": int(c["j"].iloc[0]), "z": z[there].astype("float32"), "slope": slope[there], "support": whole[there], "blocker": far[there]})

    return strip.groupBy("j").applyInPandas(column, "i long, j long, z float, slope double, support boolean, blocker double")
