"""Label, surface and dependency codes.

shade: 0 sunlit, 1 shaded, 255 unknown. quality: 0 known, 1 no height, 2 a ray left the data, 3 the Sun is no higher than the tile's threshold, 4 the Sun is down.
surface: 0 observed, 1 water, 2 water where no tile was supplied, 3 enclosed gap, 4 other gap, 255 outside.
dependency: 0 same without the fill, 1 known only with it, 2 changed by it, 3 a filled pixel, 4 unknown, 255 outside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SHADES, QUALITIES, SURFACES, DEPENDENCIES = (0, 1, 255), (0, 1, 2, 3, 4), (0, 1, 2, 3, 4, 255), (0, 1, 2, 3, 4)
NODATA = -9999.0
#: Report groups by surface code, for the raw surface (policy "raw": 0 land, else gap) and the filled one.
GROUPS = {"land": (0, 3), "water": (1, 2), "other": (4,)}


def missing_literal(z: Column) -> Column:
    """Not finite, or the no-data value itself."""
    d = z.cast("double")
    return z.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))) | (d == NODATA)


def missing_declared(z: Column, nodata: Column) -> Column:
    """Null, NaN, or the value that a tile declares."""
    return z.isNull() | F.isnan(z.cast("double")) | F.coalesce(z.cast("double") == nodata.cast("double"), F.lit(False))


def shade(z: Column, horizon: Column, support: Column, elevation: Column, threshold: Column) -> Column:
    q = quality(z, horizon, support, elevation, threshold)
    return F.when(q != 0, 255).when(horizon > elevation.cast("float"), 1).otherwise(0).cast("smallint")


def quality(z: Column, horizon: Column, support: Column, elevation: Column, threshold: Column) -> Column:
    """Why a label isn't known, the first reason that holds. A horizon is single precision, and so is the elevation it is held against."""
    return (
        F.when(z.isNull(), 1).when(elevation <= 0, 4).when(horizon > elevation.cast("float"), 0)
        .when(F.coalesce(support, F.lit(0)) == 0, 2).when(elevation <= threshold, 3).otherwise(0).cast("smallint")
    )


def consistent(shade_: Column, quality_: Column) -> Column:
    """Codes of their domains, and a label exactly where quality is 0."""
    return shade_.isin(*SHADES) & quality_.isin(*QUALITIES) & ((shade_ == 255) == (quality_ != 0))


def dependency(surface: Column, filled: Column, raw: Column) -> Column:
    return (
        F.when(surface > 4, 255).when(filled == 255, 4).when(surface != 0, 3).when(raw == filled, 0).when(raw == 255, 1).otherwise(2).cast("smallint")
    )


def group_of(surface: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, members in GROUPS.items():
        out = F.when(surface.isin(*members), name).otherwise(out)
    return out


def identity(*columns: Column | str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys."""
    named = sorted(((c if isinstance(c, str) else c._jc.toString()), c) for c in columns)
    return F.sha2(F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c) for _, c in named])), 256)
