"""Addresses, rectangles and coordinates as column expressions. A pixel's row is -north / 0.5 and its column east / 0.5."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLUTION = 0.5
SNAP = 1e-7


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def intersects(a: tuple, b: tuple) -> Column:
    """Half-open rectangles (left, bottom, right, top) share more than an edge."""
    (al, ab, ar, at), (bl, bb, br, bt) = (tuple(map(_c, r)) for r in (a, b))
    return (al < br) & (bl < ar) & (ab < bt) & (bb < at)


def holds_point(rectangle: tuple, x, y) -> Column:
    """West and north edges belong to a rectangle, east and south ones don't."""
    left, bottom, right, top = map(_c, rectangle)
    return (_c(x) >= left) & (_c(x) < right) & (_c(y) > bottom) & (_c(y) <= top)


def within_closed(rectangle: tuple, x, y) -> Column:
    left, bottom, right, top = (v if isinstance(v, Column) else F.lit(v) for v in rectangle)
    return _c(x).between(left, right) & _c(y).between(bottom, top)


def hit(rectangle: tuple, x, y, resolution: float = RESOLUTION) -> Column:
    """The (row, col) from a rectangle's upper left pixel that a place on the map falls on; null outside. Here west and south edges belong to it."""
    left, bottom, right, top = (v if isinstance(v, Column) else F.lit(v) for v in rectangle)
    inside = (_c(x) >= left) & (_c(x) < right) & (_c(y) >= bottom) & (_c(y) < top)
    return F.when(inside, F.struct(F.floor((top - _c(y)) / resolution).alias("row"), F.floor((_c(x) - left) / resolution).alias("col")))


def row_of(north, resolution: float = RESOLUTION) -> Column:
    return F.rint(-_c(north) / resolution).cast("long")


def column_of(east, resolution: float = RESOLUTION) -> Column:
    return F.rint(_c(east) / resolution).cast("long")


def parity(x) -> Column:
    """0 or 1, of negative addresses too."""
    return F.pmod(_c(x), F.lit(2))


def snapped(left, bottom, right, top, resolution: float = RESOLUTION) -> dict[str, Column]:
    """The smallest rectangle of whole pixels around one, which may be SNAP off."""
    down = lambda v: F.floor(_c(v) / resolution + SNAP) * resolution
    up = lambda v: F.ceil(_c(v) / resolution - SNAP) * resolution
    return {"left": down(left), "bottom": down(bottom), "right": up(right), "top": up(top)}


def bin_of(x, size: float) -> Column:
    """Number of the bin that holds x; floor, so bins below 0 are as wide as others."""
    return F.floor(_c(x) / size).cast("long")


def bins_between(low, high, size: float) -> Column:
    """All bins that the half-open span from low to high touches."""
    return F.sequence(bin_of(low, size), F.greatest(bin_of(low, size), F.ceil(_c(high) / size).cast("long") - 1))


def cell_name(east, north) -> Column:
    """e<east>n<north>, without a fraction of .0."""
    part = lambda v: F.regexp_replace(F.format_string("%.1f", _c(v).cast("double")), r"\.0$", "")
    return F.concat(F.lit("e"), part(east), F.lit("n"), part(north))


# International 1924 ellipsoid, the official grid parameters of the Hong Kong 1980 grid, and the published datum shift from WGS84 in arc seconds.
_A, _FLATTENING = 6378388.0, 1 / 297
_LAT0, _LON0 = 22 + 18 / 60 + 43.68 / 3600, 114 + 10 / 60 + 42.80 / 3600
_EAST0, _NORTH0 = 836694.05, 819069.80
_SHIFT_LAT, _SHIFT_LON = 5.5 / 3600, -8.8 / 3600

_E2 = _FLATTENING * (2 - _FLATTENING)
_EP2 = _E2 / (1 - _E2)
# the meridian's arc: coefficients of the angle and of the sines of 2, 4 and 6 times it
_ARC = (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256, -(3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024), 15 * _E2**2 / 256 + 45 * _E2**3 / 1024, -35 * _E2**3 / 3072)


def _arc_number(phi: float) -> float:
    return _A * (_ARC[0] * phi + sum(c * math.sin(2 * k * phi) for k, c in enumerate(_ARC[1:], 1)))


def to_grid(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """(east, north) in metres of the Hong Kong 1980 grid, of degrees of WGS84; about 1 to 2 m."""
    phi, lam = F.radians(latitude + _SHIFT_LAT), F.radians(longitude + _SHIFT_LON)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    nu = _A / F.sqrt(1 - _E2 * sin * sin)
    t, c, a = tan * tan, _EP2 * cos * cos, (lam - math.radians(_LON0)) * cos
    arc = _A * (_ARC[0] * phi + _ARC[1] * F.sin(2 * phi) + _ARC[2] * F.sin(4 * phi) + _ARC[3] * F.sin(6 * phi))
    a2 = a * a
    east = nu * a * (1 + a2 * ((1 - t + c) / 6 + a2 * (5 - 18 * t + t * t + 72 * c - 58 * _EP2) / 120))
    north = arc - _arc_number(math.radians(_LAT0)) + nu * tan * a2 * (0.5 + a2 * ((5 - t + 9 * c + 4 * c * c) / 24 + a2 * (61 - 58 * t + t * t + 600 * c - 330 * _EP2) / 720))
    return east + _EAST0, north + _NORTH0


def with_geographic(df: DataFrame, east: str, north: str, rounds: int = 4) -> DataFrame:
    """df with latitude and longitude of WGS84 of the grid's metres: the forward projection, undone by steps along the local scale of a degree.

    Each round's result comes out of a generator, so that rounds stay apart and aren't spelled out within each other; four leave less than a
    millimetre on the grid's own area."""
    per_lat, per_lon = 110_737.0, 111_320.0
    keep = [F.col(f"`{c}`") for c in df.columns]
    lat = F.lit(_LAT0 - _SHIFT_LAT) + (F.col(north) - _NORTH0) / per_lat
    lon = F.lit(_LON0 - _SHIFT_LON) + (F.col(east) - _EAST0) / (per_lon * math.cos(math.radians(_LAT0)))
    step = df.select(*keep, F.inline(F.array(F.struct(lat.alias("latitude"), lon.alias("longitude")))))
    for _ in range(rounds):
        e, n = to_grid(F.col("latitude"), F.col("longitude"))
        lat, lon = F.col("latitude") + (F.col(north) - n) / per_lat, F.col("longitude") + (F.col(east) - e) / (per_lon * F.cos(F.radians("latitude")))
        step = step.select(*keep, F.inline(F.array(F.struct(lat.alias("latitude"), lon.alias("longitude")))))
    return step


def degrees_of(text: Column) -> Column:
    """Decimal degrees of decimal or degree-minute-second text; S and W are negative; NULL if it is neither."""
    t = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    n = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)).cast("array<double>")
    sign = F.when(t.rlike(r"(?i)\b(south|west|s|w)\b"), -1.0).otherwise(1.0)
    plain = F.when(t.rlike(r"^[+-]?\d+\.?\d*$|^[+-]?\.\d+$"), t.cast("double")).otherwise(sign * F.get(n, F.lit(0)))
    dms = F.when((F.get(n, F.lit(1)) < 60) & (F.get(n, F.lit(2)) < 60), sign * (F.get(n, F.lit(0)) + F.get(n, F.lit(1)) / 60 + F.get(n, F.lit(2)) / 3600))
    return F.when(F.size(n) == 1, plain).when(F.size(n) == 3, dms)


def safe_relative(path: Column) -> Column:
    """A relative path of plain names, without steps upward."""
    return path.rlike(r"^[^/\\\x00]+(/[^/\\\x00]+)*$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)")
