"""Small independent versions of the operators in plain Python and numpy, for tests."""

import math

import numpy as np


def ray(z, row, col, azimuth, radius, origin=(0, 0), step=0.25, res=0.5):
    """(slope, support, blocker) of one pixel of z (NaN: missing); what lies outside is missing. Every sample is looked at, in order."""
    dr, dc = -math.cos(math.radians(azimuth)), math.sin(math.radians(azimuth))
    dr, dc = (0.0 if abs(v) < 1e-14 else v for v in (dr, dc))
    rp, cp = (row + origin[0]) % 2, (col + origin[1]) % 2
    slope, support, blocker = 0.0, True, 0.0
    for i in range(1, int(math.floor(radius / step + 1e-10)) + 1):
        d = i * step
        rd, cd = round(rp + dr * d / res) - rp, round(cp + dc * d / res) - cp
        if (rd * rd + cd * cd) * res * res > radius * radius + 1e-9:
            continue
        r, c = row + rd, col + cd
        if not (0 <= r < z.shape[0] and 0 <= c < z.shape[1]) or np.isnan(z[r, c]):
            support = False
            continue
        s = float(np.float32(z[r, c]) - np.float32(z[row, col])) / d
        if s > slope:
            slope, blocker = s, d
    return slope, support, blocker


def label(z, horizon, support, elevation, threshold):
    if z is None:
        return 255, 1
    if elevation <= 0:
        return 255, 4
    if np.float32(horizon) > np.float32(elevation):
        return 1, 0
    if not support:
        return 255, 2
    return (255, 3) if elevation <= threshold else (0, 0)


def sun(t, lat, lon):
    """(azimuth, geometric, apparent) of a naive UTC instant."""
    days = 366 if t.year % 4 == 0 and (t.year % 100 or not t.year % 400) else 365
    hour = t.hour + t.minute / 60 + (t.second + t.microsecond / 1e6) / 3600
    g = 2 * math.pi / days * (t.timetuple().tm_yday - 1 + (hour - 12) / 24)
    eq = 229.18 * (0.000075 + 0.001868 * math.cos(g) - 0.032077 * math.sin(g) - 0.014615 * math.cos(2 * g) - 0.040849 * math.sin(2 * g))
    de = 0.006918 - 0.399912 * math.cos(g) + 0.070257 * math.sin(g) - 0.006758 * math.cos(2 * g) + 0.000907 * math.sin(2 * g) - 0.002697 * math.cos(3 * g) + 0.00148 * math.sin(3 * g)
    ha = math.radians((hour * 60 + eq + 4 * lon) % 1440 / 4 - 180)
    la = math.radians(lat)
    geo = math.degrees(math.asin(math.sin(la) * math.sin(de) + math.cos(la) * math.cos(de) * math.cos(ha)))
    az = (math.degrees(math.atan2(math.sin(ha), math.cos(ha) * math.sin(la) - math.tan(de) * math.cos(la))) + 180) % 360
    t5 = math.tan(math.radians(geo))
    if geo > 85:
        c = 0
    elif geo > 5:
        c = (58.1 / t5 - 0.07 / t5**3 + 0.000086 / t5**5) / 3600
    elif geo > -0.575:
        c = (1735 - 518.2 * geo + 103.4 * geo**2 - 12.79 * geo**3 + 0.711 * geo**4) / 3600
    else:
        c = -20.774 / t5 / 3600
    return az, geo, geo + c


def pixels(spark, z, row0=0, col0=0):
    """A pixel table of an array; NaN is null."""
    rows = [(r + row0, c + col0, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "row long, col long, z float")
