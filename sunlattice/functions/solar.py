"""Sun position as column expressions: the fractional-year approximation published by NOAA, with its refraction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published Fourier coefficients (constant, then cosine and sine of each multiple of the year's angle).
EQUATION_OF_TIME = (229.18, 0.000075, ((0.001868, -0.032077), (-0.014615, -0.040849)))
DECLINATION = (1.0, 0.006918, ((-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148)))
#: Geometric elevation of the Sun's centre at sunrise and sunset, with refraction and the disk's radius.
HORIZON = -0.833

#: Steps of a direction's method; None: the azimuth itself.
METHODS = {"nearest5": 5.0, "nearest2_5": 2.5, "direct": None}


def _series(gamma: Column, fixed) -> Column:
    scale, constant, terms = fixed
    total = F.lit(constant)
    for k, (c, s) in enumerate(terms, 1):
        total = total + F.lit(c) * F.cos(gamma * k) + F.lit(s) * F.sin(gamma * k)
    return total * scale


def hour_of_day(utc: Column) -> Column:
    """Hours since midnight, with fractions down to microseconds."""
    return F.hour(utc) + F.minute(utc) / 60.0 + F.date_format(utc, "s.SSSSSS").cast("double") / 3600.0


def year_angle(utc: Column) -> Column:
    """The fractional year as an angle; leap years are longer."""
    y = F.year(utc)
    days = F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 366).otherwise(365)
    return 2 * F.pi() / days * (F.dayofyear(utc) - 1 + (hour_of_day(utc) - 12) / 24.0)


def with_sun(df: DataFrame, utc: str, latitude: Column | str, longitude: Column | str) -> DataFrame:
    """df with azimuth (clockwise from north), geometric and apparent elevation and zenith, in degrees; utc is UTC, with or without zone."""
    lat, lon = (F.radians(latitude), F.col(longitude) if isinstance(longitude, str) else longitude)
    step = df.withColumns({"_g": year_angle(F.col(utc)), "_h": hour_of_day(F.col(utc))})
    step = step.withColumns({"_d": _series(F.col("_g"), DECLINATION), "_a": F.radians(F.pmod(F.col("_h") * 60 + _series(F.col("_g"), EQUATION_OF_TIME) + 4 * lon, F.lit(1440.0)) / 4 - 180)})
    up = F.sin(lat) * F.sin("_d") + F.cos(lat) * F.cos("_d") * F.cos("_a")
    step = step.withColumns({
        "geometric": F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up)))),
        "azimuth": F.pmod(F.degrees(F.atan2(F.sin("_a"), F.cos("_a") * F.sin(lat) - F.tan("_d") * F.cos(lat))) + 180, F.lit(360.0)),
    })
    step = step.withColumn("apparent", F.col("geometric") + refraction(F.col("geometric"))).withColumn("zenith", 90 - F.col("apparent"))
    # one row each: what is above can't be moved below a generator, where these expressions would be spelled out once for each use
    sun = F.inline(F.array(F.struct("azimuth", "geometric", "apparent", "zenith")))
    return step.select(*[F.col(f"`{c}`") for c in df.columns], sun)


def refraction(e: Column) -> Column:
    """Degrees by which the atmosphere lifts the Sun at geometric elevation e."""
    t = F.tan(F.radians(e))
    high = 58.1 / t - 0.07 / F.pow(t, F.lit(3.0)) + 0.000086 / F.pow(t, F.lit(5.0))
    low = 1735 - 518.2 * e + 103.4 * F.pow(e, F.lit(2.0)) - 12.79 * F.pow(e, F.lit(3.0)) + 0.711 * F.pow(e, F.lit(4.0))
    return F.when(e > 85, 0.0).when(e > 5, high / 3600).when(e > -0.575, low / 3600).otherwise(-20.774 / t / 3600)


def direction(azimuth: Column, method: str = "nearest5") -> Column:
    """The direction that stands for an azimuth; half-way azimuths go up, 360 is 0."""
    step = METHODS[method]
    if step is None:
        return F.pmod(azimuth, F.lit(360.0))
    return F.pmod(F.floor((F.pmod(azimuth, F.lit(360.0)) + step / 2) / step) * step, F.lit(360.0))


def threshold(highest: Column, lowest: Column, distance_m: float = 1000.0) -> Column:
    """The elevation up to which terrain beyond the searched distance could still hide the Sun."""
    return F.degrees(F.atan(F.greatest(F.lit(0.0), highest.cast("double") - lowest.cast("double")) / distance_m))


def daylight(days: DataFrame, day: str, latitude: Column, longitude: Column, step_minutes: int = 2, rounds: int = 28) -> DataFrame:
    """(day, sunrise, sunset), in seconds of the epoch (double), of each UTC day of `days` with one of each: the signs of a lattice of instants, then bisection.

    The lattice is a window over each day; the bisection's rounds are columns, so no function of Python's is run."""
    k = F.explode(F.sequence(F.lit(0), F.lit(1440 // step_minutes)))
    lattice = days.select(F.col(day).alias("day"), latitude.alias("_lat"), longitude.alias("_lon")).distinct().withColumn("_k", k)
    lattice = lattice.withColumn("_t", F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("_k") * step_minutes * 60))
    from pyspark.sql import Window

    w = Window.partitionBy("day", "_lat", "_lon").orderBy("_k")
    seen = with_sun(lattice, "_t", F.col("_lat"), F.col("_lon")).withColumn("_v", F.col("geometric") - HORIZON)
    seen = seen.withColumn("_next", F.lead("_v").over(w)).where(F.col("_v") * F.col("_next") < 0)
    x = seen.select("day", "_lat", "_lon", (F.col("_v") > 0).alias("_up"), F.unix_timestamp("_t").cast("double").alias("_lo"), (F.unix_timestamp("_t") + step_minutes * 60).cast("double").alias("_hi"))
    for _ in range(rounds if rounds <= 28 else 28):
        # an instant has microseconds; below that a half doesn't move
        mid = F.floor((F.col("_lo") + F.col("_hi")) / 2 * 1e6) / 1e6
        x = with_sun(x.withColumn("_m", mid).withColumn("_t", F.timestamp_micros((F.col("_m") * 1e6).cast("long"))), "_t", F.col("_lat"), F.col("_lon"))
        same = (F.col("geometric") - HORIZON > 0) == F.col("_up")
        x = x.select("day", "_lat", "_lon", "_up", F.when(same, F.col("_m")).otherwise(F.col("_lo")).alias("_lo"), F.when(same, F.col("_hi")).otherwise(F.col("_m")).alias("_hi"))
    cross = x.withColumn("_c", (F.col("_lo") + F.col("_hi")) / 2).groupBy("day", "_lat", "_lon").agg(F.count(F.lit(1)).alias("_n"), F.min("_c").alias("_a"), F.max("_c").alias("_b"), F.max(F.when(~F.col("_up"), F.col("_c"))).alias("sunrise"), F.max(F.when(F.col("_up"), F.col("_c"))).alias("sunset"))
    return cross.where("_n = 2").select("day", "sunrise", "sunset")
