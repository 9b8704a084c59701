from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sunlattice.functions import lattice, solar
from sunlattice.operators import ordered
from tests import oracle


def test_positions(spark):
    times = [datetime(2024, 2, 29, 23, 59, 59, 999999), datetime(2023, 12, 31, 0, 0), datetime(2026, 1, 7, 1, 0), datetime(2026, 6, 21, 4, 17, 3, 250000)] + [datetime(2024, 1, 1) + timedelta(hours=7 * i) for i in range(40)]
    sites = [(22.34, 114.26), (52.37, 4.9), (-33.9, 18.4), (0.0, -179.5)]
    df = spark.createDataFrame([(t, a, b) for t in times for a, b in sites], "t timestamp_ntz, lat double, lon double")
    for r in solar.with_sun(df, "t", "lat", "lon").collect():
        az, geo, app = oracle.sun(r.t, r.lat, r.lon)
        assert r.geometric == pytest.approx(geo, abs=1e-9) and r.apparent == pytest.approx(app, abs=1e-9) and r.zenith == pytest.approx(90 - app, abs=1e-9)
        assert min(abs(r.azimuth - az), 360 - abs(r.azimuth - az)) < 1e-7


def test_hong_kong_morning_noon_afternoon(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 7, h, m),) for h, m in ((1, 0), (4, 30), (7, 0))], "t timestamp_ntz")
    az = [r.azimuth for r in solar.with_sun(df, "t", F.lit(22.34011333), F.lit(114.26332333)).orderBy("t").collect()]
    assert 90 < az[0] < 180 and 170 < az[1] < 200 and 180 < az[2] < 270


@pytest.mark.parametrize(("azimuth", "wanted"), [(113.2, 115), (39.0, 40), (2.0, 0), (358.0, 0), (357.5, 0), (2.5, 5), (-1.0, 0), (362.6, 5)])
def test_direction(spark, azimuth, wanted):
    assert spark.range(1).select(solar.direction(F.lit(azimuth))).first()[0] == wanted


def test_daylight(spark):
    days = spark.createDataFrame([("2026-06-21",), ("2026-12-22",)], "day string").select(F.to_date("day").alias("day"))
    got = {str(r.day): r for r in solar.daylight(days, "day", F.lit(52.37), F.lit(4.9)).collect()}
    for day, r in got.items():
        for t, up in ((r.sunrise, True), (r.sunset, False)):
            at = datetime(1970, 1, 1) + timedelta(seconds=t)
            assert str(at.date()) == day
            assert abs(oracle.sun(at, 52.37, 4.9)[1] - solar.HORIZON) < 1e-4
            later = oracle.sun(at + timedelta(minutes=5), 52.37, 4.9)[1]
            assert (later > solar.HORIZON) == up
    assert got["2026-06-21"].sunset - got["2026-06-21"].sunrise > 16 * 3600


def test_grid_and_back(spark):
    df = spark.createDataFrame([(22.2 + i / 40, 113.9 + j / 20) for i in range(10) for j in range(8)], "lat double, lon double")
    e, n = lattice.to_grid(F.col("lat"), F.col("lon"))
    back = lattice.with_geographic(df.select("lat", "lon", e.alias("e"), n.alias("n")), "e", "n")
    assert back.where((F.abs(F.col("latitude") - F.col("lat")) > 1e-8) | (F.abs(F.col("longitude") - F.col("lon")) > 1e-8)).count() == 0


@pytest.mark.parametrize(("text", "wanted"), [("22.5", 22.5), ("[-3.25]", -3.25), ("22 18 43.68 N", 22 + 18 / 60 + 43.68 / 3600), ("114 10 42.8 West", -(114 + 10 / 60 + 42.8 / 3600)), ("1 60 0", None), ("1 2", None), ("x", None)])
def test_degrees(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(lattice.degrees_of(F.col("t"))).first()[0] == (None if wanted is None else pytest.approx(wanted))


def test_date_groups():
    assert ordered.date_groups([("a", 300), ("b", 212), ("c", 1), ("d", 512)]) == [["a", "b"], ["c"], ["d"]]
    with pytest.raises(ValueError):
        ordered.date_groups([("a", 513)])
