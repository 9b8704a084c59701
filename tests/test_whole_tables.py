"""Queries whose SQL takes a part of a table only: against brute force over the whole of a small one."""

import datetime
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sunlattice.functions import solar
from sunlattice.plans import catalog, oracles, scene
from tests import oracle

HOURS = [datetime.datetime(2024, 1, d, h) for d, h in ((1, 4), (1, 23), (2, 3), (2, 12), (15, 0), (15, 3), (30, 4), (30, 23))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, {(row, col): z}): events in eight hours of four days, and order lines that make a few pixels."""
    to, rng = str(tmp_path_factory.mktemp("tables")), random.Random(5)
    at = [(i, str(h + datetime.timedelta(minutes=m))) for i, (h, m) in enumerate((h, m) for h in HOURS for m in (0, 25))]
    spark.createDataFrame(at, "event_id long, ts string").selectExpr("event_id", "cast(ts as timestamp) as ts").write.parquet(f"{to}/events.parquet")
    lines = [(rng.randrange(12), rng.randrange(20), float(rng.randrange(1, 51)), rng.randrange(1, 8)) for _ in range(300)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int").write.parquet(f"{to}/lineitem.parquet")
    cells = {}
    for r, c, q, n in lines:
        a, b = cells.get((r, c), (0, 0))
        cells[r, c] = a + q, b + n
    return to, {k: np.float32(int(q) % 97 / 4.0) if n % 11 else None for k, (q, n) in cells.items()}


def suns():
    """{(frame, tile): (azimuth, apparent)} of all 15 tiles."""
    out = {}
    for frame, t in enumerate(HOURS, 1):
        for i in range(15):
            az, _, apparent = oracle.sun(t, scene.LATITUDE - i // 4 * 0.25, scene.LONGITUDE + i % 4 * 0.25)
            out[frame, f"t{i // 4}_{i % 4}"] = math.floor((az + 2.5) / 5) * 5 % 360, apparent
    return out


def test_frames_are_the_hours_of_all_events(spark, tables):
    to, _ = tables
    numbered = dict(enumerate(HOURS, 1))
    assert {r["frame"]: r["utc"] for r in scene.frames(spark, to).collect()} == numbered
    sun = suns()
    assert {(r["frame"], r["up"]) for r in catalog.j9_frames_tiles(spark, to).collect()} == {(f, sum(a > 0 for (g, _), (_, a) in sun.items() if g == f)) for f in numbered}
    assert {tuple(r) for r in catalog.a26_distinct_directions(spark, to).collect()} == {(t, d) for (_, t), (d, a) in sun.items() if a > 0}
    assert sorted(map(tuple, catalog.w11_neighbour_frames(spark, to).collect())) == [(1, None, 2), (2, 1, None), (3, None, 4), (4, 3, None), (5, None, 6), (6, 5, None), (7, None, 8), (8, 7, None)]
    assert {(r["frame"], r["day"], r["hhmm"]) for r in catalog.f17_names(spark, to).collect()} == {(f, t.strftime("%Y%m%d"), t.strftime("%H%M")) for f, t in numbered.items()}
    assert {tuple(r) for r in catalog.p10_time_filter(spark, to).collect()} == {("0300", 3), ("0300", 6), ("1200", 4), ("1215", None)}
    assert {(r["day"], r["frames"]) for r in catalog.a15_daily_means(spark, to).collect()} == {(f"2024-01-{d:02}", 2) for d in (1, 2, 15, 30)}


def test_every_frame_is_labelled(spark, tables):
    to, cells = tables
    z = np.full((64, 64), np.nan)
    for (r, c), v in cells.items():
        z[r, c] = np.nan if v is None else v
    name = lambda r, c: f"t{r // 16}_{c // 16}"
    threshold = {}
    for tile in {name(*k) for k in cells}:
        ty, tx = int(tile[1]), int(tile[3])
        near = [v for (r, c), v in cells.items() if v is not None and tx * 8 - 10 < (c + 0.5) / 2 < tx * 8 + 18 and ty * 8 - 10 < (r + 0.5) / 2 < ty * 8 + 18]
        low = min(v for k, v in cells.items() if v is not None and name(*k) == tile)
        threshold[tile] = math.degrees(math.atan(max(0.0, float(max(near)) - float(low)) / 10.0))
    want = set()
    for (frame, tile), (direction, apparent) in suns().items():
        for (r, c), v in cells.items():
            if name(r, c) == tile:
                slope, support, _ = oracle.ray(z, r, c, direction, 10.0) if v is not None and apparent > 0 else (0, False, 0)
                want.add((frame, tile, r, c, *oracle.label(v, math.degrees(math.atan(slope)), support, apparent, threshold[tile])))
    found = catalog.f8_classify(spark, to)
    assert sorted(tuple(r) for r in found.select("frame", "tile", "row", "col", "shade", "quality").collect()) == sorted(want)
    counted = {(r["frame"], r["shade"], r["quality"]): r["pixels"] for r in catalog.a6_contingency(spark, to).groupBy("frame", "shade", "quality").sum("pixels").withColumnRenamed("sum(pixels)", "pixels").collect()}
    assert counted == {k: sum((f, s, q) == k for f, _, _, _, s, q in want) for k in counted} and sum(counted.values()) == len(want)


def test_every_order_is_joined(spark, tables, tmp_path):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=7 * i) for i in range(30)]
    spark.read.parquet(f"{tables[0]}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(list(enumerate(days)), "o_orderkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    want = {k: sum(2 for h in HOURS if 0 <= h.day - d.timetuple().tm_yday % 30 <= 6) for k, d in enumerate(days)}
    assert {r["o_orderkey"]: r["events"] for r in catalog.j29_interval_join(spark, str(tmp_path)).collect()} == {k: n for k, n in want.items() if n}


def test_daylight_to_the_microsecond(spark, tmp_path):
    """Events a microsecond inside and outside of each day's sunrise and sunset, and one without an instant.

    Those from 1970 on against the query's SQL too: its remainder of an instant's seconds is negative before."""
    days = [datetime.date(1969, 7, 20), datetime.date(2024, 1, 1), datetime.date(2024, 6, 21)]
    bounds = solar.daylight(spark.createDataFrame([(d,) for d in days], "day date"), "day", F.lit(scene.LATITUDE), F.lit(0.0)).collect()
    at, want = [(0, None)], {0: False}
    for r in bounds:
        rise, fall = math.ceil(r.sunrise * 1e6), math.floor(r.sunset * 1e6)
        assert len({t // 1000000 for t in (rise - 1, rise)}) == 1 and len({t // 1000000 for t in (fall, fall + 1)}) == 1  # whole seconds can't tell them apart
        for t, kept in ((rise - 1, False), (rise, True), (fall, True), (fall + 1, False)):
            want[len(at)] = kept
            at.append((len(at), datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=t)))
    spark.createDataFrame(at, "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.p9_daylight_filter(spark, str(tmp_path)).collect()
    assert len(bounds) == len(days) and {r["event_id"]: r["kept"] for r in found} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' WHERE ts IS NULL OR ts >= TIMESTAMP '1970-01-01'")
    later = {i for i, t in at if t is None or t.year >= 1970}
    assert sorted(tuple(r) for r in found if r["event_id"] in later) == sorted(con.execute(oracles.oracle_sql()["p9_daylight_filter"]).fetchall())
