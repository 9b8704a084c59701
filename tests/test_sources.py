from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sunlattice.operators import tasks
from sunlattice import store
from sunlattice.plans import region, run
from sunlattice.sources import config, geotiff
from sunlattice.streaming import log
from tests import oracle


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.sampled_from(["u1", "i2", "f4", "f8"]), st.integers(16, 64).map(lambda n: n // 16 * 16))
def test_tiff_round_trip(height, width, kind, tile):
    data = (np.arange(height * width).reshape(height, width) % 251).astype(kind)
    r = geotiff.decode(geotiff.encode(data, 800000.0, 820000.0, 0.5, 255.0, tile))
    assert (r.data == data).all() and r.bounds == (800000.0, 820000.0 - height / 2, 800000.0 + width / 2, 820000.0) and r.nodata == 255


def test_tiff_refusals():
    raw = geotiff.encode(np.zeros((2, 2), "u1"), 0, 0, 0.5)
    for bad in (b"PK" + raw[2:], raw[:2] + b"\x2b\0" + raw[4:]):
        with pytest.raises(geotiff.Unsupported):
            geotiff.decode(bad)


def test_tiff_tables(spark, tmp_path):
    a = np.arange(12, dtype="f4").reshape(3, 4)
    a[0, 0], a[0, 1] = -9999, np.nan
    (tmp_path / "one.tif").write_bytes(geotiff.encode(a, 800000.0, 820000.0, 0.5, -9999.0, 16))
    (tmp_path / "bad.tif").write_bytes(b"II*\0 no")
    inv = {r.name: r for r in geotiff.inventory(spark, str(tmp_path)).collect()}
    assert inv["one.tif"].problem is None and inv["one.tif"].right == 800002.0 and inv["bad.tif"].problem
    assert geotiff.files(spark, str(tmp_path)).count() == 2
    px = geotiff.pixels(spark, str(tmp_path / "one.tif"))
    assert px.where("z is null").count() == 2 and px.agg(F.min("row"), F.max("col")).first()[:] == (-1640000, 1600003)
    back = geotiff.decode(geotiff.encoded(px, "z", "f4", -9999.0).first().content)
    assert (back.data == np.where(np.isnan(a), -9999, a)).all()


def test_strict_json():
    for text in ('{"a": 1, "a": 2}', "[NaN]", "[1e999x]", "{"):
        with pytest.raises(config.Invalid):
            config.loads(text)
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 9}, "b": {"type": "array", "items": {"enum": ["x", "y"]}, "uniqueItems": True, "minItems": 1}, "c": {"oneOf": [{"type": "null"}, {"type": "string", "pattern": "^z"}]}, "d": {"type": "number", "default": 2.5}}}
    assert config.problems({"a": 3, "b": ["x"], "c": None}, schema) == []
    for bad in ({}, {"a": 0}, {"a": True}, {"a": 1, "b": []}, {"a": 1, "b": ["x", "x"]}, {"a": 1, "b": ["q"]}, {"a": 1, "c": "no"}, {"a": 1, "e": 1}):
        assert config.problems(bad, schema), bad
    assert config.problems("xzz", {"pattern": "z+"}) and not config.problems("zz", {"pattern": "z+"})
    linked = {"$defs": {"n/a": {"type": "integer"}}, "properties": {"k": {"$ref": "#/$defs/n~1a", "minimum": 5}}, "additionalProperties": {"type": ["string", "null"], "maxLength": 2}}
    assert not config.problems({"k": 7, "other": "ab", "none": None}, linked)
    assert [len(config.problems(v, linked)) for v in ({"k": 3}, {"k": "x"}, {"other": "abc"}, {"other": 1})] == [1, 1, 1, 1]
    with pytest.raises(config.Invalid):
        config.problems(1, {"minimun": 3})
    assert config.with_defaults({"a": 1}, schema) == {"a": 1, "d": 2.5} and config.canonical({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}' and config.sanitised([float("nan")]) == ["NaN"]


def test_local_instants():
    zone = ZoneInfo("America/New_York")
    for text in ("2026-11-01T01:30", "2026-03-08T02:30", "2026-07-01T12:00:00+01:00"):
        with pytest.raises(ValueError):
            region.instant(text, zone)
    assert region.instant("2026-07-01T12:00:00-04:00", zone) == datetime(2026, 7, 1, 16, tzinfo=UTC)
    assert len(region.days({"from": "2024-02-28", "to": "2024-03-01"})) == 3


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kathmandu", "Europe/Lisbon"])
def test_wall_samples(spark, zone):
    """Against all minutes of three days around a change of clocks, looked at one by one."""
    for start in (datetime(2026, 10, 24, 20, 13, 7, tzinfo=UTC), datetime(2026, 10, 31, 20, 0, tzinfo=UTC), datetime(2026, 3, 7, 22, 59, 59, 1, tzinfo=UTC)):
        for minutes in (7, 30, 60):
            last, wanted, t = start + timedelta(days=2, seconds=3), [], start.replace(second=0, microsecond=0)
            while t <= last:
                wall = t.astimezone(ZoneInfo(zone))
                if t >= start and (wall.hour * 60 + wall.minute) % minutes == 0:
                    wanted.append(t.replace(tzinfo=None))
                t += timedelta(minutes=1)
            assert sorted(r.utc for r in region.wall_samples(spark, start, last, zone, minutes).collect()) == wanted
    assert region.wall_samples(spark, start, start - timedelta(days=1), zone, 5).isEmpty()


def brute_partition(rect, tiles, step, limit):
    """The least worth of all cuts from edge to edge, by trying each."""
    touches = lambda r: any(t[0] < r[2] and r[0] < t[2] and t[1] < r[3] and r[1] < t[3] for t in tiles)
    known = {}

    def least(r):
        if r not in known:
            known[r] = _least(r)
        return known[r]

    def _least(r):
        area = (r[2] - r[0]) * (r[3] - r[1])
        if not touches(r):
            return area, 0, 0
        if area <= limit:
            return 0, 1, r[2] - r[0] + r[3] - r[1]
        ways = [((r[0], r[1], k, r[3]), (k, r[1], r[2], r[3])) for k in range(r[0] + 1, r[2]) if k % step == 0] + [((r[0], r[1], r[2], k), (r[0], k, r[2], r[3])) for k in range(r[1] + 1, r[3]) if k % step == 0]
        return min((tuple(map(sum, zip(least(p), least(q), strict=True))) for p, q in ways), default=(10**9, 0, 0))

    return least(rect)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 7), st.integers(0, 7), st.integers(9, 20), st.integers(9, 20), st.sets(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1), st.integers(16, 80))
def test_partition_is_the_best(left, bottom, right, top, cells, limit):
    tiles = [(4 * x, 4 * y, 4 * x + 4, 4 * y + 4) for x, y in cells]
    rect = (left, bottom, right, top)
    assert region._worth(*region.partition(rect, tiles, (0, 0), (4, 4), limit)) == brute_partition(rect, tiles, 4, limit)


def test_partition_of_a_large_lattice():
    rng = np.random.default_rng(6)
    for _ in range(5):
        cells = np.argwhere(rng.random((40, 30)) < 0.4)
        tiles = [(10 * x, 10 * y, 10 * x + 10, 10 * y + 10) for x, y in cells.tolist()]
        parts, gaps = region.partition((3, 5, 397, 291), tiles, (0, 0), (10, 10), 1700)
        seen = np.zeros((400, 300), int)
        for a, b, c, d in parts + gaps:
            seen[a:c, b:d] += 1
        full = np.zeros((400, 300), bool)
        for a, b, c, d in tiles:
            full[a:c, b:d] = True
        assert seen[3:397, 5:291].min() == seen.max() == 1 and seen.sum() == 394 * 286
        assert all((c - a) * (d - b) <= 1700 and full[a:c, b:d].any() for a, b, c, d in parts) and not any(full[a:c, b:d].any() for a, b, c, d in gaps)
        assert len(parts) <= 2 * 394 * 286 / 1700 + 40
    with pytest.raises(ValueError, match="more than 99"):
        region.partition((0, 0, 400, 300), [(0, 0, 400, 300)], (0, 0), (10, 10), 99)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 7), st.integers(0, 7), st.integers(9, 20), st.integers(9, 20), st.sets(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1), st.integers(16, 80))
def test_partition_is_exact(left, bottom, right, top, cells, limit):
    tiles = [(4 * x, 4 * y, 4 * x + 4, 4 * y + 4) for x, y in cells]
    parts, gaps = region.partition((left, bottom, right, top), tiles, (0, 0), (4, 4), limit)
    seen = np.zeros((24, 24), int)
    for a, b, c, d in parts + gaps:
        seen[b:d, a:c] += 1
    wanted = np.zeros_like(seen)
    wanted[bottom:top, left:right] = 1
    assert (seen == wanted).all()
    assert all((c - a) * (d - b) <= limit for a, b, c, d in parts)
    assert not any(t[0] < c and a < t[2] and t[1] < d and b < t[3] for a, b, c, d in gaps for t in tiles)


def test_run_reuses_horizons_and_publishes(spark, tmp_path):
    rng = np.random.default_rng(3)
    z = rng.uniform(0, 4, (8, 16)).astype(np.float32)
    z[0, 0] = np.nan
    px = oracle.pixels(spark, z).withColumn("tile", F.when(F.col("col") < 8, "a").otherwise("b"))
    sites = spark.createDataFrame([("a", 0.0, -4.0, 4.0, 0.0, 22.3, 114.2), ("b", 4.0, -4.0, 8.0, 0.0, 22.3, 114.2)], "tile string, left double, bottom double, right double, top double, latitude double, longitude double")
    times = spark.createDataFrame([(1, datetime(2024, 1, 1, 1)), (2, datetime(2024, 1, 1, 4)), (3, datetime(2024, 1, 1, 16))], "frame int, utc timestamp_ntz")
    request = run.Request(radius_m=2.0, block=8, bin_m=4.0)
    kept = store.HorizonStore(spark, str(tmp_path / "horizons"))
    first = run.run(px, sites, times, request, kept)
    assert run.plan(times, sites, request, kept.have()).counts["missing"] == 0
    again = run.run(px, sites, times, request, kept)
    joined = run.run(px, sites, times, run.Request(radius_m=2.0, block=0, bin_m=4.0))
    assert tasks.same_rows(first, again) and tasks.same_rows(first, joined.select(first.columns))
    night = first.where("frame = 3").select("quality").distinct().collect()
    assert {r.quality for r in night} == {1, 4}
    surface = px.select("row", "col", F.when(F.col("z").isNull(), 4).otherwise(0).cast("smallint").alias("surface"))
    counts = run.publish(spark, first, surface, f"file://{tmp_path}/out", "one")
    assert counts.agg(F.sum("pixels")).first()[0] == 3 * 128 and (tmp_path / "out/current.json").read_text() == '{"name": "one"}'
    shares = run.summary(counts, times).collect()
    assert all(s.shaded_low <= s.shaded_high and s.pixels == s.sunlit + s.shaded + s.uncertain for s in shares)


def test_streamed_log(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i // 6, i % 6 * 10), "queued" if i % 3 else "failed") for i in range(18)]
    schema = "event_id long, at timestamp, state string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "log"))
    counts = log.state_counts(log.read(spark, str(tmp_path / "log"), schema))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("log_counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.start.hour, r.state): r.n for r in spark.sql("select * from log_counts").collect()} == {(h, s): n for h in range(3) for s, n in (("queued", 4), ("failed", 2))}
    live = log.once(log.read(spark, str(tmp_path / "log"), schema), "event_id")
    assert live.isStreaming and log.sessions(log.read(spark, str(tmp_path / "log"), schema), "state").isStreaming
