"""Folders of heights to views and publications: refusals, staleness, reuse, and the command line."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunlattice import __main__ as cli
from sunlattice import store
from sunlattice.operators import fill
from sunlattice.plans import publish, region, run
from sunlattice.sources import catalogue, geotiff

EAST, NORTH = 836004.0, 818000.0


@pytest.fixture
def folder(tmp_path):
    """Two tiles of 12 x 10 pixels side by side, one with gaps."""
    to, rng = tmp_path / "tiles", np.random.default_rng(12)
    to.mkdir()
    for k in range(2):
        z = rng.uniform(0, 6, (10, 12)).astype("f4")
        if k:
            z[3:6, 4:9] = -9999
        (to / f"tile{k}.tif").write_bytes(geotiff.encode(z, EAST + 6 * k, NORTH, 0.5, -9999.0, 16, 2326))
    return to


def test_catalogue_rules(spark, folder):
    found = geotiff.inventory(spark, str(folder))
    assert catalogue.admitted(found, epsg=2326).count() == 2
    (folder / "off.tif").write_bytes(geotiff.encode(np.zeros((4, 4), "f4"), EAST + 100.2, NORTH, 0.5, None, 16, 2326))
    (folder / "coarse.tif").write_bytes(geotiff.encode(np.zeros((4, 4), "f4"), EAST + 200, NORTH, 1.0, None, 16, 2326))
    (folder / "over.tif").write_bytes(geotiff.encode(np.zeros((4, 4), "f4"), EAST + 11, NORTH - 2, 0.5, None, 16, 2326))
    (folder / "other.tif").write_bytes(geotiff.encode(np.zeros((4, 4), "f4"), EAST + 300, NORTH, 0.5, None, 16, 4326))
    (folder / "tile0.aux.xml").write_text("<x/>")
    (folder / ".hidden.tif").write_bytes(b"")
    got = {(r["name"], r["problem"]) for r in catalogue.problems(geotiff.inventory(spark, str(folder)), epsg=2326).collect()}
    assert got == {("off.tif", "lattice"), ("coarse.tif", "resolution"), ("over.tif", "overlap"), ("tile1.tif", "overlap"), ("other.tif", "crs")}
    with pytest.raises(catalogue.Refused, match="over.tif: overlap"):
        catalogue.admitted(geotiff.inventory(spark, str(folder)), epsg=2326)
    assert [(r["stem"], len(r["files"])) for r in catalogue.auxiliary(spark, str(folder)).collect()] == [("tile0", 1)]
    near = catalogue.covering(geotiff.inventory(spark, str(folder)), (EAST, NORTH - 1, EAST + 1, NORTH), 0.0)
    assert [r["name"] for r in near.collect()] == ["tile0.tif"]
    with pytest.raises(catalogue.Refused, match="tile0"):
        catalogue.covering(geotiff.inventory(spark, str(folder)), (EAST, NORTH - 1, EAST + 1, NORTH), 0.0, near)


def test_identity_is_of_the_contents(spark, folder, tmp_path):
    first = catalogue.RawSource(spark, str(folder)).identity()
    other = tmp_path / "moved" / "deeper"
    other.mkdir(parents=True)
    for f in folder.iterdir():
        (other / f"x{f.name}").write_bytes(f.read_bytes())
    assert catalogue.RawSource(spark, str(other)).identity() == first
    (other / "xtile0.tif").write_bytes(geotiff.encode(np.ones((10, 12), "f4"), EAST, NORTH, 0.5, -9999.0, 16, 2326))
    assert catalogue.RawSource(spark, str(other)).identity() != first


def test_sheets_with_native_heights_are_refused(spark, folder, tmp_path):
    (folder / "wrong.tif").write_bytes(geotiff.encode(np.full((4, 4), -9999, "f4"), EAST + 50, NORTH, 0.5, 0.0, 16, 2326))
    with pytest.raises(Exception, match="native no-data value"):
        catalogue.ingest(spark, str(folder), None, f"file://{tmp_path}/city", (10, 10), "a")
    assert not (tmp_path / "city" / "current.json").exists()


def test_view_is_stale_after_its_files_change(spark, folder, tmp_path):
    raw, root = catalogue.RawSource(spark, str(folder)), f"file://{tmp_path}/view"
    made = catalogue.build_view(spark, raw, root, "one", fill.Profile(0.5, 9.0, 50.0, 9.0), (10, 12), side=16)
    view = catalogue.FilledSource(spark, root, raw)
    view.check()
    assert sum(made["totals"].values()) == 240 and view.identity() == made["identity"] and view.pixels((EAST, NORTH - 1, EAST + 1, NORTH)).count() == 4
    edge = view.window(round(-NORTH * 2) - 1, round(EAST * 2), 2, 3).collect()
    assert sorted((r["row"] + round(NORTH * 2), r["surface"]) for r in edge) == [(-1, 255)] * 3 + [(0, 0)] * 3
    (folder / "tile0.tif").write_bytes(geotiff.encode(np.ones((10, 12), "f4"), EAST, NORTH, 0.5, -9999.0, 16, 2326))
    with pytest.raises(catalogue.Stale):
        view.check()
    part = next((tmp_path / "view" / "one").glob("tile=*"))
    for f in part.iterdir():
        f.unlink()
    spark.createDataFrame([(round(-NORTH * 2), round(EAST * 2), 9.5, 0)], "row long, col long, z float, surface smallint").write.mode("overwrite").parquet(str(part))
    with pytest.raises(catalogue.Stale):
        view.window(round(-NORTH * 2), round(EAST * 2), 12, 24)


def test_cities(spark):
    cities = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 2.0), ("b", 1.0, 0.0, 4.0, 2.0)], "city string, left double, bottom double, right double, top double")
    assert catalogue.resolve_city([(0.5, 0.5), (1.5, 0.9)], cities) == "a" and catalogue.resolve_city([(0.5, 3.0)], cities) == "b"
    for bad in ([(0.5, 1.5)], [(0.5, 0.5), (0.5, 3.5)], [(9.0, 9.0)]):
        with pytest.raises(catalogue.Refused):
            catalogue.resolve_city(bad, cities)


def test_shade_map_and_command_line(spark, folder, tmp_path, capsys):
    """A publication's layers, rasters and summaries agree; horizons are found again; unfinished ones are pruned."""
    root, cache = f"file://{tmp_path}/out", f"file://{tmp_path}/cache"
    times = [datetime(2024, 1, 1, 4), datetime(2024, 1, 1, 16)]
    request = run.Request(radius_m=4.0, block=16, bin_m=6.0)
    whole = (EAST + 3, NORTH - 4, EAST + 9, NORTH)
    found = publish.shade_map(spark, str(folder), whole, times, root, "one", request, 2326, cache).collect()
    assert {r["frame"]: r["pixels"] for r in found if r["grp"] == "land"} == {1: 96 - 6, 2: 96 - 6} and sum(r["pixels"] for r in found) == 2 * 96
    assert json.loads((tmp_path / "out" / "current.json").read_text())["name"] == "one" and (tmp_path / "out" / "one" / "rasters" / "shade-1.vrt").read_text().count("<SimpleSource>") == 2
    layers = spark.read.parquet(f"{root}/one/layers")
    for f in (tmp_path / "out" / "one" / "rasters").glob("shade-1-*.tif"):
        r = geotiff.decode(f.read_bytes())
        own = {(x["row"], x["col"]): x["shade"] for x in layers.where((F.col("frame") == 1) & (F.col("tile") == f.name.removeprefix("shade-1-").removesuffix(".tif") + ".tif") | (F.col("tile") == f.name.removeprefix("shade-1-"))).where("frame = 1").collect()}
        at = round(-r.top * 2), round(r.left * 2)
        assert own and all(r.data[row - at[0], col - at[1]] == v for (row, col), v in own.items())
    have = {(r["tile"], r["direction"]) for r in store.HorizonStore(spark, cache).have().collect()}
    assert {t for t, _ in have} == {"tile0.tif", "tile1.tif"} and len(have) == 2
    (tmp_path / "out" / "half" / "layers").mkdir(parents=True)
    (tmp_path / "out" / "mine").mkdir()
    assert publish.prune(spark, root) == ["half"] and (tmp_path / "out" / "mine").exists()
    assert cli.main(["check", str(folder)], spark) == 0
    assert cli.main(["plan", str(folder), *map(str, whole), "2024-01-01T04:00"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"frames": 1, "tiles": 2, "directions": 2, "missing": 2}
    assert cli.main(["build", str(folder), "--to", f"file://{tmp_path}/v", "--name", "n", "--profile", "0.5", "9", "50", "9", "--tile", "10", "12"], spark) == 0
    (folder / "bad.tif").write_bytes(b"II*\0 no")
    assert cli.main(["check", str(folder)], spark) == 1


def test_many_directions_lose_none(spark):
    """The Sun's own azimuths as directions: more than any list of bins, each joined."""
    rng = np.random.default_rng(1)
    px = spark.createDataFrame([(r, c, float(z), "t") for (r, c), z in np.ndenumerate(rng.uniform(0, 3, (3, 3)))], "row long, col long, z float, tile string")
    sites = spark.createDataFrame([("t", 0.0, -1.5, 1.5, 0.0, 22.3, 114.2)], "tile string, left double, bottom double, right double, top double, latitude double, longitude double")
    times = spark.sql("SELECT CAST(row_number() OVER (ORDER BY utc) AS INT) AS frame, utc FROM (SELECT explode(sequence(timestamp_ntz '2024-01-01 00:00:00', timestamp_ntz '2024-01-02 23:59:00', interval 1 minute)) AS utc)")
    block = run.run(px, sites, times, run.Request(1.0, "direct", 8, bin_m=2.0))
    join = run.run(px, sites, times, run.Request(1.0, "direct", 0, bin_m=2.0))
    assert run.plan(times, sites, run.Request(1.0, "direct")).counts["directions"] > 1200
    assert block.count() == 9 * 2880 and block.exceptAll(join.select(block.columns)).isEmpty()


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        def get(self, key, default=None):
            return default

    class Context:
        applicationId = "no-such-application"

        def __init__(self, master):
            self.master = master

        def getConf(self):
            return Unset()

    class Session:
        conf = Unset()

        def __init__(self, master):
            self.sparkContext = Context(master)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.folder(Session("spark://host:7077"))
    assert store.folder(Session("local[2]")).startswith("file://")


def test_a_lost_run_goes_on(spark, folder, tmp_path, monkeypatch, capsys):
    """Groups of frames that are finished are kept as they are; the rest is added; the whole equals a publication at once."""
    times = [datetime(2024, 1, 1, h) for h in (3, 4, 5, 16)]
    whole, request = (EAST + 3, NORTH - 4, EAST + 9, NORTH), run.Request(radius_m=4.0, block=16, bin_m=6.0)
    args = (spark, str(folder), whole, times)
    root = f"file://{tmp_path}/out"
    real, calls = publish.labels, []

    def lost_at_the_second(source, rectangle, part, *rest):
        calls.append(sorted(r["frame"] for r in part.collect()))
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(source, rectangle, part, *rest)

    monkeypatch.setattr(publish, "labels", lost_at_the_second)
    with pytest.raises(RuntimeError, match="lost"):
        publish.shade_map(*args, root, "one", request, rasters=False, at_once=2)
    assert publish.finished_frames(spark, root, "one") == {1, 2} and not (tmp_path / "out" / "current.json").exists()
    assert cli.main(["status", root, "--name", "one"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"frames": [1, 2], "finished": False}
    written = {f: f.stat().st_mtime_ns for n in (1, 2) for f in (tmp_path / "out" / "one" / "layers" / f"frame={n}").glob("part-*")}
    resumed = publish.shade_map(*args, root, "one", request, rasters=False, at_once=2)
    assert calls == [[1, 2], [3, 4], [3, 4]] and all(f.stat().st_mtime_ns == t for f, t in written.items())
    monkeypatch.setattr(publish, "labels", real)
    at_once = publish.shade_map(*args, root, "two", request, rasters=False)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(resumed) == rows(at_once)
    assert rows(spark.read.parquet(f"{root}/one/layers")) == rows(spark.read.parquet(f"{root}/two/layers"))
    assert cli.main(["status", root, "--name", "one"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"frames": [1, 2, 3, 4], "finished": True}


def test_kept_horizons_that_are_damaged_are_made_again(spark, folder, tmp_path):
    times = publish.instants(spark, [datetime(2024, 1, 1, 4), datetime(2024, 1, 1, 7)])
    raw, request = catalogue.RawSource(spark, str(folder)), run.Request(radius_m=4.0, block=16, bin_m=6.0)
    px, sites = store.cut(raw.pixels()), publish.sites(raw.catalogue())
    kept = store.HorizonStore(spark, f"file://{tmp_path}/cache")
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert kept.problems(px, 4.0).isEmpty()
    want = rows(run.run(px, sites, times, request, kept))
    assert kept.problems(px, 4.0).isEmpty()
    files = sorted((tmp_path / "cache").rglob("part-*.parquet"))
    files[0].write_bytes(files[0].read_bytes()[:40])
    (files[0].parent / f".{files[0].name}.crc").unlink()
    assert [r["problem"] for r in kept.problems(px, 4.0).collect()] == ["rows"]
    assert rows(run.run(px, sites, times, request, kept, check=True)) == want and kept.problems(px, 4.0).isEmpty()


def test_region_requests(spark, folder, tmp_path, capsys):
    asked = region.requests((0, 0, 40, 20), [(0, 0, 10, 10), (30, 10, 40, 20)], (0, 0), (10, 10), 300, [("2024-01-01", 40), ("2024-01-02", 50), ("2024-01-03", 30)], 90)
    assert [r["number"] for r in asked["runs"]] == list(range(1, len(asked["runs"]) + 1)) and {tuple(r["days"]) for r in asked["runs"]} == {("2024-01-01", "2024-01-02"), ("2024-01-03",)}
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    assert asked["pixels"] + sum(map(area, asked["gaps"])) == 800 and all(area(r["rectangle"]) <= 300 for r in asked["runs"])
    first, again = (region.write_requests(spark, asked, f"file://{tmp_path}/r") for _ in range(2))
    assert first == again and json.loads(store.read_text(spark, first)) == asked
    assert cli.main(["region", str(folder), str(EAST), str(NORTH - 5), str(EAST + 12), str(NORTH), "2024-01-01", "2024-01-02", "--frames", "300", "--to", f"file://{tmp_path}/r"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["runs"] >= 2
    assert cli.main(["ingest", str(folder), "--to", f"file://{tmp_path}/city", "--name", "a", "--tile", "10", "12"], spark) == 0


def test_batches(spark):
    boxes = spark.createDataFrame([("a", 0.0, -2.0, 2.0, 0.0), ("b", 1.0, -2.0, 3.0, 0.0), ("c", 9.0, -2.0, 11.0, 0.0)], "tile string, left double, bottom double, right double, top double")
    at = lambda tile, cols, z: [(tile, r, c, z) for r in range(4) for c in cols]
    layers = lambda rows: spark.createDataFrame(rows, "tile string, row long, col long, z double")
    same = at("a", range(4), 1.0) + at("b", range(2, 6), 1.0)
    assert catalogue.batch_window(boxes, layers(same), (0.0, -2.0, 3.0, 0.0), [], ["z"]).count() == 24
    with pytest.raises(catalogue.Refused, match="contradict"):
        catalogue.batch_window(boxes, layers(at("a", range(4), 1.0) + at("b", range(2, 6), 2.0)), (0.0, -2.0, 3.0, 0.0), [], ["z"])
    with pytest.raises(catalogue.Refused, match="'b'"):
        catalogue.batch_window(boxes, layers(at("a", range(4), 1.0)), (0.0, -2.0, 3.0, 0.0), [], ["z"])


def test_views_of_results(spark):
    index = spark.createDataFrame([("1", json.dumps({"a": ["/x/v1/tiles/t.tif", {"b": '/x/"q"/tiles'}], "c": "/x/v2"})), ("2", "{}"), ("3", None)], "result string, index string")
    views = spark.createDataFrame([("/x/v1",), ("/x/v2",)], "view string")
    assert [tuple(r) for r in catalogue.views_of(index, views).collect()] == [("1", "/x/v1")]
