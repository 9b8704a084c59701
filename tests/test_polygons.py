"""Features, clipping, turned strips and mapped coasts on small made cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunlattice.functions import lattice
from sunlattice.operators import fill, strips, tiles
from sunlattice.sources import vector


def feature(i, kind, coordinates, **properties):
    return json.dumps({"type": "Feature", "id": str(i), "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}})


SQUARE = [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]]  # clockwise
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2]]  # counterclockwise and open


def test_features_of_lines_and_of_collections(spark, tmp_path):
    written = [feature(1, "Polygon", [SQUARE, HOLE], code="a", n=3), feature(2, "MultiPolygon", [[SQUARE], [[[9, 9], [10, 9], [10, 10]]]], code="b"), feature(3, "Point", [1, 2], code="c"), feature(4, "Polygon", [[[0, 0], [1, 1]]], code="d"), '{"type": "Feature", "id": "5", "properties": null, "geometry": null}']
    (tmp_path / "lines.json").write_text("\n".join(written))
    (tmp_path / "whole.json").write_text('{"type": "FeatureCollection",\n"features": [' + ",\n".join(written) + "]}")
    for name, lines in (("lines.json", True), ("whole.json", False)):
        found = vector.features(spark, str(tmp_path / name), lines)
        assert {r["id"]: r["properties"] for r in found.collect()} == {"1": {"code": "a", "n": "3"}, "2": {"code": "b"}, "3": {"code": "c"}, "4": {"code": "d"}, "5": None}
        e = vector.edges(found, "id")
        assert {r["id"]: r["area"] for r in vector.areas(e, "id").collect()} == {"1": 15.0, "2": 16.5}
        assert {(r["id"], r["part"], r["ring"]): r["count"] for r in e.groupBy("id", "part", "ring").count().collect()} == {("1", 0, 0): 4, ("1", 0, 1): 4, ("2", 0, 0): 4, ("2", 1, 0): 3}


def test_what_is_not_json_raises(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"type": "Feature", "id": ')
    with pytest.raises(Exception):
        vector.features(spark, str(tmp_path / "bad.json")).collect()


def test_an_empty_folder_of_features(spark, tmp_path):
    (tmp_path / "none.json").write_text("")
    e = vector.edges(vector.features(spark, str(tmp_path)), "id")
    assert e.count() == 0 and tiles.clipped_areas(e.withColumnRenamed("id", "polygon"), 1.0).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_clipped_areas_are_counted_areas(spark, seed):
    """Against the share of a fine lattice of places of each cell that lie inside, and in sum exactly."""
    rng = random.Random(seed)
    n = 9
    ring = [(10 * math.cos(2 * math.pi * i / n) * rng.uniform(0.3, 1), 10 * math.sin(2 * math.pi * i / n) * rng.uniform(0.3, 1)) for i in range(n)]
    edges = [("p", *a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    got = {(r["x"], r["y"]): r["area"] for r in tiles.clipped_areas(spark.createDataFrame(edges, "polygon string, x1 double, y1 double, x2 double, y2 double"), 3.0).collect()}
    assert sum(got.values()) == pytest.approx(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2)
    fine = 120
    at = (np.arange(fine) + 0.5) * 3.0 / fine
    for cx in range(-4, 4):
        for cy in range(-4, 4):
            x, y = np.meshgrid(cx * 3 + at, cy * 3 + at)
            odd = np.zeros(x.shape, bool)
            for _, x1, y1, x2, y2 in edges:
                odd ^= ((y1 <= y) != (y2 <= y)) & (x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x)
            assert got.get((cx, cy), 0.0) == pytest.approx(odd.mean() * 9, abs=0.12)


def test_cells_in_the_middle_of_a_large_polygon(spark):
    edges = [("p", 0.0, 0.0, 20.0, 0.0), ("p", 20.0, 0.0, 20.0, 20.0), ("p", 20.0, 20.0, 0.0, 20.0), ("p", 0.0, 20.0, 0.0, 0.0)]
    got = tiles.clipped_areas(spark.createDataFrame(edges, "polygon string, x1 double, y1 double, x2 double, y2 double"), 3.0)
    assert {(r["x"], r["y"]): round(r["area"], 9) for r in got.collect()} == {(x, y): min(3, 20 - 3 * x) * min(3, 20 - 3 * y) for x in range(7) for y in range(7)}


def test_a_strip_is_scanned_cell_by_cell(spark):
    rng = np.random.default_rng(4)
    z = np.where(rng.random((20, 3)) < 0.2, np.nan, rng.integers(0, 6, (20, 3)).astype(float))
    rows = [(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(20) for j in range(3)]
    got = {(r["i"], r["j"]): (r["slope"], r["support"], r["blocker"]) for r in strips.scanned(spark.createDataFrame(rows, "i long, j long, z float"), 2.0, 3.5).collect()}
    want = {}
    for i, j, h in rows:
        if h is None:
            continue
        before = [(i - k, z[k, j]) for k in range(max(0, i - 7), i)]
        best = max([0.0] + [(v - h) / (d * 0.5) for d, v in before if not np.isnan(v)])
        far = max([0.0] + [d * 0.5 for d, v in before if best > 0 and (v - h) / (d * 0.5) == best])
        want[i, j] = (best, i >= 4 and not any(np.isnan(v) for d, v in before if d <= 4), far)
    assert got == want


def test_an_unturned_strip_is_the_scene(spark):
    px = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "row long, col long, z float")
    got = strips.turned(px, 0.0, (1.5, 1.5), (-1.0, 1.5), (-1.0, 1.0))
    assert {(r["i"], r["j"]): r["z"] for r in got.collect()} == {(i, j): None if i > 3 else float(10 * i + j) for i in range(5) for j in range(4)}


def test_edges_of_tiles_and_of_pixels(spark):
    places = spark.createDataFrame([(1, 0.0, 8.0), (2, 0.0, 0.0), (3, 8.0, 8.0), (4, 7.9, 0.1), (5, None, 1.0)], "k int, x double, y double")
    one = spark.createDataFrame([("t", 0.0, 0.0, 8.0, 8.0)], "tile string, left double, bottom double, right double, top double")
    assert {r["k"]: r["tile"] for r in tiles.of_points(places, one, 8.0).collect()} == {1: "t", 2: None, 3: None, 4: "t", 5: None}
    hit = places.select("k", lattice.hit((0.0, 0.0, 8.0, 8.0), F.col("x"), F.col("y")).alias("h")).where("h is not null")
    assert {r["k"]: tuple(r["h"]) for r in hit.collect()} == {2: (16, 0), 4: (15, 15)}


def test_shores_without_heights_are_not_accepted(spark):
    got = fill.shore_gate(spark.createDataFrame([], "z float"), 1.0, 2.0).first()
    assert (got["n"], got["p50"], got["accepted"]) == (0, None, False)
    got = fill.shore_gate(spark.createDataFrame([(1.0,), (2.0,)], "z float"), 1.0, 2.0).first()
    assert (got["n"], got["p50"], got["accepted"]) == (2, 1.5, True)
