import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunlattice.functions import codes
from sunlattice.operators import rays
from tests import oracle

AZIMUTHS = [0.0, 37.0, 45.0, 90.0, 133.7, 180.0, 270.0, 311.2]


def scene():
    rng = np.random.default_rng(27)
    z = rng.uniform(0, 30, (21, 23)).astype(np.float32)
    z[6:8, 11:13] = np.nan
    return z


@pytest.mark.parametrize("origin", [(0, 0), (-13, 17), (-101, 203)])
def test_both_forms_are_the_oracle(spark, origin):
    z = scene()
    px = oracle.pixels(spark, z, *origin)
    offs = rays.offsets(spark, AZIMUTHS, 4.0)
    assert offs.exceptAll(rays.offsets_of(spark.createDataFrame([(a,) for a in AZIMUTHS], "direction double"), 4.0).select(offs.columns)).isEmpty()
    join = {(r.row, r.col, r.direction): r for r in rays.horizons(px, px, offs).collect()}
    block = {(r.row, r.col, r.direction): r for r in rays.block_horizons(px, AZIMUTHS, 4.0, side=10).collect()}
    assert len(join) == len(block) == int((~np.isnan(z)).sum()) * len(AZIMUTHS)
    for (row, col, a), r in join.items():
        slope, support, blocker = oracle.ray(z, row - origin[0], col - origin[1], a, 4.0, origin)
        for x in (r, block[row, col, a]):
            assert x.slope == slope and bool(x.support) == support and x.blocker == blocker
        assert r.horizon == pytest.approx(math.degrees(math.atan(slope)), abs=1e-4)


def test_one_blocker(spark):
    z = np.zeros((40, 40), np.float32)
    z[20, 24] = 20
    px = oracle.pixels(spark, z)
    r = rays.horizons(px.where("row = 20 and col = 20"), px, rays.offsets(spark, [90.0], 5.0)).first()
    assert r.horizon == pytest.approx(math.degrees(math.atan(20 / 1.75)), abs=1e-4) and r.blocker == 1.75


def test_cut_off_distance(spark):
    z = np.zeros((30, 30), np.float32)
    z[10, 14], z[10, 15] = 30, 300
    px = oracle.pixels(spark, z)
    r = rays.horizons(px.where("row = 10 and col = 10"), px, rays.offsets(spark, [90.0], 2.0)).first()
    assert r.slope == pytest.approx(30 / 1.75)


def test_results_do_not_depend_on_partitions(spark):
    px = oracle.pixels(spark, scene())
    offs = rays.offsets(spark, [45.0], 3.0)
    a = rays.horizons(px, px, offs)
    b = rays.horizons(px.repartition(7, "col"), px.repartition(3), offs, broadcast=False)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_empty_scene(spark):
    px = oracle.pixels(spark, np.full((2, 2), np.nan, np.float32))
    assert rays.horizons(px, px, rays.offsets(spark, [0.0], 2.0)).isEmpty() and rays.block_horizons(px, [0.0], 2.0, 8).isEmpty()


def test_classifier(spark):
    rows = [(z, h, s, e) for z in (1.0, None) for h in (45.0, 0.0, 10.0) for s in (0, 1) for e in (-1.0, 0.0, 10.0, 10.0002, 44.9998, 45.0, 45.0002)]
    df = spark.createDataFrame(rows, "z float, h float, s smallint, e double")
    args = [F.col(c) for c in ("z", "h", "s", "e")] + [F.lit(10.0)]
    for r in df.withColumns({"shade": codes.shade(*args), "q": codes.quality(*args)}).collect():
        assert (r.shade, r.q) == oracle.label(r.z, r.h, r.s, r.e, 10.0)
