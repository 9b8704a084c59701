import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sunlattice.operators import fill, impact, quantiles
from tests import oracle


def surface(spark, z, profile, supplied=None, resolution=1.0, side=4):
    h, w = z.shape
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c]), True if supplied is None else bool(supplied[r, c])) for r in range(h) for c in range(w)]
    px = spark.createDataFrame(rows, "row long, col long, z float, supplied boolean")
    out = np.full(z.shape, -1)
    for r in fill.surface(px, profile, 0, 0, h, w, resolution, side).collect():
        out[r.row, r.col] = r.surface
    return out


def flooded(mask, starts):
    """Cells of a mask that are reached from the starts by steps up, down, left and right."""
    seen, todo = set(), [s for s in starts if mask[s]]
    while todo:
        r, c = todo.pop()
        if (r, c) not in seen:
            seen.add((r, c))
            todo += [(y, x) for y, x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x]]
    return seen


def by_the_rule(z, p, supplied, resolution):
    """The fill rule, gap by gap and shore by shore."""
    h, w = z.shape
    gap = np.isnan(z)
    edge = [(r, c) for r in range(h) for c in range(w) if r in (0, h - 1) or c in (0, w - 1)]
    open_ = flooded(gap, edge)
    near_gap = lambda r, c: any(0 <= y < h and 0 <= x < w and gap[y, x] for y, x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)))
    shore = [(r, c, z[r, c] <= np.float32(p.sea_m + p.low_margin_m)) for r in range(h) for c in range(w) if not gap[r, c] and near_gap(r, c)]
    out = np.zeros(z.shape, int)
    for r, c in np.argwhere(gap).tolist():
        if (r, c) not in open_:
            out[r, c] = 3
            continue
        metres = lambda kind: min((math.hypot(r - y, c - x) * resolution for y, x, low in shore if low == kind), default=math.inf)  # noqa: B023, E731
        low, high = metres(True), metres(False)
        x, y = (c + 0.5) * resolution, -(r + 0.5) * resolution
        barred = any(a <= x <= e and b <= y <= f for a, b, e, f in p.exclusions)
        water = low <= p.max_shore_m + 1e-9 and low <= high + p.preference_m + 1e-9 and not barred
        out[r, c] = (1 if supplied[r, c] else 2) if water else 4
    return out


@pytest.mark.parametrize("seed", range(6))
def test_surfaces_of_random_scenes(spark, seed):
    """Heights in terraces with ragged gaps, any size of block, missing tiles and barred zones."""
    rng = np.random.default_rng(100 + seed)
    h, w = rng.integers(9, 18, 2).tolist()
    z = (rng.integers(0, 4, (h, w)) * 1.75).astype(np.float32)
    z[rng.random((h, w)) < (0.25, 0.45, 0.6)[seed % 3]] = np.nan
    z[h // 2 :, w // 3 : 2 * w // 3] = np.nan
    supplied = np.ones((h, w), bool)
    supplied[:, w // 2 : w // 2 + 2] = seed % 2 == 0
    resolution = (0.5, 1.0)[seed % 2]
    p = fill.Profile(0.5, (0.75, 1.5)[seed % 2], (1.5, 4.0, 40.0)[seed % 3], (0.0, 1.0)[seed // 3], ((1.0, -3.0, 2.5, -1.0),) if seed % 2 else ())
    assert (surface(spark, z, p, supplied, resolution, (3, 5, 64)[seed % 3]) == by_the_rule(z, p, supplied, resolution)).all()


def test_lagoon_behind_a_bar(spark):
    """A gap that only meets the outside across a corner is enclosed; once the bar has a hole, it is open."""
    z = np.full((7, 7), 0.25, np.float32)
    z[2:5, 2:5] = np.nan
    z[0, 0] = z[1, 1] = np.nan
    p = fill.Profile(0.0, 0.5, 9.0, 0.0)
    got = surface(spark, z, p)
    assert (got[2:5, 2:5] == 3).all() and got[0, 0] == 1 and got[1, 1] == 3
    z[3, 5:] = np.nan
    got = surface(spark, z, p)
    assert (got[2:5, 2:5] == 1).all() and got[1, 1] == 3


@pytest.mark.parametrize(("most", "side"), [(2.5, 4), (6.0, 5), (11.0, 32), (0.4, 8)])
def test_nearest_is_the_least_of_all(spark, most, side):
    rng = np.random.default_rng(int(most * 10))
    at = rng.permutation(26 * 31)[:160]
    points, shore = ([(int(i) // 31 - 9, int(i) % 31 - 14) for i in part] for part in (at[:130], at[130:]))
    got = {(r.row, r.col): (r.tag, r.d) for r in fill.nearest(spark.createDataFrame([(r, c, f"{r}/{c}") for r, c in points], "row long, col long, tag string"), spark.createDataFrame(shore, "row long, col long"), most, "d", side).collect()}
    for r, c in points:
        d = min(math.hypot(r - y, c - x) for y, x in shore)
        assert got[r, c] == (f"{r}/{c}", pytest.approx(d) if d <= most + 1e-9 else None)
    assert len(got) == len(points)


@pytest.mark.parametrize("side", [2, 5, 40])
def test_components_do_not_depend_on_blocks(spark, side):
    rng = np.random.default_rng(77)
    mask = rng.random((17, 11)) < 0.55
    mask[8] = True
    wanted, left = {}, {(r, c) for r, c in np.argwhere(mask).tolist()}
    while left:
        own = flooded(mask, [min(left)])
        wanted |= dict.fromkeys(own, min(own))
        left -= own
    got = {(r.row, r.col): (r.component // 2**32, r.component % 2**32) for r in fill.components(spark.createDataFrame(sorted(wanted), "row long, col long"), side).collect()}
    assert got == wanted


def test_spiral_is_one_component():
    n, mask = 21, np.zeros((21, 21), bool)
    r = c = k = 0
    steps = ((0, 1), (1, 0), (0, -1), (-1, 0))
    mask[0, 0] = True
    while True:
        y, x = steps[k % 4]
        moved = False
        while 0 <= r + y < n and 0 <= c + x < n and not (0 <= r + 2 * y < n and 0 <= c + 2 * x < n and mask[r + 2 * y, c + 2 * x]) and not mask[r + y, c + x]:
            r, c, moved = r + y, c + x, True
            mask[r, c] = True
        if not moved:
            break
        k += 1
    assert mask.sum() > 150 and set(np.unique(fill._label(mask)[mask])) == {0}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-5, 5).map(lambda v: round(v, 1))), max_size=60), st.integers(1, 40))
def test_quantiles_are_exact(spark, values, few):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quantiles, "FEW", few)
        m.setattr(quantiles, "RANGES", 5)
        got = quantiles.exact(df, "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).first()
    own = [v for v in values if v is not None]
    assert tuple(got) == ((None,) * 4 if not own else tuple(pytest.approx(float(np.quantile(own, q)), abs=1e-12) for q in (0.0, 0.37, 0.5, 1.0)))


def codes_rows():
    """(surface, filled, raw, dependency): every case of the rule for single pixels, as the definition of the codes gives it."""
    out = []
    for surface_ in (0, 1, 2, 3, 4, 255):
        for filled in (0, 1, 255):
            for raw in (0, 1, 255):
                if surface_ == 255:
                    code = 255
                elif filled == 255:
                    code = 4
                elif surface_ > 0:
                    code = 3
                else:
                    code = 0 if raw == filled else 1 if raw == 255 else 2
                out.append((surface_, filled, raw, code))
    return out


def test_dependency_codes_of_every_case(spark):
    cases = codes_rows()
    rows = [(1, 0, i, s, f, 3 if f == 255 else 0, r, 2 if r == 255 else 0) for i, (s, f, r, _) in enumerate(cases)]
    both = spark.createDataFrame(rows, "frame int, row long, col long, surface smallint, shade smallint, quality smallint, raw_shade smallint, raw_quality smallint")
    deps = impact.dependencies(both)
    assert [r.code for r in deps.orderBy("col").collect()] == [k for *_, k in cases]
    group = lambda s: {0: "land", 3: "land", 1: "water", 2: "water", 4: "other"}.get(s)
    counts = {(r.grp, r.code): r.pixels for r in impact.dependency_counts(deps).collect()}
    assert counts == {(g, k): sum(group(s) == g and code == k for s, _, _, code in cases) for g in ("land", "water", "other") for k in range(5)}
    moves = {(r.raw_shade, r.shade): r.pixels for r in impact.transitions(both).collect()}
    assert moves == {(r, f): 1 for r in (0, 1, 255) for f in (0, 1, 255)}


def test_map_agreement_is_counted_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = [(int(s), bool(a), bool(b), bool(c)) for s, a, b, c in zip(rng.integers(0, 5, 300), rng.random(300) < 0.5, rng.random(300) < 0.3, rng.random(300) < 0.8, strict=True)]
    r = impact.map_agreement(spark.createDataFrame(rows, "surface smallint, sea boolean, land boolean, inside boolean")).first()
    n = lambda f: sum(map(f, rows))
    assert r.water_pixels == n(lambda x: x[0] in (1, 2)) and r.false_water == n(lambda x: x[0] in (1, 2) and x[2]) and r.water_in_mapped_sea == n(lambda x: x[0] in (1, 2) and x[1] and not x[2])
    assert (r.missed_sea_3, r.missed_sea_4) == tuple(n(lambda x, k=k: x[0] == k and x[1] and not x[2]) for k in (3, 4)) and r.mapped_sea_missing == n(lambda x: 1 <= x[0] <= 4 and x[1] and not x[2])
    assert r.class_3_in_sea == n(lambda x: x[0] == 3 and x[1]) and r.water_unmapped == n(lambda x: x[0] in (1, 2) and not x[1] and not x[2]) and r.water_outside_coverage == n(lambda x: x[0] in (1, 2) and not (x[1] or x[2] or x[3]))


def test_heights_are_kept_to_the_bit(spark):
    """What was observed is passed on bit by bit, also what equals no short decimal; water gets the sea's height."""
    z = np.array([[0.1, -0.0, np.nan, np.nan], [1e-42, 3.4e38, np.nan, 7.7]], np.float32)
    p = fill.Profile(0.3, 1.0, 50.0, 50.0)
    px = oracle.pixels(spark, z).withColumn("supplied", F.lit(True))
    out = {(r.row, r.col): r.z for r in fill.filled(fill.surface(px, p, 0, 0, 2, 4, 1.0, 3), p.sea_m).collect()}
    for (r, c), v in np.ndenumerate(z):
        assert np.float32(out[r, c]).tobytes() == (np.float32(0.3) if np.isnan(v) else v).tobytes()
