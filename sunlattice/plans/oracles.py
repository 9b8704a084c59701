"""The registered queries as SQL for DuckDB, written from the operators' definitions and not from their Spark form."""

from __future__ import annotations

from . import catalog, scene
from .catalog import DIRECTIONS, PROFILE, RADIUS

N, T = scene.SIDE, scene.TILE
TILE_NAME = f"('t' || CAST(floor(r / {T}.0) AS BIGINT) || '_' || CAST(floor(c / {T}.0) AS BIGINT))"

CELLS = f"cells AS MATERIALIZED (SELECT l_orderkey % {N} AS r, l_partkey % {N} AS c, CAST(sum(l_quantity) AS BIGINT) AS q, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)"
PX = f"{CELLS}, px AS MATERIALIZED (SELECT r, c, CASE WHEN n % 11 <> 0 THEN CAST((q % 97) / 4.0 AS FLOAT) END AS z, {TILE_NAME} AS tile FROM cells)"
GAPPY = (
    f"{CELLS}, grid AS (SELECT i // {N} AS r, i % {N} AS c FROM range({N * N}) t(i)), "
    f"g AS MATERIALIZED (SELECT grid.r, grid.c, CASE WHEN n % 5 >= 2 THEN CAST((q % 23) / 4.0 AS FLOAT) END AS z, ('t' || (grid.r // {T}) || '_' || (grid.c // {T})) AS tile, grid.c < {N - T} AS supplied FROM grid LEFT JOIN cells USING (r, c))"
)
TILES = (
    f"tiles AS MATERIALIZED (SELECT 't' || ty || '_' || tx AS tile, ty, tx, tx * {T / 2} AS l, -(ty + 1) * {T / 2} AS b, (tx + 1) * {T / 2} AS rt, -ty * {T / 2} AS tp, "
    f"{scene.LATITUDE} - ty * 0.25 AS latitude, {scene.LONGITUDE} + tx * 0.25 AS longitude FROM (SELECT i // {N // T} AS ty, i % {N // T} AS tx FROM range({(N // T) ** 2 - 1}) t(i)))"
)


FRAMES = "frames AS MATERIALIZED (SELECT utc, CAST(row_number() OVER (ORDER BY utc) AS INT) AS frame FROM (SELECT DISTINCT date_trunc('hour', ts) AS utc FROM events WHERE ts IS NOT NULL))"


def sun(name: str, source: str, keep: str, utc: str, lat: str, lon: str) -> str:
    """CTEs that end in `name`: keep, azimuth, geometric, apparent."""
    g, d = "_g", "_d"
    return f"""
{name}0 AS (SELECT {keep}, radians({lat}) AS la, {lon} AS lo, year({utc}) AS y, dayofyear({utc}) AS dy, hour({utc}) + minute({utc}) / 60.0 + (epoch_us({utc}) % 60000000) / 3.6e9 AS h FROM {source}),
{name}1 AS (SELECT *, 2 * pi() / (CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 366 ELSE 365 END) * (dy - 1 + (h - 12) / 24.0) AS {g} FROM {name}0),
{name}2 AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos({g}) - 0.032077 * sin({g}) - 0.014615 * cos(2 * {g}) - 0.040849 * sin(2 * {g})) AS eq,
  0.006918 - 0.399912 * cos({g}) + 0.070257 * sin({g}) - 0.006758 * cos(2 * {g}) + 0.000907 * sin(2 * {g}) - 0.002697 * cos(3 * {g}) + 0.00148 * sin(3 * {g}) AS {d} FROM {name}1),
{name}3 AS (SELECT *, radians((((h * 60 + eq + 4 * lo) % 1440) + 1440) % 1440 / 4 - 180) AS ha FROM {name}2),
{name}4 AS (SELECT *, degrees(asin(greatest(-1.0, least(1.0, sin(la) * sin({d}) + cos(la) * cos({d}) * cos(ha))))) AS geometric,
  ((degrees(atan2(sin(ha), cos(ha) * sin(la) - tan({d}) * cos(la))) + 180) % 360 + 360) % 360 AS azimuth FROM {name}3),
{name} AS MATERIALIZED (SELECT *, geometric + CASE WHEN geometric > 85 THEN 0.0
  WHEN geometric > 5 THEN (58.1 / tan(radians(geometric)) - 0.07 / pow(tan(radians(geometric)), 3) + 0.000086 / pow(tan(radians(geometric)), 5)) / 3600
  WHEN geometric > -0.575 THEN (1735 - 518.2 * geometric + 103.4 * pow(geometric, 2) - 12.79 * pow(geometric, 3) + 0.711 * pow(geometric, 4)) / 3600
  ELSE -20.774 / tan(radians(geometric)) / 3600 END AS apparent FROM {name}4)"""


EVENT_SUN = sun("s", "events", "event_id, ts", "ts", str(scene.LATITUDE), str(scene.LONGITUDE))
BIN5 = "(floor((azimuth + 2.5) / 5.0) * 5.0) % 360"
SUN = TILES + ", " + FRAMES + ", tf AS (SELECT * FROM frames CROSS JOIN tiles), " + sun("ss", "tf", "frame, utc, tile", "utc", "latitude", "longitude") + f", sun AS MATERIALIZED (SELECT frame, utc, tile, apparent, {BIN5} AS direction FROM ss)"
NEEDED = "needed AS MATERIALIZED (SELECT DISTINCT tile, direction FROM sun WHERE apparent > 0)"


def offsets(source: str, radius: float = RADIUS, coarse: bool = False) -> str:
    """CTE off: direction, rp, cp, rd, cd, dist."""
    step = 0.5 if coarse else 0.25
    snap = (lambda x: x) if coarse else (lambda x: f"(CASE WHEN abs({x}) < 1e-14 THEN 0.0 ELSE {x} END)")
    dr, dc = snap("(-cos(radians(direction)))"), snap("sin(radians(direction))")
    return f"""dirs AS (SELECT DISTINCT direction FROM {source}),
o0 AS (SELECT direction, rp, cp, i * {step} AS dist, CAST(round_even(rp + {dr} * (i * {step}) / 0.5, 0) AS INT) - rp AS rd, CAST(round_even(cp + {dc} * (i * {step}) / 0.5, 0) AS INT) - cp AS cd
  FROM dirs, range(1, {int(radius / step) + 1}) t(i), (VALUES (0), (1)) a(rp), (VALUES (0), (1)) b(cp)),
off AS MATERIALIZED (SELECT direction, rp, cp, rd, cd, min(dist) AS dist FROM o0 WHERE (rd * rd + cd * cd) * 0.25 <= {radius * radius} + 1e-9 GROUP BY ALL)"""


def rays(name: str, target: str, sample: str, own: bool = False) -> str:
    """CTE: r, c, z, direction, slope, support, blocker, horizon."""
    return f"""{name}0 AS (SELECT t.r, t.c, t.z, o.direction, o.dist, s.z IS NOT NULL AS there, CAST(s.z - t.z AS DOUBLE) / o.dist AS v FROM {target} t JOIN off o ON t.r % 2 = o.rp AND t.c % 2 = o.cp {"AND t.direction = o.direction" if own else ""}
  LEFT JOIN {sample} s ON s.r = t.r + o.rd AND s.c = t.c + o.cd WHERE t.z IS NOT NULL),
{name}1 AS (SELECT r, c, z, direction, greatest(0.0, coalesce(max(v), 0.0)) AS slope, min(CASE WHEN there THEN 1 ELSE 0 END) AS support FROM {name}0 GROUP BY ALL),
{name} AS MATERIALIZED (SELECT a.r, a.c, a.z, a.direction, a.slope, a.support, CAST(degrees(atan(a.slope)) AS FLOAT) AS horizon, CAST(CASE WHEN a.slope > 0 THEN min(b.dist) ELSE 0 END AS FLOAT) AS blocker
  FROM {name}1 a LEFT JOIN {name}0 b ON a.r = b.r AND a.c = b.c AND a.direction = b.direction AND b.v = a.slope GROUP BY a.r, a.c, a.z, a.direction, a.slope, a.support)"""


def _values(directions) -> str:
    return "ask(direction) AS (VALUES " + ", ".join(f"(CAST({d} AS DOUBLE))" for d in directions) + ")"


FINE = f"WITH {PX}, {_values(DIRECTIONS)}, {offsets('ask')}, {rays('h', 'px', 'px')}"
BOTH = FINE + ", " + offsets("ask", coarse=True).replace("dirs AS", "dirs2 AS").replace("FROM dirs", "FROM dirs2").replace("o0 ", "o2 ").replace("off AS", "off2 AS").replace("FROM o2 WHERE", "FROM o2 WHERE") + ", " + rays("k", "px", "px").replace("JOIN off o", "JOIN off2 o")
RAY_SUMS = "SELECT direction, count(*) AS n, CAST(sum(support) AS BIGINT) AS supported, round(sum(round(CAST(horizon AS DOUBLE), 4)), 4) AS horizon_sum, sum(CAST(blocker AS DOUBLE)) AS blocker_sum FROM h GROUP BY direction"

NEAR = f"near AS (SELECT a.tile, a.l, a.b, a.rt, a.tp, b.tile AS o FROM tiles a JOIN tiles b ON a.l - {RADIUS} < b.rt AND b.l < a.rt + {RADIUS} AND a.b - {RADIUS} < b.tp AND b.b < a.tp + {RADIUS})"


def thresholds(px: str) -> str:
    x, y = "(p.c + 0.5) * 0.5", "-(p.r + 0.5) * 0.5"
    return f"""{NEAR}, hi AS (SELECT n.tile, max(p.z) AS highest_near FROM near n JOIN {px} p ON p.tile = n.o AND p.z IS NOT NULL AND {x} > n.l - {RADIUS} AND {x} < n.rt + {RADIUS} AND {y} > n.b - {RADIUS} AND {y} < n.tp + {RADIUS} GROUP BY n.tile),
thr AS MATERIALIZED (SELECT tile, count(z) AS valid, min(z) AS lowest, highest_near, degrees(atan(greatest(0.0, CAST(highest_near AS DOUBLE) - CAST(min(z) AS DOUBLE)) / {RADIUS})) AS threshold FROM {px} JOIN hi USING (tile) GROUP BY tile, highest_near HAVING count(z) > 0)"""


LABELS = f"""WITH {PX}, {SUN}, {NEEDED}, pt AS MATERIALIZED (SELECT px.* FROM px JOIN tiles USING (tile)), {thresholds("pt")},
target AS (SELECT pt.*, direction FROM pt JOIN needed USING (tile)), {offsets("needed")}, {rays("h", "target", "pt", own=True)},
lab AS MATERIALIZED (SELECT s.frame, p.tile, p.r, p.c, CASE WHEN p.z IS NULL THEN 4 ELSE 0 END AS surface,
  CASE WHEN p.z IS NULL THEN 1 WHEN s.apparent <= 0 THEN 4 WHEN h.horizon > CAST(s.apparent AS FLOAT) THEN 0 WHEN coalesce(h.support, 0) = 0 THEN 2 WHEN s.apparent <= t.threshold THEN 3 ELSE 0 END AS quality,
  s.apparent > 0 AND h.horizon > CAST(s.apparent AS FLOAT) AS blocked
  FROM sun s JOIN pt p USING (tile) LEFT JOIN thr t USING (tile) LEFT JOIN h ON s.apparent > 0 AND h.r = p.r AND h.c = p.c AND h.direction = s.direction),
layer AS MATERIALIZED (SELECT frame, tile, r, c, surface, quality, CASE WHEN quality <> 0 THEN 255 WHEN blocked THEN 1 ELSE 0 END AS shade FROM lab),
combo AS MATERIALIZED (SELECT frame, surface, shade, quality, count(*) AS pixels FROM layer GROUP BY ALL)"""

GROUP = "(CASE WHEN surface IN (0, 3) THEN 'land' WHEN surface IN (1, 2) THEN 'water' WHEN surface = 4 THEN 'other' END)"


def rolled(key: str) -> str:
    return f"""roll AS MATERIALIZED (SELECT frame, {key}, CAST(sum(pixels) AS BIGINT) AS pixels, CAST(sum(CASE WHEN shade = 0 THEN pixels ELSE 0 END) AS BIGINT) AS sunlit, CAST(sum(CASE WHEN shade = 1 THEN pixels ELSE 0 END) AS BIGINT) AS shaded,
  CAST(sum(CASE WHEN shade = 255 THEN pixels ELSE 0 END) AS BIGINT) AS uncertain, {", ".join(f"CAST(sum(CASE WHEN shade = 255 AND quality = {q} THEN pixels ELSE 0 END) AS BIGINT) AS quality_{q}" for q in (1, 2, 3, 4))} FROM combo GROUP BY ALL)"""


BESIDE = "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dr, dc)"
EIGHT = "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)) d(dr, dc)"
SHORE = f"shore AS MATERIALIZED (SELECT DISTINCT g.r, g.c, g.z, g.z <= CAST({PROFILE.sea_m + PROFILE.low_margin_m} AS DOUBLE) AS low FROM g, {BESIDE} JOIN g m ON m.r = g.r + dr AND m.c = g.c + dc AND m.z IS NULL WHERE g.z IS NOT NULL)"
REACH = f"reach(r, c) AS (SELECT r, c FROM g WHERE z IS NULL AND (r IN (0, {N - 1}) OR c IN (0, {N - 1})) UNION SELECT m.r, m.c FROM reach, {BESIDE}, g m WHERE m.r = reach.r + dr AND m.c = reach.c + dc AND m.z IS NULL)"


def surface(profile=PROFILE) -> str:
    most, prefer = profile.max_shore_m / 0.5, profile.preference_m / 0.5
    out = " OR ".join(f"((g.c + 0.5) * 0.5 BETWEEN {x[0]} AND {x[2]} AND -(g.r + 0.5) * 0.5 BETWEEN {x[1]} AND {x[3]})" for x in profile.exclusions)
    return f"""shore AS MATERIALIZED (SELECT DISTINCT g.r, g.c, g.z <= {profile.sea_m + profile.low_margin_m} AS low FROM g, {BESIDE} JOIN g m ON m.r = g.r + dr AND m.c = g.c + dc AND m.z IS NULL WHERE g.z IS NOT NULL),
dist AS (SELECT a.r, a.c, sqrt(min(CASE WHEN s.low THEN (a.r - s.r) * (a.r - s.r) + (a.c - s.c) * (a.c - s.c) END)) AS dl, sqrt(min(CASE WHEN NOT s.low THEN (a.r - s.r) * (a.r - s.r) + (a.c - s.c) * (a.c - s.c) END)) AS dh
  FROM reach a JOIN shore s ON abs(a.r - s.r) <= {most + prefer + 1} AND abs(a.c - s.c) <= {most + prefer + 1} GROUP BY a.r, a.c),
view AS MATERIALIZED (SELECT g.*, CASE WHEN g.z IS NOT NULL THEN 0 WHEN reach.r IS NULL THEN 3 WHEN dl <= {most} AND (dh IS NULL OR dl <= dh + {prefer}) AND NOT ({out}) THEN (CASE WHEN supplied THEN 1 ELSE 2 END) ELSE 4 END AS surface
  FROM g LEFT JOIN reach ON g.r = reach.r AND g.c = reach.c LEFT JOIN dist ON g.r = dist.r AND g.c = dist.c)"""


VIEW = f"WITH RECURSIVE {GAPPY}, {REACH}, {surface()}"
ROOTS = f"""WITH RECURSIVE {GAPPY}, e AS MATERIALIZED (SELECT a.r * {N} + a.c AS u, m.r * {N} + m.c AS v FROM g a, {BESIDE} JOIN g m ON m.r = a.r + dr AND m.c = a.c + dc WHERE a.z IS NULL AND m.z IS NULL),
walk(u, v) AS (SELECT r * {N} + c, r * {N} + c FROM g WHERE z IS NULL UNION SELECT walk.u, e.v FROM walk JOIN e ON walk.v = e.u),
root AS MATERIALIZED (SELECT u, min(v) AS k, bool_or(v // {N} IN (0, {N - 1}) OR v % {N} IN (0, {N - 1})) AS open FROM walk GROUP BY u)"""


def _impact() -> str:
    run = lambda name, px: f"{rays('h' + name, px, px).replace('off o', 'off o')}, run{name} AS MATERIALIZED (SELECT p.r, p.c, p.z, h.horizon, h.blocker, CASE WHEN p.z IS NULL THEN 1 WHEN h.horizon > CAST(30.0 AS FLOAT) THEN 0 WHEN coalesce(h.support, 0) = 0 THEN 2 ELSE 0 END AS quality, coalesce(h.horizon > CAST(30.0 AS FLOAT), false) AS blocked FROM {px} p LEFT JOIN h{name} h ON p.r = h.r AND p.c = h.c)"
    shade = "CASE WHEN {0}.quality <> 0 THEN 255 WHEN {0}.blocked THEN 1 ELSE 0 END"
    return f"""{VIEW}, full_ AS MATERIALIZED (SELECT r, c, CASE WHEN surface IN (1, 2) THEN CAST({PROFILE.sea_m} AS FLOAT) WHEN surface = 0 THEN z END AS z FROM view), {_values((115.0,))}, {offsets("ask", 5.0)}, {run("a", "full_")}, {run("b", "view")},
two AS MATERIALIZED (SELECT v.r, v.c, v.surface, {shade.format("a")} AS shade, a.quality, {shade.format("b")} AS raw_shade, b.quality AS raw_quality, a.blocker FROM view v JOIN runa a USING (r, c) JOIN runb b USING (r, c)),
dep AS MATERIALIZED (SELECT *, {GROUP} AS grp, CASE WHEN surface > 4 THEN 255 WHEN shade = 255 THEN 4 WHEN surface <> 0 THEN 3 WHEN raw_shade = shade THEN 0 WHEN raw_shade = 255 THEN 1 ELSE 2 END AS code FROM two),
dh AS MATERIALIZED (SELECT 1 AS frame, a.grp, b.code, count(dep.r) AS pixels FROM (VALUES ('land'), ('water'), ('other')) a(grp) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) b(code) LEFT JOIN dep ON dep.grp = a.grp AND dep.code = b.code GROUP BY ALL)"""


IMPACT = _impact()
SHIFTED = f"{TILES}, sh AS MATERIALIZED (SELECT tile, l, b, rt, tp FROM tiles UNION ALL SELECT 's' || tile, l + 2.5, b + 2.5, rt + 2.5, tp + 2.5 FROM tiles WHERE (tx + ty) % 2 = 0)"
DIFF = f"{PX}, df AS MATERIALIZED (SELECT true AS vertical, abs(a.z - b.z) AS diff FROM px a JOIN px b ON a.r = b.r AND a.c + 1 = b.c AND a.tile <> b.tile WHERE a.z IS NOT NULL AND b.z IS NOT NULL UNION ALL SELECT false, abs(a.z - b.z) FROM px a JOIN px b ON a.c = b.c AND a.r + 1 = b.r AND a.tile <> b.tile WHERE a.z IS NOT NULL AND b.z IS NOT NULL), bins AS MATERIALIZED (SELECT least(CAST(floor(diff / CAST(0.25 AS FLOAT)) AS BIGINT), 40) AS bin, count(*) AS n FROM df GROUP BY 1)"
SPANS = "iv AS MATERIALIZED (SELECT band, s, s + 2 + s % 4 AS e FROM (SELECT DISTINCT l_suppkey % 5 AS band, l_partkey * 3 % 5000 AS s FROM lineitem))"
MERGED = f"{SPANS}, pts AS (SELECT DISTINCT band, unnest(range(s, e)) AS p FROM iv), isl AS (SELECT band, p, p - row_number() OVER (PARTITION BY band ORDER BY p) AS k FROM pts), mg AS MATERIALIZED (SELECT band, min(p) AS s, max(p) + 1 AS e FROM isl GROUP BY band, k)"
TASKS = "tk AS MATERIALIZED (SELECT o_orderkey AS task, CASE WHEN o_orderkey % 7 < 3 THEN 'succeeded' WHEN o_orderkey % 7 < 5 THEN 'queued' WHEN o_orderkey % 7 = 5 THEN 'running' ELSE 'failed' END AS state FROM orders), ed AS MATERIALIZED (SELECT o_orderkey AS task, o_orderkey // 2 AS needs FROM orders WHERE o_orderkey > 1)"
READY = f"{TASKS}, rd AS (SELECT task FROM tk t WHERE state = 'queued' AND NOT EXISTS (SELECT 1 FROM ed LEFT JOIN tk n ON n.task = ed.needs WHERE ed.task = t.task AND coalesce(n.state, '') <> 'succeeded'))"
SECOND = "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT)"


def _files_view() -> str:
    """The filled view of the supplied part of the scene: its domain ends where the files do."""
    most = N - T
    own = GAPPY.replace("g AS MATERIALIZED (", "g AS MATERIALIZED (SELECT * FROM (") + f" WHERE c < {most})"
    return own + ", " + REACH.replace(f"c IN (0, {N - 1})", f"c IN (0, {most - 1})") + ", " + surface()


FILES_VIEW = _files_view()


def _daylight() -> str:
    """CTEs that end in up: day, sunrise and sunset in seconds, by a lattice of two minutes and 28 halvings."""
    start = f"WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), l AS (SELECT day, day + i * INTERVAL 2 MINUTE AS t, i FROM d, range(721) x(i)), {sun('s0', 'l', 'day, i, t', 't', str(scene.LATITUDE), '0.0')}, n AS (SELECT day, epoch(t) AS p, geometric + 0.833 AS v, lead(geometric + 0.833) OVER (PARTITION BY day ORDER BY i) AS nx FROM s0), b0 AS (SELECT day, v > 0 AS up, p, p + 120 AS q FROM n WHERE v * nx < 0)"
    for k in range(28):
        start += f", m{k} AS (SELECT *, floor((p + q) / 2 * 1e6) / 1e6 AS mid, make_timestamp(CAST(floor((p + q) / 2 * 1e6) AS BIGINT)) AS t FROM b{k}), {sun(f'x{k}_', f'm{k}', 'day, up, p, q, mid, t', 't', str(scene.LATITUDE), '0.0')}, b{k + 1} AS MATERIALIZED (SELECT day, up, CASE WHEN (geometric + 0.833 > 0) = up THEN mid ELSE p END AS p, CASE WHEN (geometric + 0.833 > 0) = up THEN q ELSE mid END AS q FROM x{k}_)"
    return start + ", up AS MATERIALIZED (SELECT day, max(CASE WHEN NOT up THEN (p + q) / 2 END) AS sunrise, max(CASE WHEN up THEN (p + q) / 2 END) AS sunset FROM b28 GROUP BY day HAVING count(*) = 2)"


DAYLIGHT = _daylight()


def _edges_sql() -> str:
    ring = lambda name, pts: [(name, *a, *b) for a, b in zip(pts, pts[1:] + pts[:1], strict=True)]
    rows = ring("outer", [(1.0, -30.0), (30.0, -28.0), (27.0, -2.0), (3.0, -4.0)]) + ring("outer", [(10.0, -20.0), (20.0, -20.0), (20.0, -10.0), (10.0, -10.0)]) + ring("small", [(12.0, -18.0), (18.5, -17.0), (15.0, -11.0)])
    return "edge(polygon, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{p}', " + ", ".join(f"CAST({v} AS DOUBLE)" for v in xs) + ")" for p, *xs in rows) + ")"


def _grid_sql() -> str:
    a, f = 6378388.0, 1 / 297
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    arc = lambda p: f"({a} * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r} * {p} - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r} * sin(2 * {p}) + {15 * e2**2 / 256 + 45 * e2**3 / 1024!r} * sin(4 * {p}) - {35 * e2**3 / 3072!r} * sin(6 * {p})))"
    return f"""site AS (SELECT c_custkey, 22.2 + (c_custkey % 400) / 1000.0 AS lat, 113.9 + (c_custkey * 7 % 500) / 1000.0 AS lon FROM customer),
q0 AS (SELECT *, radians(lat + 5.5 / 3600) AS p, radians(lon - 8.8 / 3600) AS m FROM site),
q1 AS (SELECT *, {a} / sqrt(1 - {e2!r} * sin(p) * sin(p)) AS nu, tan(p) * tan(p) AS t, {ep2!r} * cos(p) * cos(p) AS cc, (m - radians(114 + 10 / 60.0 + 42.80 / 3600)) * cos(p) AS aa FROM q0)
SELECT c_custkey, round(836694.05 + nu * (aa + (1 - t + cc) * pow(aa, 3) / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * {ep2!r}) * pow(aa, 5) / 120), 3) AS east,
  round(819069.80 + {arc("p")} - {arc("radians(22 + 18 / 60.0 + 43.68 / 3600)")} + nu * tan(p) * (aa * aa / 2 + (5 - t + 9 * cc + 4 * cc * cc) * pow(aa, 4) / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * {ep2!r}) * pow(aa, 6) / 720), 3) AS north FROM q1"""


PLACES = "pl AS (SELECT c_custkey, (c_custkey * 37 % 340) / 10.0 - 1.0 AS x, 1.0 - (c_custkey * 53 % 340) / 10.0 AS y FROM customer)"


def _strip() -> str:
    """The turned strip, every pair of cells of a column compared."""
    middle, sine, cosine = (N - 1) / 2, "sin(radians(37.0))", "cos(radians(37.0))"
    return f"""WITH {PX}, st AS (SELECT i, j, (i + 0.5) * 0.5 - 14.0 AS t, (j + 0.5) * 0.5 - 8.0 AS s FROM range(46) a(i), range(32) b(j)),
sat AS (SELECT i, j, CAST(round_even({middle} + (t * {cosine} + s * {sine}) / 0.5, 0) AS BIGINT) AS r, CAST(round_even({middle} + (s * {cosine} - t * {sine}) / 0.5, 0) AS BIGINT) AS c FROM st),
sz AS MATERIALIZED (SELECT i, j, CAST(z AS DOUBLE) AS z FROM sat LEFT JOIN px USING (r, c)),
pr AS MATERIALIZED (SELECT a.i, a.j, (a.i - b.i) * 0.5 AS dist, b.z IS NOT NULL AS there, (b.z - a.z) / ((a.i - b.i) * 0.5) AS v FROM sz a LEFT JOIN sz b ON a.j = b.j AND b.i < a.i AND b.i >= a.i - 20 WHERE a.z IS NOT NULL),
mx AS (SELECT i, j, greatest(0.0, coalesce(max(v), 0.0)) AS m, count(*) FILTER (WHERE dist <= 4.0 AND there) = 8 AS support FROM pr GROUP BY i, j)
SELECT i, j, round(m, 6) AS slope, support, coalesce((SELECT max(dist) FROM pr WHERE pr.i = mx.i AND pr.j = mx.j AND pr.v = mx.m AND mx.m > 0), 0.0) AS blocker FROM mx"""


def _kites() -> str:
    """CTEs: n (a nation's kite), and the edges of those that are asked for, inside to the left: outer rings from east over north, holes the other way."""
    places = "(0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1)"
    edge = lambda size, x, y, way: f"SELECT k, {way} AS way, {x} + p.dx * {size} AS x1, {y} + p.dy * {size} AS y1, {x} + q.dx * {size} AS x2, {y} + q.dy * {size} AS y2 FROM n, pt p JOIN pt q ON q.i = (p.i + 1) % 4"
    return f"""WITH n AS MATERIALIZED (SELECT n_nationkey AS k, n_nationkey * 7 % 29 + 1.3::DOUBLE AS x, -(n_nationkey * 11 % 27 + 3.7::DOUBLE) AS y, n_regionkey + 1.5::DOUBLE AS rad, ['SEA', 'LAND', 'ROAD'][n_nationkey % 3 + 1] AS code FROM nation WHERE n_nationkey % 4 <> 3 AND n_nationkey % 3 < 2),
pt(i, dx, dy) AS (VALUES {places}), ring AS MATERIALIZED ({edge("rad", "x", "y", 1)} UNION ALL {edge("0.75", "x", "y", -1)} WHERE rad > 3 UNION ALL {edge("1.0", "(x + 40)", "y", 1)} WHERE k % 5 = 0)"""


def _clipped() -> str:
    """Each edge against every cell near its polygon: the mean height under it within the cell, by where it enters and leaves the cell's band."""
    h = lambda v: f"(CASE WHEN {v} <= cy * 2.0 THEN 0.0 WHEN {v} >= cy * 2.0 + 2 THEN 2 + 2 * ({v} - cy * 2.0 - 2) ELSE ({v} - cy * 2.0) ** 2 / 2 END)"
    return f"""{_kites()}, up AS (SELECT k, way * (CASE WHEN x2 < x1 THEN 1 ELSE -1 END) AS way, least(x1, x2) AS a, greatest(x1, x2) AS b, CASE WHEN x1 < x2 THEN y1 ELSE y2 END AS ya, CASE WHEN x1 < x2 THEN y2 ELSE y1 END AS yb FROM ring),
cut AS (SELECT k, way, cx, cy, greatest(a, cx * 2.0) AS xa, least(b, cx * 2.0 + 2) AS xb, a, b, ya, yb FROM up, range(-4, 40) s(cx), range(-20, 4) t(cy) WHERE a < cx * 2.0 + 2 AND b > cx * 2.0),
pc AS (SELECT k, way, cx, cy, xb - xa AS w, ya + (xa - a) / (b - a) * (yb - ya) AS y1, ya + (xb - a) / (b - a) * (yb - ya) AS y2 FROM cut WHERE xb > xa),
ar AS (SELECT k, cx, cy, round(sum(way * w * ({h("y2")} - {h("y1")}) / (y2 - y1)), 6) AS area FROM pc GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS id, cx AS x, cy AS y, area FROM ar WHERE area > 0"""


def oracle_sql() -> dict[str, str]:
    touch = "a.l < b.rt AND b.l < a.rt AND a.b < b.tp AND b.b < a.tp"
    gap_tiles = GAPPY + ", files AS MATERIALIZED (SELECT tile, min(r) AS r0, min(c) AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1 FROM g WHERE supplied GROUP BY tile)"
    labels_of_files = LABELS.replace(PX, GAPPY + ", px AS MATERIALIZED (SELECT r, c, z, tile FROM g WHERE supplied)")
    snap_down, snap_up = (lambda x: f"floor(({x}) / 0.5 + 1e-7) * 0.5"), (lambda x: f"ceil(({x}) / 0.5 - 1e-7) * 0.5")
    out = {
        "f1_solar_events": f"WITH {EVENT_SUN} SELECT event_id, round(azimuth, 6) AS azimuth, round(geometric, 6) AS geometric, round(apparent, 6) AS apparent FROM s",
        "f4_direction_bins": f"WITH {EVENT_SUN} SELECT 'nearest5' AS method, {BIN5} AS direction, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'nearest2_5', (floor((azimuth + 1.25) / 2.5) * 2.5) % 360, count(*) FROM s GROUP BY ALL",
        "w1_crossings": f"WITH {EVENT_SUN}, u AS (SELECT CAST(ts AS DATE) AS day, ts, min(event_id) AS event_id, min(geometric + 0.833) AS v FROM s GROUP BY 1, 2), l AS (SELECT *, lead(v) OVER (PARTITION BY day ORDER BY ts) AS nx FROM u) SELECT CAST(day AS VARCHAR) AS day, event_id, v > 0 AS was_up FROM l WHERE v * nx < 0",
        "p9_daylight_filter": f"{DAYLIGHT}, k AS (SELECT event_id, coalesce(epoch(ts) BETWEEN sunrise AND sunset, false) AS kept FROM events LEFT JOIN up ON up.day = CAST(ts AS DATE)) SELECT event_id, kept, CASE WHEN NOT kept THEN 'outside daylight' END AS reason FROM k",
        "a26_distinct_directions": f"WITH {SUN}, {NEEDED} SELECT tile, direction FROM needed",
        "j9_frames_tiles": f"WITH {SUN} SELECT frame, count(*) AS tiles, count(*) FILTER (WHERE apparent > 0) AS up, round(max(apparent), 6) AS highest FROM sun GROUP BY frame",
        "j19_missing_directions": f"WITH {SUN}, {NEEDED} SELECT tile, direction FROM needed WHERE CAST(direction AS INT) % 10 <> 0",
        "a2_tile_threshold": f"WITH {PX}, {TILES}, {thresholds('px')} SELECT tile, valid, CAST(lowest AS DOUBLE) AS lowest, CAST(highest_near AS DOUBLE) AS highest_near, round(threshold, 6) AS threshold FROM thr",
        "j6_ray_slope_max": f"{FINE} {RAY_SUMS}",
        "j6_block_kernel": f"{FINE} {RAY_SUMS}",
        "a1_ray_support": f'WITH {PX}, {_values((45.0,))}, {offsets("ask")}, {rays("h", "px", "px")} SELECT r AS "row", c AS col, round(slope, 6) AS slope, CAST(support AS INT) AS support, CAST(blocker AS DOUBLE) AS blocker FROM h',
        "j7_coarse_ray": f"WITH {PX}, {_values(DIRECTIONS)}, {offsets('ask', coarse=True)}, {rays('h', 'px', 'px')} SELECT direction, count(*) AS n, CAST(sum(support) AS BIGINT) AS supported, round(sum(round(slope, 6)), 4) AS slope_sum FROM h GROUP BY direction",
        "a23_ray_errors": f"{BOTH} SELECT count(*) AS n, round(quantile_cont(abs(h.slope - k.slope), 0.5), 5) AS median, round(quantile_cont(abs(h.slope - k.slope), 0.95), 5) AS p95, round(max(abs(h.slope - k.slope)), 5) AS largest FROM h JOIN k USING (r, c, direction)",
        "a24_horizon_differences": f"{BOTH}, k2 AS (SELECT * FROM k WHERE (r + c) % 50 <> 0) SELECT count(*) FILTER (WHERE k2.r IS NULL) AS only_a, count(*) FILTER (WHERE h.r IS NULL) AS only_b, CAST(0 AS BIGINT) AS slope_nulls, round(max(abs(h.slope - k2.slope)), 5) AS slope_most, count(*) FILTER (WHERE abs(h.slope - k2.slope) > 0.5) AS slope_beyond, CAST(0 AS BIGINT) AS support_nulls, max(abs(CAST(h.support - k2.support AS DOUBLE))) AS support_most, count(*) FILTER (WHERE abs(h.support - k2.support) > 0.5) AS support_beyond FROM h FULL JOIN k2 ON h.r = k2.r AND h.c = k2.c AND h.direction = k2.direction",
        "f8_classify": f'{LABELS} SELECT frame, tile, r AS "row", c AS col, shade, quality FROM layer',
        "a5_label_counts": f"{LABELS} SELECT f.frame, q.quality, count(l.r) AS pixels FROM (SELECT DISTINCT frame FROM layer) f CROSS JOIN (VALUES (0), (1), (2), (3), (4)) q(quality) LEFT JOIN layer l ON l.frame = f.frame AND l.quality = q.quality GROUP BY ALL",
        "a6_contingency": f"{LABELS} SELECT frame, surface, shade, quality, pixels FROM combo",
        "a7_surface_rollup": f"{LABELS}, {rolled('surface')} SELECT * FROM roll",
        "a14_bounds": f"{LABELS}, {rolled(GROUP + ' AS grp')} SELECT frame, grp, pixels, round(sunlit / pixels, 6) AS sunlit_share, round(shaded / pixels, 6) AS shaded_low, round((shaded + uncertain) / pixels, 6) AS shaded_high, round(sunlit / pixels, 6) AS sunlit_low, round((sunlit + uncertain) / pixels, 6) AS sunlit_high FROM roll",
        "a15_daily_means": f"{LABELS}, {rolled(GROUP + ' AS grp')} SELECT CAST(CAST(utc AS DATE) AS VARCHAR) AS day, grp, count(*) AS frames, round(avg(sunlit / pixels), 6) AS sunlit_mean, round(avg(shaded / pixels), 6) AS shaded_mean, round(avg(uncertain / pixels), 6) AS uncertain_mean FROM roll JOIN frames USING (frame) GROUP BY 1, 2",
        "a32_marginals_cube": f"{LABELS} SELECT frame, surface, shade, quality, CAST(sum(pixels) AS BIGINT) AS pixels, grouping_id(frame, surface, shade, quality) AS level FROM combo GROUP BY CUBE (frame, surface, shade, quality) HAVING frame IS NOT NULL",
        "a32_reconcile": f"{LABELS} SELECT frame, 'shade' AS layer, 255 AS code, CAST(sum(pixels) AS BIGINT) AS computed, CAST(sum(pixels) + 5 AS BIGINT) AS published FROM combo WHERE shade = 255 AND frame % 7 = 1 GROUP BY frame",
        "p18_code_violations": "WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 2 THEN 255 ELSE CAST(l_partkey % 3 AS INT) END AS shade, CAST(l_suppkey % 6 AS INT) AS quality FROM lineitem) SELECT * FROM x WHERE NOT (quality <= 4 AND (shade = 255) = (quality <> 0))",
        "j1_tiles_in_rect": f"WITH {TILES} SELECT tile FROM tiles WHERE l < 16 AND 7 < rt AND b < -8 AND -17 < tp",
        "j2_buffered_dependencies": f"WITH {TILES}, {NEAR} SELECT tile, o AS b_tile FROM near",
        "j3_overlap_pairs": f"WITH {SHIFTED} SELECT a.tile, b.tile AS b_tile FROM sh a JOIN sh b ON a.tile < b.tile AND {touch}",
        "j5_halo_semi": f"WITH {TILES} SELECT tile FROM tiles b WHERE EXISTS (SELECT 1 FROM tiles a WHERE a.tile IN ('t0_0', 't2_3') AND a.l - 1 < b.rt AND b.l < a.rt + 1 AND a.b - 1 < b.tp AND b.b < a.tp + 1)",
        "j4_seam_pairs": f"WITH {TILES} SELECT a.tile, b.tile AS b_tile, true AS vertical, CAST(greatest(a.b, b.b) AS DOUBLE) AS low, CAST(least(a.tp, b.tp) AS DOUBLE) AS high FROM tiles a JOIN tiles b ON a.rt = b.l AND least(a.tp, b.tp) > greatest(a.b, b.b) UNION ALL SELECT a.tile, b.tile, false, CAST(greatest(a.l, b.l) AS DOUBLE), CAST(least(a.rt, b.rt) AS DOUBLE) FROM tiles a JOIN tiles b ON a.b = b.tp AND least(a.rt, b.rt) > greatest(a.l, b.l)",
        "a4_seam_statistics": f"WITH {DIFF} SELECT vertical, count(*) AS n, round(avg(CAST(diff AS DOUBLE)), 6) AS mean, max(CAST(diff AS DOUBLE)) AS largest FROM df GROUP BY vertical",
        "a4_seam_histogram": f"WITH {DIFF} SELECT bin, n FROM bins",
        "w5_histogram_quantile": f"WITH {DIFF}, cum AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cu, sum(n) OVER () AS tot FROM bins) SELECT CAST(q AS DOUBLE) AS q, CAST(min(bin) * 0.25 AS DOUBLE) AS quantile FROM cum, (VALUES (0.5), (0.95)) v(q) WHERE cu >= tot * q GROUP BY q",
        "a3_region_stats": f"WITH {PX} SELECT count(z) AS valid, CAST(1200 AS BIGINT) AS total, round(count(z) / 1200.0, 6) AS coverage, CAST(min(z) AS DOUBLE) AS lowest, CAST(max(z) AS DOUBLE) AS highest FROM px WHERE r BETWEEN 5 AND 34 AND c BETWEEN 10 AND 49",
        "s13_lattice_window": f'WITH {PX}, w AS (SELECT i // 20 - 2 AS r, i % 20 + 50 AS c FROM range(400) t(i)) SELECT w.r AS "row", w.c AS col, coalesce(CAST(p.z AS DOUBLE), -9999.0) AS z FROM w LEFT JOIN (SELECT * FROM px WHERE (r * 3 + c) % 7 <> 0) p USING (r, c)',
        "s14_mosaic": f'WITH {PX}, u AS (SELECT r, c, CAST(z AS DOUBLE) AS z FROM px WHERE c < 40 UNION ALL SELECT r, c, CAST(CASE WHEN r % 9 = 0 AND c = 33 THEN z + 1 ELSE z END AS DOUBLE) FROM px WHERE c >= 30) SELECT r AS "row", c AS col, min(z) AS z, (min(z) IS DISTINCT FROM max(z)) OR (count(z) > 0 AND count(z) < count(*)) AS conflict FROM u GROUP BY r, c',
        "j22_owner_resolution": f"WITH {SHIFTED} SELECT 'c' || a.tile AS cell, count(b.tile) AS n, CASE WHEN count(b.tile) = 1 THEN min(b.tile) END AS tile FROM tiles a LEFT JOIN (SELECT * FROM sh WHERE tile <> 't1_2') b ON {touch} GROUP BY a.tile",
        "j24_covered_cells": f"WITH {SHIFTED} SELECT DISTINCT x, y FROM sh, range(-20, 20) a(x), range(-20, 20) b(y) WHERE x * 5.0 < rt AND l < (x + 1) * 5.0 AND y * 5.0 < tp AND b < (y + 1) * 5.0".replace("b(y)", "bb(y)"),
        "a28_area_union": f"WITH {SHIFTED}, cc AS (SELECT DISTINCT x, y FROM sh, range(-100, 120) a(x), range(-120, 60) bb(y) WHERE x < rt * 2 + 3 AND l * 2 - 3 < x + 1 AND y < tp * 2 + 3 AND b * 2 - 3 < y + 1) SELECT y, count(*) AS cells FROM cc GROUP BY y",
        "a30_lattice_pitch": f"WITH {TILES} SELECT CAST({T} AS BIGINT) AS pitch",
        "j25_pixels_in_polygons": f'WITH {PX}, {_edges_sql()}, pp AS (SELECT r, c, (c + 0.5) * 0.5 AS x, -(r + 0.5) * 0.5 AS y FROM px) SELECT r AS "row", c AS col, polygon FROM pp JOIN edge ON (y1 <= y) <> (y2 <= y) AND x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x GROUP BY r, c, polygon HAVING count(*) % 2 = 1',
        "o1_owner_order": f"WITH {TILES} SELECT tile, ty * {N // T} + tx AS number FROM tiles",
        "p5_missing_literal": "SELECT l_linenumber, count(*) FILTER (WHERE l_partkey % 10 < 4) AS literal, count(*) FILTER (WHERE l_partkey % 10 IN (0, 1, 3)) AS declared FROM lineitem GROUP BY 1",
        "p8_shore_low_high": f'WITH {GAPPY}, {SHORE} SELECT r AS "row", c AS col, low FROM shore',
        "j17_neighbour_missing": f'WITH {GAPPY} SELECT DISTINCT g.r AS "row", g.c AS col FROM g, {BESIDE}, g m WHERE m.r = g.r + dr AND m.c = g.c + dc AND g.z IS NOT NULL AND m.z IS NULL',
        "j18_eight_neighbours": f'WITH {GAPPY} SELECT DISTINCT g.r AS "row", g.c AS col FROM g, {EIGHT}, g m WHERE m.r = g.r + dr AND m.c = g.c + dc AND g.z IS NOT NULL AND m.z IS NULL',
        "g1_components": f'{ROOTS} SELECT u // {N} AS "row", u % {N} AS col, k // {N} AS root_row, k % {N} AS root_col, open FROM root',
        "j15_nearest_shore": f'WITH {GAPPY}, {SHORE}, m AS (SELECT r, c FROM g WHERE z IS NULL) SELECT m.r AS "row", m.c AS col, round(sqrt(min((m.r - s.r) * (m.r - s.r) + (m.c - s.c) * (m.c - s.c))), 6) AS d FROM m LEFT JOIN (SELECT * FROM shore WHERE low) s ON (m.r - s.r) * (m.r - s.r) + (m.c - s.c) * (m.c - s.c) <= 36 GROUP BY m.r, m.c',
        "a11_surface_counts": f"{VIEW} SELECT t.tile, s.surface, count(v.r) AS pixels FROM (SELECT DISTINCT tile FROM view) t CROSS JOIN (VALUES (0), (1), (2), (3), (4), (255)) s(surface) LEFT JOIN view v ON v.tile = t.tile AND v.surface = s.surface GROUP BY ALL",
        "a12_territory_totals": f"{VIEW} SELECT surface, count(*) AS pixels, sum(count(*)) OVER () = {N * N} AS whole FROM view GROUP BY surface",
        "g4_fill": f'{VIEW} SELECT r AS "row", c AS col, CASE WHEN surface IN (1, 2) THEN {PROFILE.sea_m} WHEN surface = 0 THEN CAST(z AS DOUBLE) END AS z, surface FROM view',
        "g12_sensitivity": " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {GAPPY}, {REACH}, {surface(catalog.fill.Profile(PROFILE.sea_m, m, PROFILE.max_shore_m, p, PROFILE.exclusions))} SELECT CAST({m} AS DOUBLE) AS margin, CAST({p} AS DOUBLE) AS preference, count(*) FILTER (WHERE surface IN (1, 2)) AS water FROM view)" for m in (0.25, 1.0) for p in (0.0, 1.0)),
        "a18_component_stats": f"{ROOTS} SELECT count(*) AS pixels, min(u // {N}) AS row_min, max(u // {N}) AS row_max, min(u % {N}) AS col_min, max(u % {N}) AS col_max, count(DISTINCT (u // {N} // {T}) * 100 + u % {N} // {T}) AS tiles FROM root GROUP BY k HAVING count(*) >= 5",
        "a19_enclosed_shores": f"{ROOTS}, rim AS (SELECT DISTINCT k, o.r, o.c, o.z FROM root, {BESIDE}, g o WHERE NOT open AND o.r = u // {N} + dr AND o.c = u % {N} + dc AND o.z IS NOT NULL) SELECT k // {N} AS root_row, k % {N} AS root_col, count(*) AS shore_pixels, round(quantile_cont(CAST(z AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(CAST(z AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(z AS DOUBLE), 0.9), 6) AS p90 FROM rim GROUP BY k",
        "a20_ingest_percentiles": f"WITH {GAPPY} SELECT count(z) AS valid, count(*) - count(z) AS missing, min(CAST(z AS DOUBLE)) AS lowest, max(CAST(z AS DOUBLE)) AS highest, round(quantile_cont(CAST(z AS DOUBLE), 0.01), 6) AS p1, round(quantile_cont(CAST(z AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(z AS DOUBLE), 0.99), 6) AS p99, count(*) FILTER (WHERE z < {PROFILE.sea_m}) AS below, round(count(*) FILTER (WHERE z < {PROFILE.sea_m}) / count(z), 6) AS below_share, count(*) FILTER (WHERE z < {PROFILE.sea_m}) > 0 AS fill_above_ground FROM g",
        "a16_map_agreement": f"{VIEW}, x AS (SELECT surface, (r + c) % 3 <> 0 AS sea, r % 4 = 0 AS land, c < 50 AS inside FROM view) SELECT count(*) FILTER (WHERE surface IN (1, 2)) AS water_pixels, count(*) FILTER (WHERE surface IN (1, 2) AND sea AND NOT land) AS water_in_mapped_sea, count(*) FILTER (WHERE surface BETWEEN 1 AND 4 AND sea AND NOT land) AS mapped_sea_missing, count(*) FILTER (WHERE surface IN (1, 2) AND land) AS false_water, count(*) FILTER (WHERE surface = 3 AND sea AND NOT land) AS missed_sea_3, count(*) FILTER (WHERE surface = 4 AND sea AND NOT land) AS missed_sea_4, count(*) FILTER (WHERE surface = 3 AND sea) AS class_3_in_sea, count(*) FILTER (WHERE surface IN (1, 2) AND NOT (sea OR land) AND NOT inside) AS water_outside_coverage, count(*) FILTER (WHERE surface IN (1, 2) AND NOT (sea OR land) AND inside) AS water_unmapped_inside, count(*) FILTER (WHERE surface IN (1, 2) AND NOT (sea OR land)) AS water_unmapped FROM x",
        "a31_permille": f"{VIEW} SELECT tile, CAST(floor(count(*) FILTER (WHERE surface = 0) * 1000 / count(*) + 0.5) AS BIGINT) AS land, CAST(floor(count(*) FILTER (WHERE surface IN (1, 2)) * 1000 / count(*) + 0.5) AS BIGINT) AS water FROM view GROUP BY tile",
        "f10_dependency_codes": f'{IMPACT} SELECT r AS "row", c AS col, surface, code, grp FROM dep',
        "a8_transitions": f"{IMPACT} SELECT 1 AS frame, raw_shade, raw_quality, shade, quality, count(*) AS pixels FROM two WHERE surface = 0 GROUP BY ALL",
        "a9_dependency_hist": f"{IMPACT} SELECT frame, grp, code, pixels FROM dh",
        "a10_fill_share": f"{IMPACT} SELECT frame, CAST(sum(pixels) AS BIGINT) AS land, CAST(sum(CASE WHEN code IN (1, 2, 3) THEN pixels ELSE 0 END) AS BIGINT) AS dependent, round(coalesce(sum(CASE WHEN code IN (1, 2, 3) THEN pixels ELSE 0 END) / nullif(sum(pixels), 0), 0), 6) AS share FROM dh WHERE grp = 'land' GROUP BY frame",
        "j14_blocker_class": f"{IMPACT}, bl AS (SELECT r, c, blocker, r + CAST(round_even(r % 2 - cos(radians(115.0)) * CAST(blocker AS DOUBLE) / 0.5, 0) AS BIGINT) - r % 2 AS br, c + CAST(round_even(c % 2 + sin(radians(115.0)) * CAST(blocker AS DOUBLE) / 0.5, 0) AS BIGINT) - c % 2 AS bc FROM two WHERE blocker > 0) SELECT coalesce(v.surface, 255) AS blocker_surface, count(*) AS pixels, sum(CAST(bl.blocker AS DOUBLE)) AS distance FROM bl LEFT JOIN view v ON v.r = br AND v.c = bc GROUP BY 1",
        "w3_interval_merge": f"WITH {MERGED} SELECT band, s, e FROM mg",
        "a28_interval_cover": f"WITH {MERGED} SELECT band, CAST(sum(e - s) AS BIGINT) AS covered FROM mg GROUP BY band",
        "w4_prefix_max": f'WITH {PX} SELECT c AS col, r AS "row", CAST(z AS DOUBLE) AS z, CAST(max(z) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS highest_before FROM px',
        "w6_nearest_time": f"WITH e AS (SELECT CAST(ts AS DATE) AS day, event_id, {SECOND} AS s FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY abs(s - 52200), event_id) AS k FROM e) SELECT CAST(day AS VARCHAR) AS day, s, event_id FROM n WHERE k = 1",
        "w7_attempts": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3 AS allowed FROM events",
        "w9_core_numbering": f'WITH {PX} SELECT r AS "row", c AS col, r * {N} + c AS number FROM px',
        "w11_neighbour_frames": f"WITH {FRAMES} SELECT frame, lag(frame) OVER (PARTITION BY CAST(utc AS DATE) ORDER BY frame) AS previous, lead(frame) OVER (PARTITION BY CAST(utc AS DATE) ORDER BY frame) AS following FROM frames",
        "o3_first_ready": f"WITH {READY} SELECT min(task) AS task FROM rd",
        "o4_first_k": f'WITH {PX}, n AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY z DESC, r, c) AS k FROM px WHERE z IS NOT NULL) SELECT tile, r AS "row", c AS col, CAST(z AS DOUBLE) AS z FROM n WHERE k <= 3',
        "o5_stratified_sample": f"WITH {PX}, n AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY md5('17|' || r || '|' || c), r, c) AS k FROM px) SELECT tile, r AS \"row\", c AS col FROM n WHERE k <= 5",
        "o9_decimation": f'WITH {PX} SELECT r AS "row", c AS col, CAST(z AS DOUBLE) AS z FROM px WHERE r % 4 = 0 AND c % 4 = 0',
        "a27_task_states": f"WITH {TASKS} SELECT state, count(*) AS n FROM tk GROUP BY state",
        "j20_ready_tasks": f"WITH {READY} SELECT task FROM rd",
        "t2_illegal_moves": "WITH x AS (SELECT event_id, user_id AS task, ts, ['queued', 'running', 'succeeded', 'failed', 'cancelled'][event_id * 7 % 5 + 1] AS state FROM events), y AS (SELECT *, lag(state) OVER (PARTITION BY task ORDER BY ts, event_id) AS was FROM x) SELECT event_id, task, was, state FROM y WHERE was IS NOT NULL AND (was, state) NOT IN (('queued', 'running'), ('queued', 'cancelled'), ('running', 'succeeded'), ('running', 'failed'), ('running', 'queued'), ('running', 'cancelled'), ('failed', 'queued'), ('succeeded', 'queued'), ('cancelled', 'queued'))",
        "t4_invalidated": f"WITH RECURSIVE {TASKS}, inv(task) AS (SELECT task FROM tk WHERE task IN (13, 50, 77) UNION SELECT ed.task FROM ed JOIN inv ON ed.needs = inv.task) SELECT task FROM inv",
        "u1_union_layers": f"WITH {PX} SELECT tile, count(*) AS n FROM px GROUP BY tile",
        "u2_missing_extra": "WITH e AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_partkey % 2 = 0) SELECT k, 'missing' AS side FROM (SELECT k FROM e EXCEPT SELECT k FROM a) UNION ALL SELECT k, 'extra' FROM (SELECT k FROM a EXCEPT SELECT k FROM e)",
        "u3_intersect": f'WITH {PX} SELECT r AS "row" FROM px WHERE z > 15 INTERSECT SELECT r FROM px WHERE z < 1',
        "u4_distinct_days": "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(hour(ts) AS INT) AS hour FROM events",
        "u7_complete_rectangle": f"WITH {TILES} SELECT i // {N // T} AS ty, i % {N // T} AS tx FROM range({(N // T) ** 2}) t(i) EXCEPT SELECT ty, tx FROM tiles",
        "a29_cost": "SELECT round(sum(l_linenumber) * 10.0 / 0.625, 3) AS horizon_s, round(sum(CAST(l_quantity AS BIGINT)) * 0.25 / 0.625, 3) AS frame_s, round(sum(l_suppkey % 2) * 0.03125 / 0.625, 3) AS hit_s, round(sum(l_linenumber) * 10.0 / 0.625 + sum(CAST(l_quantity AS BIGINT)) * 0.25 / 0.625 + sum(l_suppkey % 2) * 0.03125 / 0.625, 3) AS total_s FROM lineitem",
        "a29_estimator_errors": "WITH x AS (SELECT 100 * abs(l_extendedprice - l_extendedprice * (1 - l_discount)) / nullif(l_extendedprice * (1 - l_discount), 0) AS e FROM lineitem) SELECT round(quantile_cont(e, 0.5), 4) AS median_pct, round(max(e), 4) AS max_pct FROM x",
        "f13_grid": f"WITH {_grid_sql()}",
        "f13_grid_back": "SELECT c_custkey, round(22.2 + (c_custkey % 400) / 1000.0, 5) AS lat, round(113.9 + (c_custkey * 7 % 500) / 1000.0, 5) AS lon FROM customer",
        "f11_snap": f"WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 7 - 1000 AS l, l_quantity / 3 - 9 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, {snap_down('l')} AS \"left\", {snap_down('b')} AS bottom, {snap_up('l + 3.3')} AS \"right\", {snap_up('b + 2.2')} AS top FROM x",
        "f15_coordinates": "SELECT c_custkey, round(CASE c_custkey % 4 WHEN 0 THEN -(c_custkey % 90 + 30 / 60.0 + 18.5 / 3600) WHEN 1 THEN c_custkey % 90 + 0.5 WHEN 2 THEN NULL ELSE CAST(-(c_custkey % 180) AS DOUBLE) END, 6) AS degrees FROM customer",
        "f16_addresses": "WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice - 30000 AS e, 20000 - l_extendedprice AS n FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(floor(e / 750.0) AS BIGINT) AS cx, CAST(floor(n / 600.0) AS BIGINT) AS cy, (CAST(floor(e) AS BIGINT) % 2 + 2) % 2 AS parity FROM x",
        "f17_names": f"WITH {TILES}, {FRAMES} SELECT frame, strftime(utc, '%Y%m%d') AS day, strftime(utc, '%H%M') AS hhmm, 'e' || CAST(l AS INT) || 'n' || CAST(b AS INT) AS cell FROM frames CROSS JOIN tiles",
        "f18_identity": "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS id FROM nation",
        "f19_safe_paths": "SELECT p_partkey, p_partkey % 5 = 4 AS safe FROM part",
        "f20_array_functions": f"WITH {PX}, x AS (SELECT tile, list_sort(list(DISTINCT r)) AS rows_ FROM px GROUP BY tile) SELECT tile, CAST(len(rows_) AS BIGINT) AS n, rows_[1] AS \"first\", rows_[-1] AS \"last\", CAST(len(list_filter(rows_, lambda q: q % 2 = 0)) AS BIGINT) AS even FROM x",
        "f21_count_maps": "SELECT l_returnflag, count(*) FILTER (WHERE l_linenumber = 1) AS n1, count(*) FILTER (WHERE l_linenumber = 4) AS n4, count(*) FILTER (WHERE l_linenumber = 9) AS n9 FROM lineitem GROUP BY l_returnflag",
        "f22_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS no_other FROM events",
        "j10_direction_equi_join": f"WITH {PX}, {SUN}, {NEEDED}, pt AS MATERIALIZED (SELECT px.* FROM px JOIN tiles USING (tile)), target AS (SELECT pt.*, direction FROM pt JOIN needed USING (tile)), {offsets('needed')}, {rays('h', 'target', 'pt', own=True)}, hh AS (SELECT h.*, pt.tile FROM h JOIN pt USING (r, c)) SELECT s.frame, count(*) AS pixels, count(*) FILTER (WHERE hh.horizon > CAST(s.apparent AS FLOAT)) AS below FROM sun s JOIN hh ON hh.tile = s.tile AND hh.direction = s.direction WHERE s.apparent > 0 GROUP BY s.frame",
        "j29_interval_join": "WITH o AS (SELECT o_orderkey, dayofyear(o_orderdate) % 30 AS d0 FROM orders), e AS (SELECT dayofmonth(ts) AS d, count(*) AS n FROM events GROUP BY 1) SELECT o_orderkey, CAST(sum(n) AS BIGINT) AS events FROM o JOIN e ON d BETWEEN d0 AND d0 + 6 GROUP BY o_orderkey",
        "j13_explained_losses": f"""{IMPACT}, bl AS (SELECT r, c, r + CAST(round_even(r % 2 - cos(radians(115.0)) * CAST(blocker AS DOUBLE) / 0.5, 0) AS BIGINT) - r % 2 AS br, c + CAST(round_even(c % 2 + sin(radians(115.0)) * CAST(blocker AS DOUBLE) / 0.5, 0) AS BIGINT) - c % 2 AS bc FROM two WHERE blocker > 0),
x AS (SELECT t.shade, a.z, a.horizon, t.blocker, coalesce(v.surface, 255) AS bs, degrees(atan(CAST(CAST({PROFILE.sea_m} AS FLOAT) - a.z AS DOUBLE) / greatest(CAST(t.blocker AS DOUBLE), 0.25))) AS ang FROM two t JOIN runa a USING (r, c) LEFT JOIN bl ON bl.r = t.r AND bl.c = t.c LEFT JOIN view v ON v.r = br AND v.c = bc WHERE t.surface = 0 AND t.raw_shade = 0 AND t.quality IN (0, 3))
SELECT CASE WHEN shade = 0 THEN 'raised_threshold' WHEN bs BETWEEN 1 AND 4 AND blocker > 0 AND shade = 1 AND ang > 30 AND abs(ang - horizon) <= 1e-4 THEN 'filled_blocker' ELSE 'unexplained' END AS cause, count(*) AS pixels FROM x GROUP BY 1""",
        "a22_equality_neighbourhood": f"{FINE} SELECT direction, count(*) FILTER (WHERE abs(CAST(horizon AS DOUBLE) - 80.0) <= 1.0) AS near, count(*) AS n FROM h GROUP BY direction",
        "a25_chunk_equality": "SELECT CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, CAST(0 AS BIGINT) AS slope_beyond, CAST(0 AS BIGINT) AS support_beyond, CAST(0 AS BIGINT) AS blocker_beyond",
        "a35_unique_items": "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey % 20) < count(*) AS twice FROM lineitem GROUP BY 1",
        "s9_sheet_check": "SELECT * FROM (VALUES ('t0_0.tif', 'missing'), ('t0_1.tif', 'extra'), ('t1_0.tif', 'bytes'), ('t2_2.tif', 'hash')) v(name, problem)",
        "u5_subset": "SELECT count(*) AS missing, count(*) = 0 AS subset FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 500 <> 7)",
        "u8_listing_difference": "SELECT p_brand, p_size FROM part EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_partkey % 3 <> 0",
        "k10_two_row_shapes": f"{IMPACT} SELECT frame, grp, code, pixels, CAST(NULL AS INT) AS raw_shade, CAST(NULL AS INT) AS raw_quality, CAST(NULL AS INT) AS shade, CAST(NULL AS INT) AS quality FROM dh UNION ALL SELECT 1, NULL, NULL, count(*), raw_shade, raw_quality, shade, quality FROM two WHERE surface = 0 GROUP BY raw_shade, raw_quality, shade, quality",
        "p10_time_filter": f"WITH {FRAMES} SELECT q.hhmm, f.frame FROM (VALUES ('0300'), ('1200'), ('1215')) q(hhmm) LEFT JOIN frames f ON strftime(utc, '%H%M') = q.hhmm",
        "p7_exclusions": f'WITH {PX} SELECT r AS "row", c AS col FROM px WHERE (c + 0.5) * 0.5 BETWEEN {PROFILE.exclusions[0][0]} AND {PROFILE.exclusions[0][2]} AND -(r + 0.5) * 0.5 BETWEEN {PROFILE.exclusions[0][1]} AND {PROFILE.exclusions[0][3]}',
        "j31_blocked_exceptions": f"WITH {TILES} SELECT b.tile FROM tiles a JOIN tiles b ON a.tile = 't1_1' AND a.l - 2 < b.rt AND b.l < a.rt + 2 AND a.b - 2 < b.tp AND b.b < a.tp + 2",
        "a13_recount": f"{LABELS} SELECT frame, surface, shade, quality, CAST(pixels + 1 AS BIGINT) AS published, pixels AS counted FROM combo WHERE frame % 300 = 7 AND quality = 4",
        "f2_daylight": f"{DAYLIGHT} SELECT CAST(day AS VARCHAR) AS day, round(sunrise, 3) AS sunrise, round(sunset, 3) AS sunset FROM up",
        "s1_catalogue": f"WITH {gap_tiles} SELECT tile || '.tif' AS name, CAST(c1 - c0 AS INT) AS width, CAST(r1 - r0 AS INT) AS height, c0 / 2.0 AS \"left\", -r1 / 2.0 AS bottom, c1 / 2.0 AS \"right\", -r0 / 2.0 AS top, CAST(-9999 AS DOUBLE) AS nodata, CAST(2326 AS INT) AS epsg, CAST(NULL AS VARCHAR) AS why FROM files",
        "s2_refreshed_catalogue": f"WITH {gap_tiles} SELECT tile || '.tif' AS name, tile <> 't1_1' AS known FROM files",
        "s5_pixels_of_files": f'WITH {gap_tiles} SELECT tile, r AS "row", c AS col, CAST(z AS DOUBLE) AS z FROM g WHERE tile IN (SELECT tile FROM files WHERE c0 / 2.0 < 13 AND c1 / 2.0 > 4.5 AND -r1 / 2.0 < -3 AND -r0 / 2.0 > -11.5)',
        "s7_cells": f"WITH {gap_tiles}, have AS (SELECT c0 // 16 AS cx, -r1 // 16 AS cy, tile FROM files) SELECT cx, cy, tile NOT IN ('t1_1', 't2_0') AS file, CASE WHEN tile NOT IN ('t1_1', 't2_0') THEN false END AS shifted, CASE WHEN tile NOT IN ('t1_1', 't2_0') THEN CAST(-100 AS DOUBLE) END AS d_left, CASE WHEN tile NOT IN ('t1_1', 't2_0') THEN CAST(100 AS DOUBLE) END AS d_top FROM have",
        "k15_ingest": f"WITH {gap_tiles} SELECT (r // 10) || '_' || (c // 24) AS cell, count(*) AS pixels, count(z) AS heights, sum(CAST(z AS DOUBLE)) AS total FROM g WHERE supplied GROUP BY 1",
        "k16_view": f"WITH RECURSIVE {FILES_VIEW} SELECT surface, count(*) AS pixels, sum(CASE WHEN surface IN (1, 2) THEN {PROFILE.sea_m} WHEN surface = 0 THEN CAST(z AS DOUBLE) END) AS total FROM view GROUP BY surface",
        "s13_view_window": f'WITH RECURSIVE {FILES_VIEW}, w AS (SELECT 40 + i // 40 AS r, 30 + i % 40 AS c FROM range(1600) t(i)) SELECT w.r AS "row", w.c AS col, CAST(coalesce(surface, 255) AS INT) AS surface FROM w LEFT JOIN view USING (r, c)',
        "k8_publication": f"{labels_of_files}, {rolled(GROUP + ' AS grp')} SELECT frame, grp, pixels, sunlit, shaded, uncertain FROM roll",
        "j23_city": "WITH s AS (SELECT c_custkey, 22.2 + (c_custkey % 400) / 1000.0 AS lat, 113.9 + (c_custkey * 7 % 500) / 1000.0 AS lon FROM customer), c(city, l, b, r, t) AS (VALUES ('east', 114.2, 22.0, 114.3, 22.5), ('west', 113.9, 22.0, 114.1, 22.5), ('north', 114.25, 22.4, 114.5, 22.9)) SELECT c_custkey, count(city) AS n, CASE WHEN count(city) = 1 THEN min(city) END AS city FROM s LEFT JOIN c ON lon BETWEEN l AND r AND lat BETWEEN b AND t GROUP BY c_custkey",
        "f14_centres": f"WITH {TILES} SELECT tile, round((l + rt) * 50 + 836000.0, 2) AS east, round((b + tp) * 50 + 818000.0, 2) AS north FROM tiles",
        "p3_point_in_tile": f"WITH {TILES}, {PLACES} SELECT c_custkey, tile FROM pl LEFT JOIN tiles ON x >= l AND x < rt AND y > b AND y <= tp",
        "p19_pixel_hit": f'WITH {PLACES} SELECT c_custkey, CAST(floor((-8.0 - y) / 0.5) AS BIGINT) AS "row", CAST(floor((x - 8.0) / 0.5) AS BIGINT) AS col FROM pl WHERE x >= 8 AND x < 16 AND y >= -16 AND y < -8',
        "f3_daylight_samples": f"{DAYLIGHT}, q AS (SELECT day, i, epoch(day + i * INTERVAL 15 MINUTE) AS t FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE ts IS NOT NULL), range(96) x(i)) SELECT CAST(day AS VARCHAR) AS day, count(*) AS samples, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last FROM q JOIN up USING (day) WHERE t BETWEEN sunrise AND sunset GROUP BY day",
        "w8_date_groups": f"WITH RECURSIVE {FRAMES}, d AS MATERIALIZED (SELECT CAST(utc AS DATE) AS day, count(*) AS n, row_number() OVER (ORDER BY CAST(utc AS DATE)) AS i FROM frames GROUP BY 1), w(i, day, number, used) AS (SELECT i, day, 1, n FROM d WHERE i = 1 UNION ALL SELECT d.i, d.day, number + CASE WHEN used + n > 100 THEN 1 ELSE 0 END, CASE WHEN used + n > 100 THEN n ELSE used + n END FROM w JOIN d ON d.i = w.i + 1) SELECT CAST(day AS VARCHAR) AS day, CAST(number AS INT) AS number FROM w",
        "a21_shore_gate": f"WITH {GAPPY}, {SHORE} SELECT count(*) AS n, {', '.join(f'round(quantile_cont(CAST(z AS DOUBLE), {q / 100}), 6) AS p{q}' for q in (5, 25, 50, 75, 95))}, quantile_cont(CAST(z AS DOUBLE), 0.5) BETWEEN 1.3 AND 4.0 AS accepted FROM shore",
        "g7_window_horizons": f'{FINE} SELECT r AS "row", c AS col, direction, round(slope, 6) AS slope, support, CAST(blocker AS DOUBLE) AS blocker FROM h WHERE r BETWEEN 18 AND 26 AND c BETWEEN 27 AND 37',
        "j8_rotated_strip": _strip(),
        "s21_vector_scan": f"{_kites()} SELECT CAST(k AS VARCHAR) AS id, code, CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS parts, CAST(4 + CASE WHEN rad > 3 THEN 4 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 4 ELSE 0 END AS BIGINT) AS edges, round(2 * rad * rad - CASE WHEN rad > 3 THEN 1.125 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END, 6) AS area FROM n",
        "j26_clipped_areas": _clipped(),
        "g14_mapped_fill": f'WITH {GAPPY}, {_edges_sql()}, pp AS (SELECT r, c, (c + 0.5) * 0.5 AS x, -(r + 0.5) * 0.5 AS y FROM g WHERE z IS NULL), ins AS (SELECT r, c, polygon FROM pp JOIN edge ON (y1 <= y) <> (y2 <= y) AND x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x GROUP BY r, c, polygon HAVING count(*) % 2 = 1), wet AS (SELECT r, c FROM ins GROUP BY r, c HAVING bool_and(polygon = \'outer\')) SELECT g.r AS "row", g.c AS col, round(CAST(CASE WHEN wet.r IS NOT NULL THEN CAST(1.6 AS FLOAT) ELSE z END AS DOUBLE), 6) AS z, CAST(CASE WHEN wet.r IS NOT NULL THEN 1 WHEN z IS NULL THEN 255 ELSE 0 END AS INT) AS surface FROM g LEFT JOIN wet ON g.r = wet.r AND g.c = wet.c',
        "l9_ray_audit": f"{FINE}, smp AS (SELECT r, c FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY md5('29|' || r || '|' || c), r, c) AS i FROM px WHERE z IS NOT NULL) WHERE i <= 3) SELECT count(*) AS rays, round(sum(round(CAST(horizon AS DOUBLE), 4)), 4) AS horizon_sum, {', '.join(f'CAST(0 AS BIGINT) AS {x}' for x in ('only_a', 'only_b', 'horizon_beyond', 'support_beyond', 'blocker_beyond'))} FROM h JOIN smp USING (r, c)",
        "o2_identity": "SELECT * FROM (VALUES ('order', true), ('folder', true), ('height', false), ('namespace', false)) v(changed, same)",
        "s15_required_batches": f"WITH {PX}, {SHIFTED}, m AS (SELECT sh.tile, avg(CAST(z AS DOUBLE)) AS a FROM px JOIN sh ON (c + 0.5) * 0.5 >= l AND (c + 0.5) * 0.5 < rt AND -(r + 0.5) * 0.5 > b AND -(r + 0.5) * 0.5 <= tp GROUP BY sh.tile) SELECT sh.tile, coalesce(a >= 11, false) AS there FROM sh LEFT JOIN m USING (tile) WHERE l < 19 AND rt > 5 AND b < -3 AND tp > -21",
        "s15_batch_window": f'WITH {PX}, {SHIFTED}, w AS (SELECT r, c, z, (c + 0.5) * 0.5 AS x, -(r + 0.5) * 0.5 AS y FROM px) SELECT r AS "row", c AS col, CAST(z AS DOUBLE) AS z FROM w WHERE x BETWEEN 5 AND 19 AND y BETWEEN -21 AND -3 AND EXISTS (SELECT 1 FROM sh WHERE x >= l AND x < rt AND y > b AND y <= tp)',
        "s16_cache_check": "SELECT * FROM (VALUES ('t1_1', CAST(45 AS DOUBLE), 'rows'), ('t2_0', CAST(215 AS DOUBLE), 'range')) v(tile, direction, problem)",
        "t7_resumed_run": f"{labels_of_files} SELECT frame, shade, quality, CAST(sum(pixels) AS BIGINT) AS pixels FROM combo GROUP BY ALL",
        "l5_views": "SELECT CAST(o_orderkey AS VARCHAR) AS result, 'views/v' || (o_custkey % 7) AS view FROM orders WHERE o_custkey % 7 < 5",
        "j21_solar_by_source": f"WITH {SUN} SELECT tile, count(*) FILTER (WHERE tile NOT LIKE '%\\_3' ESCAPE '\\') AS frames, count(*) FILTER (WHERE tile = 't1_1' AND hour(utc) = 12) AS conflicts, CASE WHEN tile NOT LIKE '%\\_3' ESCAPE '\\' THEN round(max(apparent), 6) END AS highest FROM sun GROUP BY tile",
        "a17_scope_ratios": f"{VIEW}, t AS (SELECT tile, count(*) FILTER (WHERE surface = 0) AS observed, count(*) FILTER (WHERE surface IN (1, 2)) AS water, count(*) FILTER (WHERE surface = 2) AS synthetic, count(*) FILTER (WHERE surface = 3) AS enclosed, count(*) FILTER (WHERE surface = 4) AS open, count(*) FILTER (WHERE surface > 0) AS missing FROM view GROUP BY tile) SELECT *, round(water / nullif(missing, 0), 6) AS water_share, round(synthetic / nullif(water, 0), 6) AS synthetic_share FROM t UNION ALL SELECT 'known ' || tile, observed, 0, 0, 0, 0, 0, NULL, NULL FROM t WHERE observed > 0",
    }
    return out
