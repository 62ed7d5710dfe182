"""SQL for queries whose operators sweep: what they find on paths and on the small grid follows from windows, nearest lower vertices and recursion."""

from __future__ import annotations

#: Users' events as paths. r is a vertex's place by value, then id; a and b are its neighbours' places.
_EVENTS = "p AS (SELECT user_id AS ds, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS vid, CAST(value AS DOUBLE) AS value, event_type FROM events)"
_DAYS = """m AS (SELECT CAST(day(ts) - 1 AS BIGINT) AS ds, CAST(hour(ts) AS BIGINT) AS vid, round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
p AS (SELECT d.ds, h.i AS vid, coalesce(m.value, 0) AS value FROM (SELECT DISTINCT ds FROM m) d CROSS JOIN range(24) h(i) LEFT JOIN m ON m.ds = d.ds AND m.vid = h.i)"""
_ORDER = """o AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY value, vid) AS r, count(*) OVER (PARTITION BY ds) AS n FROM p),
q AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM o WINDOW w AS (PARTITION BY ds ORDER BY vid)),
k AS (SELECT *, (a IS NULL OR a > r) AND (b IS NULL OR b > r) AS low, (a IS NULL OR a < r) AND (b IS NULL OR b < r) AS high FROM q)"""


def _sided(side: str, rank: str, kind: str) -> str:
    """(ds, vid, d) of extrema but the last one: d is the place where each meets one that is beyond it, on the way to the nearer of those on either side."""
    return f"""{side}0 AS (SELECT m.ds, m.vid, max(x.vid) FILTER (x.vid < m.vid AND {rank('x')} < {rank('m')}) AS l, min(x.vid) FILTER (x.vid > m.vid AND {rank('x')} < {rank('m')}) AS h FROM k m JOIN k x ON m.ds = x.ds WHERE m.{kind} AND {rank('m')} > 1 GROUP BY m.ds, m.vid),
{side} AS (SELECT j.ds, j.vid, least(max({rank('x')}) FILTER (x.vid > j.l AND x.vid < j.vid), max({rank('x')}) FILTER (x.vid > j.vid AND x.vid < j.h)) AS d FROM {side}0 j JOIN k x ON j.ds = x.ds GROUP BY j.ds, j.vid)"""


def _diagram(source: str) -> str:
    up, down = (lambda t: f"{t}.r"), (lambda t: f"({t}.n + 1 - {t}.r)")
    pairs = f"{_sided('lows', up, 'low')}, {_sided('highs', down, 'high')}"
    return f"""WITH {source}, {_ORDER}, {pairs},
e AS (SELECT s.ds, s.vid AS bv, x.vid AS dv FROM lows s JOIN k x ON x.ds = s.ds AND x.r = s.d UNION ALL SELECT s.ds, x.vid, s.vid FROM highs s JOIN k x ON x.ds = s.ds AND x.n + 1 - x.r = s.d
  UNION ALL SELECT x.ds, x.vid, y.vid FROM k x JOIN k y ON x.ds = y.ds AND x.r = 1 AND y.r = y.n),
g AS (SELECT e.ds, bv AS birth_vid, dv AS death_vid, 0 AS pair_type, 0 AS birth_type, 3 AS death_type, x.value AS birth, y.value AS death, y.value - x.value AS persistence FROM e JOIN k x ON x.ds = e.ds AND x.vid = bv JOIN k y ON y.ds = e.ds AND y.vid = dv)"""


_PATHS = f"WITH {_EVENTS}, {_ORDER}"
#: Where steepest descent (d = -1 to the left) and ascent lead at first, and the extremum that they end at.
_ENDS = f"""{_PATHS},
f AS (SELECT *, CASE WHEN low THEN 0 WHEN a < r AND (b IS NULL OR b > r OR a < b) THEN -1 ELSE 1 END AS down, CASE WHEN high THEN 0 WHEN a > r AND (b IS NULL OR b < r OR a > b) THEN -1 ELSE 1 END AS up FROM k),
s AS (SELECT v.ds, v.vid, any_value(v.event_type) AS event_type, CASE any_value(v.down) WHEN 0 THEN v.vid WHEN -1 THEN max(x.vid) FILTER (x.low AND x.vid < v.vid) ELSE min(x.vid) FILTER (x.low AND x.vid > v.vid) END AS lo,
  CASE any_value(v.up) WHEN 0 THEN v.vid WHEN -1 THEN max(x.vid) FILTER (x.high AND x.vid < v.vid) ELSE min(x.vid) FILTER (x.high AND x.vid > v.vid) END AS hi FROM f v JOIN k x ON x.ds = v.ds GROUP BY v.ds, v.vid)"""
_NUMBERED = """t AS (SELECT lo, hi, ds, row_number() OVER (PARTITION BY ds ORDER BY min(vid)) - 1 AS g FROM s GROUP BY ds, lo, hi)
SELECT s.ds, s.vid, s.hi AS "DescendingManifold", s.lo AS "AscendingManifold", g AS "MorseSmaleManifold" FROM s JOIN t ON s.ds = t.ds AND s.lo = t.lo AND s.hi = t.hi"""

SQL: dict[str, str] = {
    "persistence_diagram": _diagram(_EVENTS) + " SELECT * FROM g",
    "persistence_curve": _diagram(_EVENTS)
    + """, c AS (SELECT ds, unnest(['all', 'type0']) AS curve, greatest(persistence, 1e-6) AS x FROM g)
SELECT ds, curve, x AS "Persistence", CAST(sum(count(*)) OVER (PARTITION BY ds, curve ORDER BY x DESC) AS BIGINT) AS "NumberOfPairs" FROM c GROUP BY ds, curve, x""",
    "persistence_thresholds": _diagram(_DAYS)
    + """, c AS (SELECT ds, persistence AS x FROM g WHERE persistence > 0), m1 AS (SELECT ds, max(x) AS most FROM c GROUP BY ds)
SELECT 'top' AS mode, ds, least(count(*), 3) AS n FROM c GROUP BY ds UNION ALL SELECT 'absolute', ds, count(*) FROM c WHERE x > 20 GROUP BY ds
UNION ALL SELECT 'relative', c.ds, count(*) FROM c JOIN m1 ON c.ds = m1.ds WHERE x > 0.5::DOUBLE * most GROUP BY c.ds UNION ALL SELECT 'global', ds, count(*) FROM c WHERE x > 0.3::DOUBLE * (SELECT max(x) FROM c) GROUP BY ds""",
    "join_tree": f"""{_PATHS}, j AS (SELECT * FROM k WHERE low OR (high AND a IS NOT NULL AND b IS NOT NULL)),
s AS (SELECT x.ds, x.vid, x.r, x.value, x.n, max_by(y.r, y.vid) FILTER (y.vid < x.vid) AS sl, min_by(y.r, y.vid) FILTER (y.vid > x.vid) AS sr FROM j x LEFT JOIN j y ON y.ds = x.ds AND y.high AND y.r > x.r GROUP BY ALL),
t AS (SELECT ds, vid, r, value, least(sl, sr) AS top, coalesce(least(sl, sr), n) AS u, n FROM s),
w AS (SELECT t.ds, t.vid, max(v.vid) FILTER (v.vid < t.vid AND v.r >= t.top) AS l, min(v.vid) FILTER (v.vid > t.vid AND v.r >= t.top) AS h FROM t JOIN k v ON v.ds = t.ds GROUP BY t.ds, t.vid),
z AS (SELECT t.ds, t.vid, 1 + count(v.vid) FILTER (v.r > t.r AND (w.l IS NULL OR v.vid > w.l) AND (w.h IS NULL OR v.vid < w.h)) AS size FROM t JOIN w ON w.ds = t.ds AND w.vid = t.vid JOIN k v ON v.ds = t.ds GROUP BY t.ds, t.vid)
SELECT t.ds, t.vid AS "SegmentationId", t.vid AS "downNodeId", y.vid AS "upNodeId", z.size AS "RegionSize", y.value - t.value AS "RegionSpan" FROM t JOIN z ON z.ds = t.ds AND z.vid = t.vid JOIN k y ON y.ds = t.ds AND y.r = t.u WHERE t.r < t.n""",
    "split_tree_nodes": f"""{_PATHS} SELECT ds, vid AS "NodeId", vid AS "VertexId", CASE WHEN r = 1 THEN 0 WHEN high THEN 3 ELSE 2 END AS "CriticalType", value AS "Scalar" FROM k WHERE n > 1 AND (r = 1 OR high OR (low AND a IS NOT NULL AND b IS NOT NULL))""",
    "contour_tree": f"""{_PATHS}, c AS (SELECT ds, vid, r, value, lead(vid) OVER w AS v2, lead(r) OVER w AS r2, lead(value) OVER w AS x2 FROM k WHERE low OR high WINDOW w AS (PARTITION BY ds ORDER BY vid))
SELECT ds, CASE WHEN r < r2 THEN vid ELSE v2 END AS "SegmentationId", CASE WHEN r < r2 THEN vid ELSE v2 END AS "downNodeId", CASE WHEN r < r2 THEN v2 ELSE vid END AS "upNodeId", 0 AS "RegionSize", CASE WHEN r < r2 THEN x2 - value ELSE value - x2 END AS "RegionSpan" FROM c WHERE v2 IS NOT NULL""",
    "morse_smale_segmentation": f"{_ENDS}, {_NUMBERED}",
    "integral_lines": f"""{_ENDS} SELECT ds, vid AS seed, i AS step, CASE WHEN lo < vid THEN vid - i ELSE vid + i END AS vid, CAST(i AS DOUBLE) AS "DistanceFromSeed" FROM (SELECT *, unnest(range(0, abs(lo - vid) + 1)) AS i FROM s WHERE event_type = 'purchase')""",
    "topological_compression": f"""WITH {_EVENTS}, s AS (SELECT ds, min(value) AS lo, max(value) AS hi FROM p GROUP BY ds) SELECT p.ds, vid, CAST(floor((value - lo) / greatest((hi - lo) * 10.0::DOUBLE / 50, 1e-300)) AS BIGINT) AS segment FROM p JOIN s ON p.ds = s.ds""",
}


# ---------------------------------------------------------------- the grid of days and hours
_RING = "(VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 0), (4, -1, -1), (5, 0, -1)) s(k, i, j)"
_GRID = f"""m AS (SELECT CAST(hour(ts) + 24 * (day(ts) - 1) AS BIGINT) AS vid, round(avg(value), 6) AS value FROM events GROUP BY 1),
v AS (SELECT i AS vid, coalesce(value, 0) AS value, row_number() OVER (ORDER BY coalesce(value, 0), i) AS r FROM range(744) t(i) LEFT JOIN m ON i = vid),
n AS (SELECT a.vid AS a, b.vid AS b, a.r AS ra, b.r AS rb, s.k FROM v a JOIN {_RING} ON a.vid % 24 + i BETWEEN 0 AND 23 AND a.vid // 24 + j BETWEEN 0 AND 30 JOIN v b ON b.vid = a.vid + i + 24 * j)"""
_MEANS = "SELECT n.a AS vid, avg(x) AS x, avg(y) AS y FROM n JOIN {} t ON t.vid = n.b GROUP BY n.a"

SQL |= {
    "grid_critical_points": f"""WITH {_GRID}, w AS (SELECT x.a, x.k, x.rb < x.ra AS low, y.rb < y.ra AS was FROM n x LEFT JOIN n y ON y.a = x.a AND y.k = (x.k + 5) % 6),
c AS (SELECT a, count(*) FILTER (low) AS lows, count(*) FILTER (NOT low) AS highs, count(*) FILTER (low AND was IS DISTINCT FROM true) AS below, count(*) FILTER (NOT low AND was IS DISTINCT FROM false) AS above, count(*) AS size FROM w GROUP BY a),
t AS (SELECT a, CASE WHEN lows = 0 THEN 0 WHEN highs = 0 THEN 3 WHEN below = 1 AND above = 1 THEN 5 WHEN below <= 2 AND above <= 2 THEN 1 ELSE 4 END AS kind FROM c)
SELECT 0::BIGINT AS ds, vid, value, kind AS "CriticalType", CAST(vid % 24 IN (0, 23) OR vid // 24 IN (0, 30) AS TINYINT) AS "IsOnBoundary" FROM t JOIN v ON vid = a WHERE kind <> 5""",
    "grid_segmentation": f"""WITH RECURSIVE {_GRID}, g AS (SELECT a, min(rb) AS lo, max(rb) AS hi, any_value(ra) AS ra FROM n GROUP BY a),
down(vid, r) AS (SELECT vid, r FROM v UNION ALL SELECT d.vid, g.lo FROM down d JOIN v ON v.r = d.r JOIN g ON g.a = v.vid WHERE g.lo < d.r),
up(vid, r) AS (SELECT vid, r FROM v UNION ALL SELECT d.vid, g.hi FROM up d JOIN v ON v.r = d.r JOIN g ON g.a = v.vid WHERE g.hi > d.r),
s AS (SELECT 0::BIGINT AS ds, x.vid, x.lo, y.hi FROM (SELECT d.vid, min_by(v.vid, d.r) AS lo FROM down d JOIN v ON v.r = d.r GROUP BY d.vid) x JOIN (SELECT d.vid, max_by(v.vid, d.r) AS hi FROM up d JOIN v ON v.r = d.r GROUP BY d.vid) y ON x.vid = y.vid), {_NUMBERED}""",
    "reeb_graph": f"""WITH RECURSIVE {_GRID}, h AS (SELECT vid, least(CAST(floor((value - (SELECT min(value) FROM v)) * 16 / ((SELECT max(value) FROM v) - (SELECT min(value) FROM v))) AS BIGINT), 15) AS slab FROM v),
e AS (SELECT n.a, n.b FROM n JOIN h x ON x.vid = n.a JOIN h y ON y.vid = n.b WHERE x.slab = y.slab), c(vid, o) AS (SELECT vid, vid FROM h UNION SELECT e.b, c.o FROM c JOIN e ON e.a = c.vid),
l AS (SELECT vid, min(o) AS component FROM c GROUP BY vid) SELECT 0::BIGINT AS ds, slab, component, count(*) AS n FROM h JOIN l ON h.vid = l.vid GROUP BY slab, component""",
    "torus_reeb_nodes": """WITH RECURSIVE m AS (SELECT CAST(hour(ts) + 24 * dayofweek(ts) AS BIGINT) AS vid, round(avg(value), 6) AS value FROM events GROUP BY 1),
v AS (SELECT i AS vid, coalesce(value, 0) AS value, row_number() OVER (ORDER BY coalesce(value, 0), i) - 1 AS r FROM range(168) g(i) LEFT JOIN m ON vid = i),
q AS (SELECT i AS a, (i % 24 + 1) % 24 + 24 * (i // 24) AS b, (i % 24 + 1) % 24 + 24 * ((i // 24 + 1) % 7) AS c, i % 24 + 24 * ((i // 24 + 1) % 7) AS d FROM range(168) g(i)),
f AS (SELECT list_sort([x.r, y.r, z.r]) AS p FROM (SELECT a, b, c FROM q UNION ALL SELECT a, d, c FROM q) t JOIN v x ON x.vid = t.a JOIN v y ON y.vid = t.b JOIN v z ON z.vid = t.c),
e AS (SELECT p[1] AS lo, p[2] AS hi FROM f UNION SELECT p[1], p[3] FROM f UNION SELECT p[2], p[3] FROM f),
k AS (SELECT i AS r, lo * 168 + hi AS e FROM e JOIN range(168) g(i) ON lo <= i AND i < hi),
l AS (SELECT i AS r, p[1] * 168 + p[3] AS x, CASE WHEN i < p[2] THEN p[1] * 168 + p[2] ELSE p[2] * 168 + p[3] END AS y FROM f JOIN range(168) g(i) ON p[1] <= i AND i < p[3]),
b AS (SELECT r, x, y FROM l UNION SELECT r, y, x FROM l), w(r, e, o) AS (SELECT r, e, e FROM k UNION SELECT w.r, b.y, w.o FROM w JOIN b ON b.r = w.r AND b.x = w.e),
c AS (SELECT r, e, min(o) AS part FROM w GROUP BY r, e),
t AS (SELECT lo AS r, lo * 168 + hi AS e FROM e UNION SELECT hi, lo * 168 + hi FROM e UNION SELECT p[2], p[1] * 168 + p[3] FROM f),
n AS (SELECT v.vid, v.value, count(DISTINCT x.part) AS down, count(DISTINCT y.part) AS up FROM v JOIN t ON t.r = v.r LEFT JOIN c x ON x.r = v.r - 1 AND x.e = t.e LEFT JOIN c y ON y.r = v.r AND y.e = t.e GROUP BY ALL)
SELECT 0::BIGINT AS ds, vid AS "NodeId", vid AS "VertexId", CASE WHEN down = 0 THEN 0 WHEN up = 0 THEN 3 WHEN down > 1 AND up > 1 THEN 4 WHEN down > 1 THEN 1 ELSE 2 END AS "CriticalType", value AS "Scalar", down, up FROM n WHERE NOT (down = 1 AND up = 1)""",
    "smooth_geometry": f"""WITH {_GRID}, s0 AS (SELECT vid, (vid % 24)::DOUBLE AS x, (vid // 24)::DOUBLE AS y FROM v), s1 AS ({_MEANS.format("s0")}), s2 AS ({_MEANS.format("s1")})
SELECT 0::BIGINT AS ds, vid, round(x, 6) AS x, round(y, 6) AS y, 0.0::DOUBLE AS z FROM s2""",
}


# ---------------------------------------------------------------- points, images, cameras
_POINTS = "c AS (SELECT vec_id AS vid, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z FROM embeddings), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM c)"
_RASTER = f"""{_POINTS}, i0 AS (SELECT least(CAST(floor((x - lx) * 32 / (hx - lx)) AS BIGINT), 31) AS px, least(CAST(floor((y - ly) * 32 / (hy - ly)) AS BIGINT), 31) AS py, (hz - z) / (hz - lz) AS depth, vid FROM c, b),
i1 AS (SELECT px, py, min((depth, vid)) AS n FROM i0 GROUP BY px, py), img AS (SELECT px, py, n[1] AS depth, n[2] AS value FROM i1)"""
_VOLUME = """u AS (SELECT o_orderkey % 384 AS vid, round(avg(o_totalprice), 4) AS u FROM orders GROUP BY 1), w AS (SELECT l_partkey % 384 AS vid, round(avg(l_quantity), 4) AS v FROM lineitem GROUP BY 1),
f AS (SELECT i AS vid, coalesce(u, 0) AS u, coalesce(v, 0) AS v FROM range(384) t(i) LEFT JOIN u ON u.vid = i LEFT JOIN w ON w.vid = i)"""

SQL |= {
    "raster_image": f"WITH {_RASTER} SELECT px, py, value, depth FROM img",
    "depth_geometry": f"""WITH {_RASTER}, t AS (SELECT 2 * (py * 32 + px) + k AS cid, CASE k WHEN 0 THEN [py * 32 + px, py * 32 + px + 1, py * 32 + px + 32] ELSE [py * 32 + px + 1, py * 32 + px + 33, py * 32 + px + 32] END AS pids FROM img, range(2) r(k) WHERE px < 31 AND py < 31),
d AS (SELECT py * 32 + px AS pid, CASE WHEN depth <= 0.98 THEN depth END AS depth FROM img), e AS (SELECT cid, pids, unnest(pids) AS pid FROM t)
SELECT cid, pids, CASE WHEN count(depth) = 3 THEN max(depth) - min(depth) END AS distortion FROM e JOIN d ON e.pid = d.pid GROUP BY cid, pids""",
    "camera_grid": f"""WITH {_POINTS}, s AS (SELECT *, sqrt((hx - lx) ^ 2 + (hy - ly) ^ 2 + (hz - lz) ^ 2) / 2 AS r, (lx + hx) / 2 AS fx, (ly + hy) / 2 AS fy, (lz + hz) / 2 AS fz FROM b)
SELECT CAST(k AS INTEGER) AS camera, round(fx + 2 * r * cos(k * pi() / 4), 6) AS px, round(fy + 2 * r * sin(k * pi() / 4), 6) AS py, round(fz, 6) AS pz, round(fx, 6) AS fx, round(fy, 6) AS fy, round(fz, 6) AS fz, round(r, 6) AS near, round(3 * r, 6) AS far FROM s, range(8) t(k)""",
    "range_polygon": f"""WITH {_VOLUME}, m AS (SELECT avg(u) AS u, avg(v) AS v, stddev_samp(u) AS su, stddev_samp(v) AS sv FROM f),
q AS (SELECT k, u + x * su AS u, v + y * sv AS v FROM m, (VALUES (0, -0.5, -0.5), (1, 0.5, -0.5), (2, 0.0, 0.5)) t(k, x, y))
SELECT a.k AS edge, round(a.u, 3) AS u0, round(a.v, 3) AS v0, round(b.u, 3) AS u1, round(b.v, 3) AS v1 FROM q a JOIN q b ON b.k = (a.k + 1) % 3""",
    "tracking_overlap_branches": """WITH RECURSIVE p AS (SELECT DISTINCT week(ts) AS t, user_id AS x, ascii(event_type) AS label FROM events), s AS (SELECT t, lead(t) OVER (ORDER BY t) AS t2 FROM (SELECT DISTINCT t FROM p)),
z AS (SELECT t, label, count(*) AS size, round(avg(x), 6) AS cx, row_number() OVER (ORDER BY t, label) - 1 AS v FROM p GROUP BY t, label),
e AS (SELECT DISTINCT a.t, s.t2, a.label, b.label AS l2 FROM p a JOIN s ON a.t = s.t JOIN p b ON b.t = s.t2 AND b.x = a.x),
g AS (SELECT a.v AS v1, b.v AS v2, row_number() OVER (PARTITION BY a.v ORDER BY b.size DESC, b.label) AS f, row_number() OVER (PARTITION BY b.v ORDER BY a.size DESC, a.label) AS k FROM e JOIN z a ON a.t = e.t AND a.label = e.label JOIN z b ON b.t = e.t2 AND b.label = e.l2),
h(v, root) AS (SELECT v, v FROM z WHERE v NOT IN (SELECT v2 FROM g WHERE f = 1 AND k = 1) UNION ALL SELECT g.v2, h.root FROM h JOIN g ON g.v1 = h.v AND f = 1 AND k = 1)
SELECT 0::BIGINT AS level, CAST(t AS BIGINT) AS t, CAST(label AS BIGINT) AS label, size AS "Size", cx, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS cz, root AS "BranchId" FROM z JOIN h ON z.v = h.v""",
    "wide_distance_matrix": f"WITH {_DAYS}, x AS (SELECT a.ds AS i, b.ds AS j, round(sum(abs(a.value - b.value)), 6) AS d FROM p a JOIN p b ON a.vid = b.vid GROUP BY 1, 2) SELECT i, " + ", ".join(f'max(d) FILTER (j = {k}) AS "Dataset{k:02d}"' for k in range(30)) + " FROM x GROUP BY i",
}


# ---------------------------------------------------------------- meshes, spheres and files, row by row
_MESH = """v AS (SELECT i AS vid, (i % 24)::DOUBLE AS x, (i // 24)::DOUBLE AS y FROM range(744) t(i)),
e AS (SELECT a.vid AS a, a.vid + d AS b, a.x + (d IN (1, 25))::INT / 2 AS x, a.y + (d IN (24, 25))::INT / 2 AS y FROM v a, (VALUES (1), (24), (25)) s(d) WHERE (d = 24 OR a.x < 23) AND (d = 1 OR a.y < 30)),
t AS (SELECT vid AS a, vid + k AS b, vid + 25 AS c, x + CASE k WHEN 1 THEN 2 ELSE 1 END / 3 AS x, y + CASE k WHEN 1 THEN 1 ELSE 2 END / 3 AS y FROM v, (VALUES (1), (24)) s(k) WHERE x < 23 AND y < 30)"""

SQL |= {
    "barycentric_points": f"WITH {_MESH} SELECT 0 AS parent_dim, x, y FROM v UNION ALL SELECT 1, x, y FROM e UNION ALL SELECT 2, round(x, 6), round(y, 6) FROM t",
    "mesh_subdivision_points": f"WITH {_MESH} SELECT [vid] AS key, x, y FROM v UNION ALL SELECT [a, b], x, y FROM e UNION ALL SELECT [a, b, c], round(x, 6), round(y, 6) FROM t",
    "quad_subdivision_points": f"WITH {_MESH} SELECT x, y FROM v UNION ALL SELECT x, y FROM e WHERE b - a <> 25 UNION ALL SELECT x + 0.5, y + 0.5 FROM v WHERE x < 23 AND y < 30",
    "periodic_neighbours": "SELECT i AS a, (i % 24 + x + 24) % 24 + 24 * ((i // 24 + y + 31) % 31) AS b FROM range(744) t(i), (VALUES (0, 1), (1, 0), (1, 1), (0, -1), (-1, 0), (-1, -1)) s(x, y)",
    "sphere_vertices": f"WITH {_POINTS} SELECT vid * 64 + k AS vid, vid AS point, round(x + 0.01::DOUBLE * sin(p) * cos(t), 6) + 0.0 AS x, round(y + 0.01::DOUBLE * sin(p) * sin(t), 6) + 0.0 AS y, round(z + 0.01::DOUBLE * cos(p), 6) + 0.0 AS z FROM c, (SELECT k, k % 8 * pi() / 4 AS t, (k // 8 + 0.5::DOUBLE) * pi() / 8 AS p FROM range(64) r(k)) g",
    "mesh_graph_points": """WITH e AS (SELECT n_regionkey AS a, n_nationkey AS b, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS id FROM nation WHERE n_regionkey <> n_nationkey),
n AS (SELECT n_nationkey AS vid, n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y FROM nation)
SELECT id * 8 + 2 * k + s AS pid, round(p.x + k / 3 * (q.x - p.x), 6) AS x, round(p.y + k / 3 * (q.y - p.y) + CASE s WHEN 0 THEN 0.5 ELSE -0.5 END, 6) AS y, 0.0::DOUBLE AS z FROM e JOIN n p ON p.vid = a JOIN n q ON q.vid = b, range(4) r(k), range(2) w(s)""",
    "catalogue_upsert_old_and_new": """WITH r AS (SELECT p_brand, p_size, p_name, p_retailprice, p_partkey % 2 AS side, row_number() OVER (PARTITION BY p_brand, p_size, p_partkey % 2 ORDER BY p_partkey DESC) AS n FROM part), l AS (SELECT * FROM r WHERE n = 1)
SELECT p_brand, p_size, p_name, p_retailprice FROM l WHERE side = 1 UNION ALL SELECT p_brand, p_size, p_name, p_retailprice FROM l o WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM l x WHERE x.side = 1 AND x.p_brand = o.p_brand AND x.p_size = o.p_size)""",
    "off_round_trip": f"WITH {_MESH} SELECT 'vertex' AS kind, vid AS id, [x, y, 0.0::DOUBLE] AS parts FROM v UNION ALL SELECT 'cell', 2 * (a % 24 + 23 * (a // 24)) + CASE b - a WHEN 1 THEN 0 ELSE 1 END, [a::DOUBLE, b::DOUBLE, c::DOUBLE] FROM t",
    "catalogue_round_trip": "SELECT n_regionkey AS region, n_nationkey AS nation, n_name AS name FROM nation",
}


def grid_tree(grid: str, rank: str) -> str:
    """Arcs of the merge tree of the grid of `grid`, v (vid, value) and n (a, b), in the sense of `rank`: for each vertex what its lower neighbours reach below it.

    An arc begins at the last node that is reached, and has the vertices reached at its end that weren't at its beginning.
    """
    return grid.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + f""", o AS (SELECT vid, value, row_number() OVER (ORDER BY {rank}) AS r FROM v),
e AS (SELECT p.r AS a, q.r AS b FROM n JOIN o p ON p.vid = n.a JOIN o q ON q.vid = n.b),
t(v, s, x) AS (SELECT a, b, b FROM e WHERE b < a UNION SELECT t.v, t.s, e.b FROM t JOIN e ON e.a = t.x WHERE e.b < t.v),
l AS (SELECT v, s, min(x) AS label FROM t GROUP BY v, s),
c AS (SELECT v, count(DISTINCT label) AS parts FROM l GROUP BY v),
k AS (SELECT o.r FROM o LEFT JOIN c ON c.v = o.r WHERE parts IS NULL OR parts > 1),
d AS (SELECT DISTINCT t.v, l.label, t.x FROM t JOIN l ON l.v = t.v AND l.s = t.s WHERE t.v IN (SELECT r FROM k) OR t.v = (SELECT max(r) FROM o)),
p AS (SELECT v, label, count(*) AS n, max(x) FILTER (x IN (SELECT r FROM k)) AS low FROM d GROUP BY v, label),
b AS (SELECT v, sum(n) AS n FROM p GROUP BY v)
SELECT 0::BIGINT AS ds, f.vid AS "SegmentationId", CASE WHEN (f.value, f.vid) < (g.value, g.vid) THEN f.vid ELSE g.vid END AS "downNodeId", CASE WHEN (f.value, f.vid) < (g.value, g.vid) THEN g.vid ELSE f.vid END AS "upNodeId",
  CAST(p.n - coalesce(b.n, 0) + CASE WHEN p.v IN (SELECT r FROM k) THEN 0 ELSE 1 END AS BIGINT) AS "RegionSize", round(abs(f.value - g.value), 6) AS "RegionSpan"
FROM p JOIN o f ON f.r = p.low JOIN o g ON g.r = p.v LEFT JOIN b ON b.v = p.low"""
