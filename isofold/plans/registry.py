"""Every operator as a query over whole tables, and SQL for those that SQL can express.

Fields come from the tables thus: a user's events in time order are a path with the event's value (ds is the user); the mean value by day and hour is a
grid; orders by key make a small volume with two fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import storage
from ..operators import bivariate, columns, diagrams, fields, graph, incidence, lifted, mergetrees, meshing, reeb, separatrices, sql, stats, topology, tracking, trees
from ..sources import catalogue, generators, meshes
from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- SQL over tables
_STATEMENTS = {
    "sql_join_aggregate": "SELECT n.n_name AS nation, o.o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, o.o_orderpriority HAVING count(*) > 1",
    "sql_semi_anti": "SELECT c_mktsegment AS segment, count(*) AS n FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) GROUP BY c_mktsegment",
    "sql_rollup": "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_set_operations": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'",
    "sql_top_k": "SELECT custkey, orderkey, place FROM (SELECT o_custkey AS custkey, o_orderkey AS orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM {orders}) t WHERE place <= 3",
    "sql_theta_join": "SELECT r.r_name AS region, count(*) AS n FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN {region} r ON a.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "sql_recursive": "WITH RECURSIVE steps(k, n) AS (SELECT 0, 0 UNION ALL SELECT k + 1, (n * 7 + 3) % 25 FROM steps WHERE k < 40) SELECT s.k AS step, t.n_name AS nation FROM steps s JOIN {nation} t ON s.n = t.n_nationkey",
}
for _name, _text in _STATEMENTS.items():
    _tables = [t for t in ("lineitem", "orders", "customer", "nation", "region") if "{" + t + "}" in _text]

    def _run(spark, d, text=_text, tables=_tables):
        return sql.query([table(spark, d, t) for t in tables], text, {t: f"InputTable{i}" for i, t in enumerate(tables)})

    QUERIES[_name] = _run
    SQL[_name] = _text.format(**{t: t for t in _tables})


# ---------------------------------------------------------------- columns and blocks
@_add("catalogue_upsert", "SELECT p_brand, p_size, p_name, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey DESC) AS n FROM part) t WHERE n = 1")
def _(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_size", "p_name", "p_retailprice", F.col("p_partkey").alias("_order"))
    return catalogue.upserted(p.drop("_order").limit(0), p, ["p_brand", "p_size"])


@_add("select_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def _(spark, d):
    return columns.select_columns(table(spark, d, "lineitem"), regex="l_(quantity|extended.*)", keep=["l_orderkey", "l_linenumber"], numeric_only=True)


@_add("convert_column", "SELECT l_orderkey, l_linenumber, CAST(trunc((l_quantity - lo) / (hi - lo) * 255 + 0) AS SMALLINT) AS l_quantity FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)")
def _(spark, d):
    return columns.convert(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "unsigned char", normalize=True)


@_add("edit_array", "SELECT o_orderkey, CAST(o_totalprice AS FLOAT) AS price FROM orders")
def _(spark, d):
    return columns.edit_array(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "float", "price")


@_add("copy_and_remove_arrays", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return columns.copy_arrays(columns.remove_arrays(o.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_totalprice"]), o, ["o_orderpriority"], "o_orderkey")


@_add("normalize_field", "SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) + 1e-6, 9) AS l_quantity FROM lineitem")
def _(spark, d):
    return rounded(columns.normalize(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity"), "l_quantity", digits=9)


@_add("identifiers", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS vertex FROM part")
def _(spark, d):
    return columns.identifiers(table(spark, d, "part").select("p_partkey"), ["p_partkey"], "vertex")


@_add("identify_by_scalar", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def _(spark, d):
    return columns.identify_by_scalar(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", name="place").drop("o_totalprice")


@_add("randomize_identifiers")
def _(spark, d):
    return columns.randomize_identifiers(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 7)


@_add("extract_blocks", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber IN (1, 3, 4)")
def _(spark, d):
    return columns.extract_blocks(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), [1, 3, 4], "l_linenumber")


def _orders_as_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts are vertices with their size as field, an order is a cell of its parts."""
    v = table(spark, d, "part").select(F.lit(0).cast("long").alias("ds"), F.col("p_partkey").alias("vid"), F.col("p_size").alias("size"))
    c = table(spark, d, "lineitem").groupBy(F.lit(0).cast("long").alias("ds"), F.col("l_orderkey").alias("cid")).agg(F.array_sort(F.collect_set("l_partkey")).alias("verts"))
    return v, c


_EXTRACT = "SELECT l_orderkey AS cid, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING {}(p_size <= 25)"


@_add("extract_cells_all", _EXTRACT.format("bool_and"))
def _(spark, d):
    v, c = _orders_as_cells(spark, d)
    return columns.extract_geometry(v, c, "size", list(range(26)), "all")[1].select("cid", F.size("verts").cast("long").alias("n"))


@_add("extract_cells_any", _EXTRACT.format("bool_or"))
def _(spark, d):
    v, c = _orders_as_cells(spark, d)
    return columns.extract_geometry(v, c, "size", list(range(26)), "any")[1].select("cid", F.size("verts").cast("long").alias("n"))


@_add("extract_cells_sub", "SELECT l_orderkey AS cid, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY l_orderkey")
def _(spark, d):
    v, c = _orders_as_cells(spark, d)
    return columns.extract_geometry(v, c, "size", list(range(26)), "sub")[1].select("cid", F.size("verts").cast("long").alias("n"))


@_add("for_each", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS iteration, (SELECT count(DISTINCT event_type) FROM events) AS iterations FROM events")
def _(spark, d):
    return columns.for_each(table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", F.col("_iteration").alias("iteration"), F.col("_iterations").cast("long").alias("iterations"))


@_add("aggregate_blocks", "SELECT 0::BIGINT AS ds, c_custkey AS k, c_acctbal AS balance FROM customer UNION ALL SELECT 1::BIGINT, s_suppkey, s_acctbal FROM supplier")
def _(spark, d):
    return columns.aggregate_blocks(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))).select("ds", "k", "balance")


@_add("grid_layout", """WITH b AS (SELECT l_linenumber AS ds, max(l_quantity) - min(l_quantity) AS w, max(l_discount) - min(l_discount) AS h FROM lineitem GROUP BY 1), m AS (SELECT max(w) AS w, max(h) AS h, CAST(ceil(sqrt(count(*))) AS BIGINT) AS c FROM b),
i AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS i FROM b) SELECT l_orderkey, l_linenumber, round(l_quantity + (i % c) * w * 1.1, 6) AS x, round(l_discount + (i // c) * h * 1.1, 6) AS y FROM lineitem JOIN i ON ds = l_linenumber, m""")
def _(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("ds"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return rounded(columns.grid_layout(v).select("l_orderkey", "l_linenumber", "x", "y"), "x", "y")


@_add("embed_from_table", "SELECT c_custkey AS vid, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y, 0.0::DOUBLE AS z FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return columns.embed_from_table(c.select(F.col("c_custkey").alias("vid")), c.select(F.col("c_custkey").alias("vid"), "c_acctbal", "c_nationkey"), "c_acctbal", "c_nationkey")


@_add("project_from_fields", "SELECT p_partkey AS vid, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y, 0.0::DOUBLE AS z FROM part")
def _(spark, d):
    return columns.project_from_fields(table(spark, d, "part").select(F.col("p_partkey").alias("vid"), "p_retailprice", "p_size"), "p_retailprice", "p_size").select("vid", "x", "y", "z")


@_add("texture_map", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS u, round((p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE), 9) AS v FROM part")
def _(spark, d):
    t = columns.texture_map(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size")
    return t.select("p_partkey", F.round(F.col("uv")[0], 9).alias("u"), F.round(F.col("uv")[1], 9).alias("v"))


# ---------------------------------------------------------------- statistics and distances
def _price_fields(spark, d):
    return table(spark, d, "lineitem").select("l_linenumber", F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))


for _n, _sum in ((1, "sum(abs(a - b))"), (2, "sqrt(sum((a - b) * (a - b)))"), ("inf", "max(abs(a - b))")):

    def _run(spark, d, n=_n):
        return rounded(stats.field_distance(_price_fields(spark, d), "a", "b", n, ["l_linenumber"])[1], "distance", digits=2)

    QUERIES[f"field_distance_{_n}"] = _run
    SQL[f"field_distance_{_n}"] = f"SELECT l_linenumber, round({_sum}, 2) AS distance FROM (SELECT l_linenumber, l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem) GROUP BY l_linenumber"


@_add("distance_matrix", """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i)
SELECT a.label AS i, b.label AS j, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS dist FROM c a JOIN c b ON a.i = b.i GROUP BY a.label, b.label""")
def _(spark, d):
    c = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("vid", "x")).groupBy(F.col("label").alias("ds"), "vid").agg(F.avg(F.col("x").cast("double")).alias("value"))
    return rounded(stats.distance_matrix(c, 2), "dist")


def _hours(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("ds"), F.hour("ts").alias("vid")).agg(F.round(F.avg("value"), 6).alias("value"))


@_add("uncertainty", """WITH h AS (SELECT user_id, hour(ts) AS vid, round(avg(value), 6) AS value FROM events GROUP BY 1, 2), s AS (SELECT min(value) AS lo, max(value) AS hi FROM h)
SELECT CAST(vid AS INTEGER) AS vid, min(value) AS lower, max(value) AS upper, round(avg(value), 6) AS mean, """ + ", ".join(f"round(avg(CASE WHEN least(floor((value - lo) * 10 / (hi - lo)), 9) = {k} THEN 1.0 ELSE 0.0 END), 6) AS bin_{k}" for k in range(10)) + " FROM h, s GROUP BY vid")
def _(spark, d):
    return rounded(stats.uncertainty(_hours(spark, d), 10), "mean", *(f"bin_{k}" for k in range(10)))


@_add("component_size", """WITH e AS (SELECT CAST(1000000 + n_nationkey AS BIGINT) AS a, c_custkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey), k AS (SELECT a, least(min(b), a) AS component, count(*) AS n FROM e GROUP BY a)
SELECT component, n + 1 AS vertices FROM k""")
def _(spark, d):
    e = table(spark, d, "customer").select((F.col("c_nationkey") + 1000000).cast("long").alias("a"), F.col("c_custkey").alias("b"))
    return graph.components(e).groupBy("component").agg(F.count("*").alias("vertices"))


def _cloud(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("vid"), *(F.round(F.col("embedding")[k].cast("double"), 6).alias(c) for k, c in enumerate("xyz")))


@_add("merge_points", """WITH RECURSIVE p AS (SELECT vec_id AS vid, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z FROM embeddings),
n AS (SELECT b.vid, min(a.vid) AS nxt FROM p a JOIN p b ON a.vid < b.vid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.03 * 0.03 GROUP BY b.vid),
w AS (SELECT vid, vid AS pos FROM p UNION ALL SELECT w.vid, n.nxt FROM w JOIN n ON w.pos = n.vid) SELECT vid, min(pos) AS merged_to FROM w GROUP BY vid""")
def _(spark, d):
    return graph.merge_points(_cloud(spark, d), 0.03).select("vid", "merged_to")


# ---------------------------------------------------------------- fields of events
def paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A path for each user: (ds, vid, value) by time, and its edges."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = table(spark, d, "events").select(F.col("user_id").cast("long").alias("ds"), (F.row_number().over(w) - 1).cast("long").alias("vid"), F.col("value").cast("double").alias("value"), "event_type")
    return v, path_edges(v)


def path_edges(v: DataFrame) -> DataFrame:
    """Ids along a path are successive: each vertex but the first ends an edge. Edges come row by row of the vertices, not from a count for each ds, so that Spark's sizes are theirs: joins don't broadcast them."""
    return v.where("vid > 0").select("ds", (F.col("vid") - 1).alias("cid"), F.array(F.col("vid") - 1, F.col("vid")).alias("verts"))


_PATH = "WITH p AS (SELECT user_id AS ds, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS vid, value FROM events), q AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM p WINDOW w AS (PARTITION BY ds ORDER BY vid)) "
#: Ties fall by the id: the left neighbour is below, the right above.
_LOW, _HIGH = "(a IS NULL OR a > value) AND (b IS NULL OR b >= value)", "(a IS NULL OR a <= value) AND (b IS NULL OR b < value)"


@_add("extrema", _PATH + f"SELECT ds, vid, value, CASE WHEN {_LOW} THEN 0 ELSE 3 END AS \"CriticalType\" FROM q WHERE (({_LOW}) OR ({_HIGH})) AND NOT (a IS NULL AND b IS NULL)")
def _(spark, d):
    v, c = paths(spark, d)
    return topology.extrema(v, incidence.neighbours(c))


@_add("critical_points", _PATH + f"SELECT ds, vid, value, CASE WHEN {_LOW} THEN 0 ELSE 3 END AS \"CriticalType\", CAST(a IS NULL OR b IS NULL AS TINYINT) AS \"IsOnBoundary\" FROM q WHERE (({_LOW}) OR ({_HIGH})) AND NOT (a IS NULL AND b IS NULL)")
def _(spark, d):
    return topology.critical_points(*paths(spark, d))


@_add("smooth_field", _PATH + "SELECT ds, vid, round(coalesce((coalesce(a, 0) + coalesce(b, 0)) / nullif(CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER), 0), value), 6) AS value FROM q")
def _(spark, d):
    v, c = paths(spark, d)
    return rounded(fields.smooth(v.select("ds", "vid", "value"), incidence.neighbours(c), ["value"]), "value")


@_add("average_with_neighbours", _PATH + "SELECT ds, vid, round((value + coalesce(a, 0) + coalesce(b, 0)) / (1 + CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER)), 6) AS value FROM q")
def _(spark, d):
    v, c = paths(spark, d)
    return rounded(fields.average_with_neighbours(v.select("ds", "vid", "value"), incidence.neighbours(c), "value"), "value")


@_add("persistence_diagram")
def _(spark, d):
    return topology.persistence_diagram(*paths(spark, d))


@_add("persistence_curve")
def persistence_curve(spark, d):
    return topology.persistence_curve(topology.persistence_diagram(*paths(spark, d)))


@_add("join_tree")
def _(spark, d):
    return topology.merge_tree(*paths(spark, d), kind="join")["arcs"]


@_add("split_tree_nodes")
def _(spark, d):
    return topology.merge_tree(*paths(spark, d), kind="split")["nodes"]


@_add("contour_tree")
def _(spark, d):
    return topology.merge_tree(*paths(spark, d), kind="contour")["arcs"]


@_add("morse_smale_segmentation")
def _(spark, d):
    v, c = paths(spark, d)
    return topology.segmentation(v, incidence.neighbours(c))


@_add("simplified_field")
def _(spark, d):
    v, c = paths(spark, d)
    pairs = topology.persistence_diagram(v, c).where("persistence > 50")
    return topology.simplified(v, c, pairs.select("ds", F.explode(F.array("birth_vid", "death_vid")).alias("vid")).distinct())


@_add("distance_field", """WITH p AS (SELECT user_id AS ds, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS vid, event_type FROM events), e AS (SELECT ds, vid, CASE WHEN event_type = 'error' THEN vid END AS s FROM p),
f AS (SELECT ds, vid, max(s) OVER (PARTITION BY ds ORDER BY vid) AS a, min(s) OVER (PARTITION BY ds ORDER BY vid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e)
SELECT ds, vid, CAST(least(vid - a, b - vid) AS DOUBLE) AS distance FROM f""")
def _(spark, d):
    v, c = paths(spark, d)
    stride = 1 << 32
    key = (F.col("ds") * stride + F.col("vid")).alias("vid")
    e = c.select((F.col("ds") * stride + F.col("verts")[0]).alias("a"), (F.col("ds") * stride + F.col("verts")[1]).alias("b"))
    out = graph.distance_field(e, v.where("event_type = 'error'").select(key, key.alias("index")), v.select(key), None)
    return out.select(F.shiftright("vid", 32).alias("ds"), (F.col("vid") % stride).alias("vid"), "distance")


@_add("integral_lines")
def _(spark, d):
    v, c = paths(spark, d)
    placed = v.withColumns({"x": F.col("vid").cast("double"), "y": F.lit(0.0), "z": F.lit(0.0)})
    return topology.integral_lines(placed, incidence.neighbours(c), v.where("event_type = 'purchase'"))


@_add("contour_around_point")
def _(spark, d):
    v, c, g = day_hour_grid(spark, d)
    tops = topology.extrema(v, g.neighbours(v)).where("CriticalType = 3")
    return topology.contour_around_point(v, c, tops.select(F.col("vid").alias("pid"), "vid", F.lit(25.0).alias("isovalue")))


# ---------------------------------------------------------------- the grid of days and hours
def day_hour_grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, incidence.Grid]:
    """Mean values by day of month and hour on a grid of 31 by 24; no events is 0."""
    g = incidence.Grid(24, 31)
    m = table(spark, d, "events").groupBy((F.hour("ts") + 24 * (F.dayofmonth("ts") - 1)).cast("long").alias("vid")).agg(F.round(F.avg("value"), 6).alias("value"))
    v = g.vertices(spark).join(m, "vid", "left").select("ds", "vid", "x", "y", "z", F.coalesce("value", F.lit(0.0)).alias("value"))
    return v, g.cells(spark), g


_GRID = "WITH m AS (SELECT CAST(hour(ts) + 24 * (day(ts) - 1) AS BIGINT) AS vid, round(avg(value), 6) AS value FROM events GROUP BY 1), v AS (SELECT i AS vid, coalesce(value, 0) AS value FROM range(744) r(i) LEFT JOIN m ON i = vid), n AS (SELECT a.vid AS a, b.vid AS b FROM v a JOIN (VALUES (0, 1), (1, 0), (1, 1), (0, -1), (-1, 0), (-1, -1)) s(i, j) ON a.vid % 24 + i BETWEEN 0 AND 23 AND a.vid // 24 + j BETWEEN 0 AND 30 JOIN v b ON b.vid = a.vid + i + 24 * j) "


for _kind, _rank in (("join", "value, vid"), ("split", "value DESC, vid DESC")):

    def _run(spark, d, kind=_kind):
        v, _, g = day_hour_grid(spark, d)
        return rounded(trees.merge_tree(v, g.neighbours(v), kind)["arcs"], "RegionSpan")

    QUERIES[f"grid_{_kind}_tree"] = _run
    SQL[f"grid_{_kind}_tree"] = oracles.grid_tree(_GRID.rstrip(), _rank)


@_add("grid_contour_tree")
def _(spark, d):
    v, _, g = day_hour_grid(spark, d)
    return trees.merge_tree(v, g.neighbours(v), "contour")["arcs"].drop("SegmentationId")


@_add("grid_contour_segments")
def _(spark, d):
    """Vertices with the ends of their arc."""
    v, _, g = day_hour_grid(spark, d)
    tree = trees.merge_tree(v, g.neighbours(v), "contour")
    return tree["segmentation"].join(tree["arcs"].select("ds", "SegmentationId", "downNodeId", "upNodeId"), ["ds", "SegmentationId"]).select("ds", "vid", "downNodeId", "upNodeId")


@_add("grid_extrema", _GRID + "SELECT 0::BIGINT AS ds, a.vid, a.value, CASE WHEN min((b.value, b.vid)) > (a.value, a.vid) THEN 0 ELSE 3 END AS \"CriticalType\" FROM n JOIN v a ON n.a = a.vid JOIN v b ON n.b = b.vid GROUP BY a.vid, a.value HAVING min((b.value, b.vid)) > (a.value, a.vid) OR max((b.value, b.vid)) < (a.value, a.vid)")
def _(spark, d):
    v, _, g = day_hour_grid(spark, d)
    return topology.extrema(v, g.neighbours(v))


@_add("grid_critical_points")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    return topology.critical_points(v, c)


#: From this mean value on an hour of a day belongs to the warm part of the grid, a mesh with a rim and holes.
WARM = 45.0
_WARM = _GRID.rstrip().replace(" ON i = vid), n AS", f" ON i = vid), w AS (SELECT vid FROM v WHERE value >= {WARM}), t AS (SELECT unnest([[i, i + 1, i + 25], [i, i + 24, i + 25]]) AS t FROM range(744) r(i) WHERE i % 24 < 23 AND i < 720), c AS (SELECT t FROM t WHERE t[1] IN (SELECT vid FROM w) AND t[2] IN (SELECT vid FROM w) AND t[3] IN (SELECT vid FROM w)), e AS (SELECT a, b, count(*) AS n FROM (SELECT unnest([t[1], t[1], t[2]]) AS a, unnest([t[2], t[3], t[3]]) AS b FROM c) GROUP BY a, b), n AS") + " "


def warm_mesh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The triangles of the grid of days and hours whose three values are WARM at least, and their vertices."""
    v, c, _ = day_hour_grid(spark, d)
    warm = v.where(F.col("value") >= WARM).select(F.col("vid").alias("w"))
    corner = c.select("ds", "cid", "verts", F.explode("verts").alias("w")).join(warm, "w")
    c = corner.groupBy("ds", "cid").agg(F.first("verts").alias("verts"), F.count("*").alias("n")).where("n = 3").drop("n")
    return v.join(c.select(F.explode("verts").alias("vid")).distinct(), "vid", "left_semi"), c


@_add("grid_incidence", _WARM + "SELECT 0::BIGINT AS ds, 0 AS dim, (SELECT count(*) FROM (SELECT a FROM e UNION SELECT b FROM e)) AS n UNION ALL SELECT 0, 1, count(*) FROM e UNION ALL SELECT 0, 2, count(*) FROM c")
def _(spark, d):
    return incidence.counts(*warm_mesh(spark, d))


@_add("triangulation_request", "SELECT [x]::BIGINT[] AS face FROM (VALUES (31), (32), (55), (57), (80), (81)) t(x) WHERE false UNION ALL SELECT [least(a, b), greatest(a, b)] FROM (VALUES (31, 32), (32, 57), (57, 81), (80, 81), (55, 80), (31, 55)) t(a, b)")
def _(spark, d):
    _, c, _ = day_hour_grid(spark, d)
    return incidence.request(c, "link", [56])


@_add("boundary_vertices", _WARM + "SELECT DISTINCT 0::BIGINT AS ds, unnest([a, b]) AS vid FROM e WHERE n = 1")
def _(spark, d):
    return incidence.boundary(warm_mesh(spark, d)[1], 0).select("ds", F.col("face")[0].alias("vid"))


@_add("manifold_check", _WARM + "SELECT 0::BIGINT AS ds, k.vid, CAST(CASE WHEN edges = cells THEN 1 ELSE edges - cells END AS INTEGER) AS components FROM (SELECT vid, count(*) AS edges FROM (SELECT unnest([a, b]) AS vid FROM e) GROUP BY vid) k JOIN (SELECT vid, count(*) AS cells FROM (SELECT unnest(t) AS vid FROM c) GROUP BY vid) f ON f.vid = k.vid")
def _(spark, d):
    return topology.manifold_check(warm_mesh(spark, d)[1], 0).select("ds", F.col("face")[0].alias("vid"), "components")


@_add("discrete_gradient")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    return topology.discrete_gradient(v, c)


@_add("morse_smale_separatrices")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    return topology.separatrices(topology.discrete_gradient(v, c))


@_add("grid_segmentation")
def _(spark, d):
    v, _, g = day_hour_grid(spark, d)
    return topology.segmentation(v, g.neighbours(v))


@_add("reeb_graph")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    return topology.reeb_graph(v, c, 16)["nodes"]


def week_torus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Mean values of events by weekday and hour, both of which begin again: a torus of 24 by 7."""
    m = table(spark, d, "events").groupBy((F.hour("ts") + 24 * (F.dayofweek("ts") - 1)).cast("long").alias("vid")).agg(F.round(F.avg("value"), 6).alias("value"))
    v = spark.range(168).select(F.lit(0).cast("long").alias("ds"), F.col("id").alias("vid")).join(m, "vid", "left").select("ds", "vid", F.coalesce("value", F.lit(0.0)).alias("value"))
    at = lambda i, j: (F.col("id") % 24 + i) % 24 + 24 * ((F.expr("id div 24") + j) % 7)
    sides = F.array(*(F.array(at(0, 0), at(*k), at(1, 1)) for k in ((1, 0), (0, 1))))
    c = spark.range(168).select(F.lit(0).cast("long").alias("ds"), "id", F.posexplode(sides).alias("k", "verts")).select("ds", (F.col("id") * 2 + F.col("k")).alias("cid"), "verts")
    return v, c


@_add("torus_reeb_nodes")
def _(spark, d):
    return reeb.reeb_graph(*week_torus(spark, d))["nodes"]


@_add("torus_reeb_arcs")
def _(spark, d):
    return rounded(reeb.reeb_graph(*week_torus(spark, d))["arcs"].drop("SegmentationId"), "RegionSpan")


@_add("mandatory_critical_points")
def _(spark, d):
    _, c, g = day_hour_grid(spark, d)
    m = table(spark, d, "events").groupBy((F.hour("ts") + 24 * (F.dayofmonth("ts") - 1)).cast("long").alias("vid")).agg(F.min("value").alias("lower"), F.max("value").alias("upper"))
    v = g.vertices(spark).join(m, "vid", "left").select("ds", "vid", F.coalesce("lower", F.lit(0.0)).alias("lower"), F.coalesce("upper", F.lit(0.0)).alias("upper"))
    return topology.mandatory_critical_points(v, c)


@_add("harmonic_field")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    return rounded(fields.harmonic(v, fields.graph_laplacian(c), v.where("vid in (0, 743)").select("ds", "vid", "value")), "value", digits=4)


@_add("eigen_field")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    return fields.eigenvectors(v, fields.cotan_laplacian(v, c), 3)


@_add("smooth_geometry")
def _(spark, d):
    v, _, g = day_hour_grid(spark, d)
    return rounded(fields.smooth_geometry(v.select("ds", "vid", "x", "y", "z"), g.neighbours(v), 2), "x", "y", "z")


@_add("barycentric_subdivision", "SELECT 0 AS dim, 744::BIGINT AS n UNION ALL SELECT 1, 23 * 31 + 24 * 30 + 23 * 30 UNION ALL SELECT 2, 2 * 23 * 30")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    return meshing.barycentric_subdivision(v, c)[0].groupBy(F.col("parent_dim").alias("dim")).agg(F.count("*").alias("n"))


@_add("mesh_subdivision", _WARM + "SELECT 3 AS n, 3 * count(*) AS cells FROM c")
def _(spark, d):
    v, c = warm_mesh(spark, d)
    return meshing.subdivide(v, c)[1].groupBy(F.lit(3).alias("n")).agg(F.count("*").alias("cells"))


@_add("quad_subdivision", "SELECT (4 * 23 * 30)::BIGINT AS n")
def _(spark, d):
    v, _, _ = day_hour_grid(spark, d)
    q = v.where("vid % 24 < 23 and vid < 720").select("ds", F.col("vid").alias("cid"), F.array(F.col("vid"), F.col("vid") + 1, F.col("vid") + 25, F.col("vid") + 24).alias("verts"))
    return meshing.quad_subdivision(v, q, 1, 1)[1].agg(F.count("*").alias("n"))


@_add("morse_smale_quadrangulation")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    g = topology.discrete_gradient(v, c)
    return meshing.quadrangulation(topology.separatrices(g), topology.segmentation(v, incidence.neighbours(c)), g)


@_add("interpolate_dataset", _GRID + "SELECT i AS id, (i % 22 + 0.25)::DOUBLE AS x, (i // 22 + 0.5)::DOUBLE AS y, round(0.5 * p.value + 0.25 * q.value + 0.25 * s.value, 9) AS f FROM range(600) r(i) JOIN v p ON p.vid = i % 22 + 24 * (i // 22) JOIN v q ON q.vid = p.vid + 24 JOIN v s ON s.vid = p.vid + 25")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    pts = spark.range(600).select("id", (F.col("id") % 22 + 0.25).alias("x"), (F.floor(F.col("id") / 22) + 0.5).alias("y"))
    return rounded(columns.interpolate(pts, v.withColumnRenamed("value", "f"), c, ["f"], 2.0), "x", "y", "f", digits=9)


# ---------------------------------------------------------------- a volume with two fields
def order_volume(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A grid of 8 by 8 by 6 with the mean price and quantity of orders and lines by key."""
    g = incidence.Grid(8, 8, 6)
    u = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 384).alias("vid")).agg(F.round(F.avg("o_totalprice"), 4).alias("u"))
    w = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 384).alias("vid")).agg(F.round(F.avg("l_quantity"), 4).alias("v"))
    v = g.vertices(spark).join(u, "vid", "left").join(w, "vid", "left").select("ds", "vid", "x", "y", "z", F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return v, g.cells(spark)


@_add("grid_ascending_lines")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    return separatrices.ascending_lines(settled_gradient(v, c, "value"), c)


def settled_gradient(v: DataFrame, c: DataFrame, value: str) -> DataFrame:
    return storage.settled(topology.discrete_gradient(v, c, value), "gradient")


@_add("volume_saddle_connectors")
def _(spark, d):
    return separatrices.saddle_connectors(settled_gradient(*order_volume(spark, d), "u")).select("ds", "saddle", "edge", "paths")


@_add("volume_saddle_pairs")
def _(spark, d):
    return separatrices.saddle_saddle_pairs(*order_volume(spark, d), "u")


@_add("volume_descending_walls")
def _(spark, d):
    return separatrices.descending_walls(settled_gradient(*order_volume(spark, d), "u"))


@_add("volume_ascending_walls")
def _(spark, d):
    v, c = order_volume(spark, d)
    return separatrices.ascending_walls(settled_gradient(v, c, "u"), c)


@_add("jacobi_set")
def _(spark, d):
    return bivariate.jacobi_set(*order_volume(spark, d))


@_add("fiber")
def _(spark, d):
    v, c = order_volume(spark, d)
    m = v.agg(F.avg("u"), F.avg("v")).first()
    return bivariate.fiber(v, c, m[0], m[1])


def _polygon(spark: SparkSession, v: DataFrame) -> DataFrame:
    m = v.agg(F.avg("u").alias("u"), F.avg("v").alias("v"), F.stddev("u").alias("su"), F.stddev("v").alias("sv"))
    corner = F.posexplode(F.array(*(F.struct((F.col("u") + a * F.col("su")).alias("u"), (F.col("v") + b * F.col("sv")).alias("v")) for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.0, 0.5)))))
    return bivariate.range_polygon(m.select(corner.alias("id", "p")).select("id", "p.u", "p.v"))


@_add("range_polygon")
def _(spark, d):
    return rounded(_polygon(spark, order_volume(spark, d)[0]), "u0", "v0", "u1", "v1", digits=3)


@_add("fiber_surface")
def _(spark, d):
    v, c = order_volume(spark, d)
    return bivariate.fiber_surface(v, c, _polygon(spark, v))


@_add("reeb_space")
def _(spark, d):
    return bivariate.reeb_space(*order_volume(spark, d), bins=4)["sheets3"]


@_add("continuous_scatter_plot")
def _(spark, d):
    v, c = order_volume(spark, d)
    return rounded(stats.continuous_scatter(v, c, "u", "v", (16, 16)), "density")


# ---------------------------------------------------------------- graphs and generated sets
def _nation_graph(spark, d):
    v = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("vid"), F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"), F.lit(0.0).alias("z"), F.col("n_regionkey").alias("sequence"))
    e = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b")).where("a <> b")
    return v, e


@_add("mesh_graph", "SELECT count(*) * 8 AS n FROM nation WHERE n_regionkey <> n_nationkey")
def _(spark, d):
    return meshing.mesh_graph(*_nation_graph(spark, d), subdivisions=2)[0].agg(F.count("*").alias("n"))


@_add("planar_layout")
def _(spark, d):
    return meshing.planar_layout(*_nation_graph(spark, d))


@_add("icosphere", "SELECT (10 * 64 + 2)::BIGINT AS n, 1.0::DOUBLE AS radius")
def _(spark, d):
    v, _ = generators.icosphere(spark, 3)
    return v.agg(F.count("*").alias("n"), F.round(F.max(F.sqrt(F.expr("x * x + y * y + z * z"))), 9).alias("radius"))


@_add("icosphere_around_data", "SELECT 42::BIGINT AS n")
def _(spark, d):
    return generators.icosphere_around(_cloud(spark, d), 1)[0].agg(F.count("*").alias("n"))


@_add("icospheres_at_points", "SELECT count(*) * 12 AS n FROM embeddings")
def _(spark, d):
    return generators.icospheres_at(_cloud(spark, d), 0, 0.01)[0].agg(F.count("*").alias("n"))


@_add("spheres_at_points", "SELECT count(*) * 64 AS n FROM embeddings")
def _(spark, d):
    return generators.spheres_at(_cloud(spark, d), 8, 8, 0.01)[0].agg(F.count("*").alias("n"))


@_add("gaussian_points")
def _(spark, d):
    return generators.gaussian_points(spark, table(spark, d, "customer").count(), 3, 1)


@_add("raster_image")
def _(spark, d):
    return generators.raster(_cloud(spark, d), "vid", 32, 32)


@_add("depth_geometry")
def _(spark, d):
    return meshing.depth_geometry(generators.raster(_cloud(spark, d), "vid", 32, 32).select("px", "py", "depth"), 32, 32, (0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (0.0, 1.0, 0.0), (0.0, 2.0), (2.0, 2.0))[1]


@_add("topological_compression")
def _(spark, d):
    v, c = paths(spark, d)
    return meshes.compressed(v, c, 20.0, 10.0)[0]


# ---------------------------------------------------------------- tracking
def _labelled(spark, d):
    return table(spark, d, "events").select(F.lit(0).cast("long").alias("level"), F.weekofyear("ts").cast("long").alias("t"), F.col("user_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.ascii("event_type").cast("long").alias("label")).distinct()


@_add("tracking_overlap_edges", "WITH p AS (SELECT DISTINCT week(ts) AS t, user_id AS x, ascii(event_type) AS label FROM events), s AS (SELECT t, lead(t) OVER (ORDER BY t) AS t2 FROM (SELECT DISTINCT t FROM p)) SELECT CAST(a.t AS BIGINT) AS t, CAST(s.t2 AS BIGINT) AS t2, CAST(a.label AS BIGINT) AS label, CAST(b.label AS BIGINT) AS next_label, count(*) AS overlap FROM p a JOIN s ON a.t = s.t JOIN p b ON b.t = s.t2 AND a.x = b.x GROUP BY ALL")
def _(spark, d):
    return tracking.overlap_edges(_labelled(spark, d)).select("t", "t2", "label", "next_label", F.col("Overlap").alias("overlap"))


@_add("tracking_overlap_nodes", "WITH p AS (SELECT DISTINCT week(ts) AS t, user_id AS x, ascii(event_type) AS label FROM events) SELECT CAST(t AS BIGINT) AS t, CAST(label AS BIGINT) AS label, count(*) AS size, round(avg(x), 6) AS cx FROM p GROUP BY t, label")
def _(spark, d):
    return rounded(tracking.overlap_nodes(_labelled(spark, d)).select("t", "label", F.col("Size").alias("size"), "cx"), "cx")


@_add("tracking_overlap_branches")
def _(spark, d):
    return rounded(tracking.track_overlap(_labelled(spark, d))[0], "cx")


def _daily(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A path of the hours of each day: an ensemble of 31 members whatever the scale."""
    m = table(spark, d, "events").groupBy((F.dayofmonth("ts") - 1).cast("long").alias("ds"), F.hour("ts").cast("long").alias("h")).agg(F.round(F.avg("value"), 6).alias("value"))
    days = m.select("ds").distinct()
    v = days.withColumn("vid", F.explode(F.expr("sequence(0L, 23L)"))).join(m.withColumnRenamed("h", "vid"), ["ds", "vid"], "left").select("ds", "vid", F.coalesce("value", F.lit(0.0)).alias("value"))
    return v, path_edges(v)


@_add("tracking_diagrams")
def _(spark, d):
    return tracking.track_fields(*_daily(spark, d))


@_add("diagram_distance_matrix")
def _(spark, d):
    return rounded(diagrams.distance_matrix(diagrams.constrained(topology.persistence_diagram(*_daily(spark, d)))), "dist")


@_add("bottleneck_distance")
def _(spark, d):
    return rounded(diagrams.distance_matrix(diagrams.constrained(topology.persistence_diagram(*_daily(spark, d))), kind="bottleneck"), "dist")


def hourly_grids(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Mean values of each day by hour and ten minutes, on grids of 24 by 6; no events is 0."""
    g = incidence.Grid(24, 6)
    day, at = F.dayofmonth("ts").cast("long").alias("ds"), (F.hour("ts") + 24 * F.floor(F.minute("ts") / 10)).cast("long").alias("vid")
    m = storage.settled(table(spark, d, "events").groupBy(day, at).agg(F.round(F.avg("value"), 6).alias("value")), "slots")
    days = m.select(F.col("ds").alias("_ds")).distinct().agg(F.sort_array(F.collect_list("_ds")).alias("days")).first()["days"]  # 31 at most
    each = F.explode(F.array(*(F.lit(x) for x in days)) if days else F.expr("array_repeat(0L, 0)")).alias("ds")
    v = g.vertices(spark).select(each, "vid", "x", "y", "z").join(m, ["ds", "vid"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return v, g.cells(spark).select(each, "cid", "verts")


#: Places count a twentieth an hour or slot.
PLACES = lifted.Weights(1.0, 0.5, 0.05, 0.05, 0.0)


def daily_pairs(spark: SparkSession, d: str) -> DataFrame:
    v, c = hourly_grids(spark, d)
    v = storage.settled(v, "grids")
    return storage.settled(lifted.lifted(diagrams.constrained(topology.persistence_diagram(v, c, dim=2)), v), "pairs")


@_add("lifted_wasserstein")
def _(spark, d):
    return rounded(lifted.distance_matrix(daily_pairs(spark, d), PLACES), "dist")


@_add("lifted_bottleneck")
def _(spark, d):
    return rounded(lifted.distance_matrix(daily_pairs(spark, d), PLACES, float("inf")), "dist")


@_add("tracking_lifted")
def _(spark, d):
    return lifted.merged(storage.settled(lifted.tracks(daily_pairs(spark, d), PLACES), "tracks"), 1.5)


@_add("tracking_meetings")
def _(spark, d):
    return rounded(lifted.meetings(storage.settled(lifted.tracks(daily_pairs(spark, d), PLACES), "tracks"), 1.5), "distance")


@_add("diagram_clusters")
def _(spark, d):
    return rounded(diagrams.cluster(diagrams.constrained(topology.persistence_diagram(*_daily(spark, d))), 3)[0], "distance")


@_add("diagram_barycenter")
def _(spark, d):
    p = diagrams.constrained(topology.persistence_diagram(*_daily(spark, d))).withColumn("cluster", F.lit(0).cast("long"))
    return rounded(diagrams.barycenters(p), "birth", "death", "energy")


@_add("merge_tree_distance_matrix")
def _(spark, d):
    return rounded(mergetrees.distance_matrix(mergetrees.branch_trees(*_daily(spark, d))), "dist")


@_add("merge_tree_barycenter")
def merge_tree_barycenter(spark, d):
    centre, energy = mergetrees.barycenter(mergetrees.branch_trees(*_daily(spark, d), kind="split"))
    return rounded(centre.withColumn("energy", F.lit(energy)), "birth", "death", "energy")


@_add("merge_tree_matching")
def _(spark, d):
    return rounded(mergetrees.matching_table(mergetrees.branch_trees(*_daily(spark, d)), 0, 1), "MeanMatchedPersistence", "Cost")


@_add("merge_tree_clusters")
def _(spark, d):
    v, c = _daily(spark, d)
    return rounded(mergetrees.cluster(mergetrees.branch_trees(v, c), 3, second=mergetrees.branch_trees(v, c, "split"))[0], "distance")


@_add("merge_tree_temporal_subsampling")
def _(spark, d):
    return mergetrees.temporal_subsampling(mergetrees.branch_trees(*_daily(spark, d)), 20)[1]


def entry(spark: SparkSession, d: str) -> DataFrame:
    return persistence_curve(spark, d)


# ---------------------------------------------------------------- the rest of the surface
@_add("data_set_to_table", "SELECT c_custkey AS vid, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("vid"), F.col("c_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return columns.as_table(c)


@_add("cell_component_size", """WITH k AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1) SELECT CAST(n_nationkey + 100 AS BIGINT) AS vid, n + 1 AS vertices, n AS cells FROM nation JOIN k ON r = n_regionkey
UNION ALL SELECT CAST(r AS BIGINT), n + 1, n FROM k""")
def _(spark, d):
    n = table(spark, d, "nation")
    v = n.select((F.col("n_nationkey") + 100).cast("long").alias("vid")).union(n.select(F.col("n_regionkey").cast("long").alias("vid")).distinct())
    c = n.select(F.col("n_nationkey").cast("long").alias("cid"), F.array(F.col("n_regionkey").cast("long"), (F.col("n_nationkey") + 100).cast("long")).alias("verts"))
    return graph.cell_components(c, v)[0].select("vid", F.col("VertexNumber").alias("vertices"), F.col("CellNumber").alias("cells"))


@_add("periodic_grid", "SELECT 0 AS dim, 744::BIGINT AS n UNION ALL SELECT 1, 3 * 744 UNION ALL SELECT 2, 2 * 744")
def _(spark, d):
    g = incidence.Grid(24, 31, periodic=True)
    return incidence.counts(g.vertices(spark), g.cells(spark)).where("n > 0").select("dim", "n")


@_add("uncertain_bounds_of_days", "WITH m AS (SELECT CAST(day(ts) - 1 AS BIGINT) AS ds, CAST(hour(ts) AS BIGINT) AS vid, round(avg(value), 6) AS value FROM events GROUP BY 1, 2), a AS (SELECT d.ds, h.i AS vid, coalesce(m.value, 0) AS value FROM (SELECT DISTINCT ds FROM m) d CROSS JOIN range(24) h(i) LEFT JOIN m ON m.ds = d.ds AND m.vid = h.i) SELECT vid, min(value) AS lower, max(value) AS upper FROM a GROUP BY vid")
def _(spark, d):
    return stats.uncertainty(_daily(spark, d)[0], 4).select("vid", "lower", "upper")


@_add("camera_grid")
def _(spark, d):
    return rounded(generators.cameras(_cloud(spark, d), 8), "px", "py", "pz", "fx", "fy", "fz", "near", "far")


@_add("nesting_edges", "WITH p AS (SELECT DISTINCT day(ts) % 3 AS level, CAST(hour(ts) AS BIGINT) AS t, user_id AS x, ascii(event_type) AS label FROM events) SELECT a.t, CAST(a.level AS BIGINT) AS level, CAST(a.label AS BIGINT) AS label, CAST(b.label AS BIGINT) AS next_label, count(*) AS overlap FROM p a JOIN p b ON b.level = a.level + 1 AND a.t = b.t AND a.x = b.x GROUP BY ALL")
def _(spark, d):
    p = table(spark, d, "events").select((F.dayofmonth("ts") % 3).cast("long").alias("level"), F.hour("ts").cast("long").alias("t"), F.col("user_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.ascii("event_type").cast("long").alias("label")).distinct()
    return tracking.nesting_edges(p).select("t", "level", "label", "next_label", F.col("Overlap").alias("overlap"))


@_add("merged_cells", "SELECT l_orderkey AS cid, count(DISTINCT l_partkey // 4) AS n, count(DISTINCT l_partkey) AS was FROM lineitem GROUP BY l_orderkey HAVING CASE WHEN was = 2 THEN n = 2 WHEN was = 3 THEN n > 2 ELSE n IN (4, 8) END")
def _(spark, d):
    _, c = _orders_as_cells(spark, d)
    to = table(spark, d, "part").select(F.col("p_partkey").alias("vid"), F.floor(F.col("p_partkey") / 4).alias("merged_to"))
    to = to.unionByName(table(spark, d, "lineitem").select(F.col("l_partkey").alias("vid"), F.floor(F.col("l_partkey") / 4).alias("merged_to"))).distinct()
    was = c.select("cid", F.size("verts").cast("long").alias("was"))
    return graph.merged_cells(c, to).select("cid", F.size("verts").cast("long").alias("n")).join(was, "cid")


@_add("persistence_thresholds")
def _(spark, d):
    p = topology.persistence_diagram(*_daily(spark, d))
    out = None
    for mode, k, t in (("top", 3, 0.0), ("absolute", 0, 20.0), ("relative", 0, 0.5), ("global", 0, 0.3)):
        part = diagrams.constrained(p, mode, k, t).groupBy("ds").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "ds", "n")
        out = part if out is None else out.unionByName(part)
    return out


@_add("wide_distance_matrix")
def _(spark, d):
    wide = stats.wide_matrix(stats.distance_matrix(_daily(spark, d)[0], 1))
    return rounded(wide, *wide.columns[1:])


# ---------------------------------------------------------------- meshes, spheres and files, row by row
@_add("barycentric_points")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    return rounded(meshing.barycentric_subdivision(v, c)[0].select("parent_dim", "x", "y"), "x", "y")


@_add("mesh_subdivision_points")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    return rounded(meshing.subdivide(v, c)[0].select("key", "x", "y"), "x", "y")


@_add("quad_subdivision_points")
def _(spark, d):
    v, _, _ = day_hour_grid(spark, d)
    q = v.where("vid % 24 < 23 and vid < 720").select("ds", F.col("vid").alias("cid"), F.array(F.col("vid"), F.col("vid") + 1, F.col("vid") + 25, F.col("vid") + 24).alias("verts"))
    return rounded(meshing.quad_subdivision(v, q, 1)[0].select("x", "y"), "x", "y")


@_add("periodic_neighbours")
def _(spark, d):
    g = incidence.Grid(24, 31, periodic=True)
    return g.neighbours(g.vertices(spark)).select("a", "b")


@_add("sphere_vertices")
def _(spark, d):
    out = rounded(generators.spheres_at(_cloud(spark, d), 8, 8, 0.01)[0], "x", "y", "z")
    return out.select("vid", "point", *((F.col(c) + 0.0).alias(c) for c in "xyz"))


@_add("mesh_graph_points")
def _(spark, d):
    return rounded(meshing.mesh_graph(*_nation_graph(spark, d), subdivisions=2)[0], "x", "y", "z")


@_add("catalogue_upsert_old_and_new")
def _(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_size", "p_name", "p_retailprice", F.col("p_partkey").alias("_order"))
    keys, even = ["p_brand", "p_size"], F.col("_order") % 2 == 0
    old = catalogue.upserted(p.drop("_order").limit(0), p.where(even), keys)
    return catalogue.upserted(old, p.where(~even), keys)


@_add("off_round_trip")
def _(spark, d):
    v, c, _ = day_hour_grid(spark, d)
    path = storage.fresh_path(spark, "mesh")
    meshes.write_off(v.select("vid", "x", "y", "z"), c.select("cid", "verts"), path)
    v, c = meshes.read_off(spark, path)
    corners = F.array(*(F.col(k).cast("double") for k in "xyz"))
    return v.select(F.lit("vertex").alias("kind"), F.col("vid").alias("id"), corners.alias("parts")).unionByName(c.select(F.lit("cell").alias("kind"), F.col("cid").alias("id"), F.col("verts").cast("array<double>").alias("parts")))


@_add("catalogue_round_trip")
def _(spark, d):
    path = storage.fresh_path(spark, "products") + "/nations.cdb"
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    catalogue.write_products(n, path, ["region"])
    return catalogue.read_products(catalogue.read_catalogue(spark, path)).select("region", "nation", "name")


SQL.update(oracles.SQL)
