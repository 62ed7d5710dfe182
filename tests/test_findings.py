"""Cases that once went wrong: columns by name, one ds beside another, rounds that ran out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isofold.functions import storage
from isofold.operators import bivariate, columns, diagrams, graph, incidence, kernels, mergetrees, separatrices, stats, topology
from isofold.sources import catalogue


def two_fields(spark, cells_too=True):
    """Two meshes with the same ids: in ds 0 a path in two parts, in ds 1 the part between them as well."""
    v = [(ds, i, float(i % 3), float(i), 0.0, 0.0) for ds in (0, 1) for i in range(6)]
    c = [(0, k, [k, k + 1]) for k in (0, 1, 3, 4)] + [(1, k, [k, k + 1]) for k in range(5)]
    return spark.createDataFrame(v, "ds long, vid long, value double, x double, y double, z double"), spark.createDataFrame(c, "ds long, cid long, verts array<long>")


def test_components_of_each_ds(spark):
    v, c = two_fields(spark)
    vertices, cells = graph.cell_components(c, v)
    assert {(r["ds"], r["vid"]): (r["RegionId"], r["VertexNumber"], r["CellNumber"]) for r in vertices.collect()} == {(0, i): (i // 3 * 3, 3, 2) for i in range(6)} | {(1, i): (0, 6, 5) for i in range(6)}
    assert {(r["ds"], r["cid"]): r["RegionId"] for r in cells.collect()} == {(0, 0): 0, (0, 1): 0, (0, 3): 3, (0, 4): 3} | {(1, k): 0 for k in range(5)}


def test_reeb_graph_of_each_ds(spark):
    v, c = two_fields(spark)
    both = {(r["ds"], r["slab"], r["component"], r["n"]) for r in topology.reeb_graph(v, c, 1)["nodes"].collect()}
    assert both == {(0, 0, 0, 3), (0, 0, 3, 3), (1, 0, 0, 6)}
    alone = {(r["ds"], r["slab"], r["component"], r["n"]) for r in topology.reeb_graph(v.where("ds = 0"), c.where("ds = 0"), 3)["nodes"].collect()}
    beside = {(r["ds"], r["slab"], r["component"], r["n"]) for r in topology.reeb_graph(v, c, 3)["nodes"].where("ds = 0").collect()}
    assert alone == beside


def test_contours_of_each_ds(spark):
    v, c = two_fields(spark)
    points = spark.createDataFrame([(0, 7, 0, 0.5), (1, 8, 0, 0.5)], "ds long, pid long, vid long, isovalue double")
    out = {(r["ds"], r["pid"], r["cid"]) for r in topology.contour_around_point(v, c, points).collect()}
    assert out == {(0, 7, 0), (1, 8, 0)}
    assert {r["ds"] for r in topology.contour_around_point(v, c, points.drop("ds").where("pid = 7")).collect()} == {0, 1}


def test_reeb_space_of_each_ds(spark):
    tets = [(0, 0, [0, 1, 2, 3]), (1, 0, [0, 1, 2, 3]), (1, 1, [1, 2, 3, 4])]
    at = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 1.0)]
    v = spark.createDataFrame([(ds, i, *p, float(i), float(-i * ds)) for ds in (0, 1) for i, p in enumerate(at) if ds or i < 4], "ds long, vid long, x double, y double, z double, u double, v double")
    c = spark.createDataFrame(tets, "ds long, cid long, verts array<long>")
    out = bivariate.reeb_space(v, c, bins=1)["sheets3"].collect()
    assert {(r["ds"], r["sheet3"], r["cells"]) for r in out} == {(0, 0, 1), (1, 0, 2)}


def test_catalogue_columns_by_name(spark, tmp_path):
    """A catalogue whose columns stand in another order keeps its values in theirs."""
    path = f"{tmp_path}/x.cdb"
    (tmp_path / "x.cdb").mkdir()
    (tmp_path / "x.cdb" / "data.csv").write_text("b,FILE,a\n1,data/one,2\n")
    catalogue.write_products(spark.createDataFrame([(5, 6, 0.5)], "a int, b int, value double"), path, ["a", "b"])
    rows = {(r["a"], r["b"]): r["FILE"] for r in catalogue.read_catalogue(spark, path).collect()}
    assert set(rows) == {(2, 1), (5, 6)} and rows[2, 1].endswith("data/one")


def test_upsert_replaces_keeps_and_adds(spark):
    old = spark.createDataFrame([(1, "a", 0.1), (2, "b", 0.2), (None, "n", 0.3)], "k int, name string, x double")
    new = spark.createDataFrame([(0.9, 2, "B", 1), (0.8, 2, "b2", 2), (0.7, 3, "c", 1), (0.6, None, "m", 1)], "x double, k int, name string, _order int")
    out = catalogue.upserted(old, new, ["k"])
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, "a", 0.1), (2, "b2", 0.8), (3, "c", 0.7), (None, "m", 0.6)]))


def test_distance_over_many_rounds(spark):
    """A path longer than any former bound on rounds between two cleanings; all is reached, ties go to the smaller index."""
    n = 60
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "a long, b long, w double")
    v = spark.range(n + 1).withColumnRenamed("id", "vid")
    s = spark.createDataFrame([(0, 5), (n, 2)], "vid long, index long")
    out = {r["vid"]: (r["distance"], r["source"]) for r in graph.distance_field(e, s, v).collect()}
    assert out == {i: (float(min(i, n - i)), 0 if i < n - i else n) for i in range(n + 1)}
    near = {r["vid"]: r["distance"] for r in graph.distance_field(e, s, v, bound=3.0).collect()}
    assert near == {i: (float(min(i, n - i)) if min(i, n - i) <= 3 else None) for i in range(n + 1)}


def test_simplification_says_when_rounds_do_not_do():
    values = np.array([0.0, 3.0, 1.0, 4.0, 2.0, 5.0, 0.5])
    starts, nbrs = kernels.adjacency(7, np.arange(6), np.arange(1, 7))
    order = kernels.dense_order(values, np.arange(7))
    with pytest.raises(ValueError):
        kernels.simplify(values, order, starts, nbrs, {0, 5}, rounds=0)
    new, rank = kernels.simplify(values, order, starts, nbrs, {0, 5, 6})
    inner = [v for v in range(1, 6) if (rank[v] - rank[v - 1]) * (rank[v] - rank[v + 1]) > 0]
    assert inner == [5]


def test_branches_nearly_as_persistent_as_their_parent_go_up():
    """eps2 is the part of the parent's persistence that may lack; eps3 keeps the most persistent ones where they are."""
    tree = mergetrees.Tree(np.array([0.0, 1.0, 1.2, 1.25]), np.array([10.0, 9.0, 8.9, 2.0]), np.array([0, 0, 1, 2]))
    up = lambda **o: mergetrees.preprocessed(tree, mergetrees.Options(**o)).parent.tolist()
    assert up() == [0, 0, 1, 2] and up(eps2=5.0) == [0, 0, 0, 2] and up(eps2=5.0, eps3=70.0) == [0, 0, 1, 2] and up(eps2=3.0) == [0, 0, 1, 2]
    assert up(eps2=100.0) == [0, 0, 0, 0]
    assert up(eps1=2.0, farthest=True) == [0, 0, 0, 2] and up(eps1=0.5, farthest=True) == [0, 0, 1, 2]


def test_threshold_has_a_tolerance():
    tree = mergetrees.Tree(np.array([0.0, 1.0, 1.0, 3.0]), np.array([10.0, 2.0 + 5e-7, 3.0, 3.0]), np.array([0, 0, 0, 0]))
    assert mergetrees.preprocessed(tree, mergetrees.Options(threshold=10.0)).birth.tolist() == [0.0, 1.0]
    assert len(mergetrees.preprocessed(tree, mergetrees.Options()).birth) == 3


@pytest.mark.parametrize("shape,rows", [((9, 7, 1), 0), ((9, 7, 1), 12), ((4, 4, 4), 3)])
def test_diagram_of_a_large_field_equals_the_sweep(spark, shape, rows):
    """Fields of three ds, one with ties and one in two parts, by joins alone or with a sweep of the last edges, against the sweep of each whole ds."""
    from isofold.operators import incidence

    rng = np.random.default_rng(sum(shape))
    g = incidence.Grid(*shape)
    n = shape[0] * shape[1] * shape[2]
    cells = [tuple(r["verts"]) for r in g.cells(spark).collect()]
    values = [rng.random(n), rng.integers(0, 4, n).astype(float), rng.random(n)]
    v = spark.createDataFrame([(ds, i, float(x)) for ds, f in enumerate(values) for i, x in enumerate(f)], "ds long, vid long, value double")
    half = lambda verts: all(x % shape[0] < 3 for x in verts) or all(x % shape[0] >= 3 for x in verts)
    c = spark.createDataFrame([(ds, k, list(map(int, verts))) for ds in range(3) for k, verts in enumerate(cells) if ds < 2 or half(verts)], "ds long, cid long, verts array<long>")
    want = sorted(map(tuple, topology.persistence_diagram(v, c).collect()))
    got = sorted(map(tuple, topology._diagram_at_large(v, c, 3 if shape[2] > 1 else 2, False, "value", None, rows).collect()))
    assert got == want
    # the last ds has parts, each with its own global pair; lone vertices are such parts
    assert sum(r[0] == 2 and r[4:6] == (0, 3) for r in want) == (17 if shape[2] > 1 else 2)


def test_large_fields_take_the_joins(spark, monkeypatch):
    v = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([0, 3, 1, 4, 2])], "ds long, vid long, value double")
    c = spark.createDataFrame([(0, i, [i, i + 1]) for i in range(4)], "ds long, cid long, verts array<long>")
    swept = sorted(map(tuple, topology.persistence_diagram(v, c).collect()))
    monkeypatch.setattr(topology, "per_field", None)
    assert sorted(map(tuple, topology.persistence_diagram(v, c, kernel_rows=4).collect())) == swept


def test_ways_by_doubled_jumps(spark):
    pointers = spark.createDataFrame([(i, i - 1 if i % 50 else None, 0.5) for i in range(200)], "v long, nxt long, w double")
    starts = spark.createDataFrame([(49,), (50,), (137,), (999,)], "start long")
    out = sorted((r["start"], r["step"], r["at"], r["length"]) for r in graph.walked(pointers, starts, "w").collect())
    want = [(s, k, s - k, 0.5 * k) for s in (49, 50, 137) for k in range(s % 50 + 1)] + [(999, 0, 999, 0.0)]
    assert out == sorted(want)


@pytest.fixture(scope="module")
def grid(spark, sf):
    from isofold.plans import registry

    v, c, _ = registry.day_hour_grid(spark, sf)
    return {r["vid"]: r["value"] for r in v.collect()}, [tuple(sorted(r["verts"])) for r in c.collect()]


def test_gradient_query_is_a_discrete_morse_function(spark, sf, grid):
    """Each simplex is in one pair or critical; paths don't close; critical vertices are the minima; their counts give the Euler characteristic."""
    from isofold.plans.registry import QUERIES

    values, tris = grid
    edges = {(t[i], t[j]) for t in tris for i, j in ((0, 1), (0, 2), (1, 2))}
    rows = QUERIES["discrete_gradient"](spark, sf).collect()
    seen = [tuple(sorted(r["cell"])) for r in rows] + [tuple(sorted(r["paired"])) for r in rows if r["paired"]]
    assert sorted(seen) == sorted([(v,) for v in values] + list(edges) + tris)
    assert all(set(r["cell"]) < set(r["paired"]) and len(r["paired"]) == len(r["cell"]) + 1 for r in rows if r["paired"])
    critical = [sorted(r["cell"]) for r in rows if not r["paired"]]
    assert sum((-1) ** (len(c) - 1) for c in critical) == len(values) - len(edges) + len(tris) == 1
    key = lambda v: (values[v], v)
    near = {v: set() for v in values}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    assert {c[0] for c in critical if len(c) == 1} == {v for v in values if all(key(u) > key(v) for u in near[v])}
    for dim in (1, 2):
        pair = {tuple(sorted(r["cell"])): tuple(sorted(r["paired"])) for r in rows if r["paired"] and len(r["cell"]) == dim}
        state = {}

        def follow(cell):
            stack = [(cell, iter(()))]
            while stack:
                at, rest = stack[-1]
                if at not in state:
                    state[at] = 1
                    co = pair.get(at)
                    faces = [tuple(x for x in co if x != y) for y in co] if co else []
                    stack[-1] = (at, iter([f for f in faces if f != at]))
                    continue
                nxt = next(rest, None)
                if nxt is None:
                    state[at] = 2
                    stack.pop()
                else:
                    assert state.get(nxt) != 1
                    if nxt not in state:
                        stack.append((nxt, iter(())))

        for cell in pair:
            if cell not in state:
                follow(cell)


def test_separatrix_query_equals_plain_walks(spark, sf):
    from isofold.plans.registry import QUERIES

    rows = QUERIES["discrete_gradient"](spark, sf).collect()
    down = {r["cell"][0]: next(x for x in r["paired"] if x != r["cell"][0]) for r in rows if r["dim"] == 0 and r["paired"]}
    want = set()
    for r in rows:
        if r["dim"] == 1 and not r["paired"]:
            for side, v in enumerate(r["cell"]):
                step = 0
                while True:
                    want.add((tuple(r["cell"]), side, step, v))
                    if v not in down:
                        break
                    v, step = down[v], step + 1
    out = [(tuple(r["saddle"]), r["side"], r["step"], r["vid"]) for r in QUERIES["morse_smale_separatrices"](spark, sf).collect()]
    assert len(out) == len(want) and set(out) == want


def test_harmonic_query_equals_a_dense_solve(spark, sf, grid):
    from isofold.plans.registry import QUERIES

    values, tris = grid
    n = len(values)
    m = np.zeros((n, n))
    for a, b in {(t[i], t[j]) for t in tris for i, j in ((0, 1), (0, 2), (1, 2))}:
        m[a, b] = m[b, a] = -1
    m -= np.diag(m.sum(1))
    right = np.zeros(n)
    for v in (0, 743):
        m[v, v] += 1e5
        right[v] = 1e5 * values[v]
    want = np.linalg.solve(m, right)
    out = {r["vid"]: r["value"] for r in QUERIES["harmonic_field"](spark, sf).collect()}
    assert len(out) == n and all(abs(out[v] - want[v]) < 2e-4 for v in out)


def test_contour_query_equals_a_plain_search(spark, sf, grid):
    from isofold.plans.registry import QUERIES

    values, tris = grid
    near = {v: set() for v in values}
    for t in tris:
        for v in t:
            near[v] |= set(t) - {v}
    key = lambda v: (values[v], v)
    tops = [v for v in values if all(key(u) < key(v) for u in near[v])]
    cross = [k for k, t in enumerate(tris) if min(values[v] for v in t) <= 25.0 < max(values[v] for v in t)]
    of = {}
    for k in cross:
        for v in tris[k]:
            of.setdefault(v, []).append(k)
    part = {}
    for k in cross:
        if k not in part:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in part:
                    part[x] = k
                    todo += [y for v in tris[x] for y in of[v] if y not in part]
    out = {}
    for r in QUERIES["contour_around_point"](spark, sf).collect():
        out.setdefault(r["pid"], set()).add(r["cid"])
    assert set(out) == set(tops)
    for v in tops:
        d = {k: sum((v % 24 - sum(u % 24 for u in tris[k]) / 3) ** 2 for _ in (0,)) + (v // 24 - sum(u // 24 for u in tris[k]) / 3) ** 2 for k in cross}
        best = min(d.values())
        assert out[v] in [{x for x in cross if part[x] == part[k]} for k in cross if d[k] <= best + 1e-9]


def test_randomized_identifiers_are_a_bijection(spark, sf):
    from isofold.plans.registry import QUERIES

    own = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    new = {r["o_orderkey"]: r["o_custkey"] for r in QUERIES["randomize_identifiers"](spark, sf).collect()}
    to = {own[k]: new[k] for k in own}
    assert set(new) == set(own) and all(new[k] == to[own[k]] for k in own) and sorted(to.values()) == list(range(len(to))) and to != {c: i for i, c in enumerate(sorted(to))}


def test_products_of_one_name_in_two_folders(spark, tmp_path):
    root = tmp_path / "p.cdb"
    for folder in ("a", "b"):
        (root / "data" / folder).mkdir(parents=True)
        (root / "data" / folder / "x.csv").write_text(f"u\n{folder}1\n{folder}2\n")
    (root / "data.csv").write_text("k,FILE\n1,data/a/x.csv\n2,data/b/x.csv\n")
    rows = catalogue.read_products(catalogue.read_catalogue(spark, str(root)))
    assert sorted((r["k"], r["u"]) for r in rows.collect()) == [(1, "a1"), (1, "a2"), (2, "b1"), (2, "b2")]


def test_keys_that_read_alike_stay_apart(spark, tmp_path):
    path = f"{tmp_path}/q.cdb"
    keys = [("a b", "c"), ("a-b", "c"), ("a_b", "c"), ("a", "b_c"), ("A b", "c"), ("a%20b", "c"), ("a+b", "é/ü"), ("", ""), ("x", None)]
    catalogue.write_products(spark.createDataFrame([(*k, float(i)) for i, k in enumerate(keys)], "k string, l string, v double"), path, ["k", "l"])
    files = {r["FILE"] for r in catalogue.read_catalogue(spark, path).collect()}
    assert len(files) == len({f.lower() for f in files}) == len(keys)
    assert sorted(r["v"] for r in catalogue.read_products(catalogue.read_catalogue(spark, path)).collect()) == [float(i) for i in range(len(keys))]


def test_each_ds_has_its_own_scatter_plot(spark):
    corner = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    v = spark.createDataFrame([(ds, i, *(c * (ds + 1) for c in p), p[0] * (ds + 1), p[1] - ds) for ds in (0, 1) for i, p in enumerate(corner)], "ds long, vid long, x double, y double, z double, u double, v double")
    cells = spark.createDataFrame([(0, 0, [0, 1, 2, 3]), (1, 0, [0, 1, 2, 3])], "ds long, cid long, verts array<long>")
    mass = {r["ds"]: r["m"] for r in stats.continuous_scatter(v, cells, "u", "v", (4, 4)).groupBy("ds").agg(F.sum("density").alias("m")).collect()}
    assert abs(mass[0] - 1 / 6) < 1e-12 and abs(mass[1] - 8 / 6) < 1e-12


def test_points_of_two_ds_neither_merge_nor_interpolate_each_other(spark):
    pts = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (1, 0, 0.0, 0.0, 0.0), (1, 1, 0.01, 0.0, 0.0), (0, 1, 5.0, 0.0, 0.0)], "ds long, vid long, x double, y double, z double")
    out = {(r["ds"], r["vid"]): (r["merged_to"], r["VertexMergeCount"]) for r in graph.merge_points(pts, 0.1).collect()}
    assert out == {(0, 0): (0, 0), (0, 1): (1, 0), (1, 0): (0, 1), (1, 1): (0, 0)}
    v = spark.createDataFrame([(ds, i, x, y, f) for ds in (0, 1) for i, (x, y, f) in enumerate([(0.0, 0.0, 1.0 + ds), (1.0, 0.0, 1.0 + ds), (0.0, 1.0, 1.0 + ds)])], "ds long, vid long, x double, y double, f double")
    cells = spark.createDataFrame([(0, 0, [0, 1, 2]), (1, 0, [0, 1, 2])], "ds long, cid long, verts array<long>")
    at = spark.createDataFrame([(0, 7, 0.2, 0.2), (1, 7, 0.2, 0.2), (1, 8, 3.0, 3.0)], "ds long, id long, x double, y double")
    found = {(r["ds"], r["id"]): r["f"] for r in columns.interpolate(at, v, cells, ["f"], 1.0).collect()}
    assert found[0, 7] == pytest.approx(1.0) and found[1, 7] == pytest.approx(2.0) and found[1, 8] is None


def test_barycenters_say_when_rounds_do_not_do(spark):
    fields = [[0, 5, 2, 6, 1, 4, 0.5], [0, 9, 3, 7, 1, 5, 2], [1, 4, 0, 8, 2, 3, 1]]
    v = spark.createDataFrame([(ds, i, float(x)) for ds, f in enumerate(fields) for i, x in enumerate(f)], "ds long, vid long, value double")
    trees = mergetrees.branch_trees(v, incidence.path_cells(v, "vid"))
    with pytest.warns(UserWarning, match="still changes after 1 rounds"):
        once = mergetrees.barycenter(trees, rounds=1)[1]
    assert mergetrees.barycenter(trees)[1] <= once
    with pytest.warns(UserWarning, match="still falls after 0 rounds"):
        diagrams.barycenter_of([{0: np.array([[0.0, 2.0]])}, {0: np.array([[0.0, 4.0]])}], rounds=0)


# ---------------------------------------------------------------- round 3
def test_edges_of_many_paths_are_not_broadcast(spark):
    from isofold.operators import fields
    from isofold.plans.registry import path_edges

    v = spark.range(0, 20_000, 1, 4).select(F.expr("id div 50").alias("ds"), (F.col("id") % 50).alias("vid"), F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double").alias("value"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # more than a count for each ds, less than the edges
    try:
        c = path_edges(v)
        assert c.count() == 400 * 49
        out = fields.smooth(v, incidence.neighbours(c), ["value"])
        got = {(r["ds"], r["vid"]): r["value"] for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    value = lambda ds, vid: float((ds * 50 + vid) * 7919 % 1009)
    assert len(got) == 20_000 and got[7, 0] == value(7, 1) and got[7, 20] == (value(7, 19) + value(7, 21)) / 2 and got[399, 49] == value(399, 48)
    assert "Broadcast" not in plan


def test_paths_of_more_than_sixteen_steps_are_followed(spark):
    # a ladder of 40 rungs: from each x two ways to x + 1 and one to x + 2
    starts = spark.createDataFrame([(0, "s", 0), (1, "s", 30)], "ds long, saddle string, x long")
    steps = spark.createDataFrame([(ds, x, y) for ds in (0, 1) for x in range(40) for y in (x + 1, x + 1, x + 2)], "ds long, x long, y long")
    ways = {(0, 0): 1, (1, 30): 1}
    for ds, first in ((0, 0), (1, 30)):
        for x in range(first + 1, 42):
            ways[ds, x] = 2 * (ways.get((ds, x - 1), 0) if x <= 40 else 0) + ways.get((ds, x - 2), 0)
    got = {(r["ds"], r["x"]): (r["paths"], r["odd"]) for r in separatrices._followed(starts, steps).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: min(n, separatrices.MOST_PATHS) for k, n in ways.items() if n}
    assert all(odd == ways[k] % 2 for k, (_, odd) in got.items())


def test_small_fields_share_a_call(spark):
    from isofold.plans.registry import path_edges

    # ds of 1 to 9 vertices, those of one without an edge
    v = spark.range(300).select((F.col("id") * 3).alias("ds"), F.explode(F.expr("sequence(0L, id % 9)")).alias("vid")).withColumn("value", F.pmod(F.col("ds") * 31 + F.col("vid") * 17, F.lit(23)).cast("double"))
    c = path_edges(v)

    def kernel(ds, f, e):
        # an edge's place in the frame that Python got: a call for each ds would have all of them begin at 0
        return pd.DataFrame({"ds": [ds], "n": [len(f.ids)], "edges": [len(e)], "near": [len(f.nbrs)], "at": [int(e.index.min()) if len(e) else -1], "total": [float(f.values.sum())]})

    got = {r["ds"]: r for r in topology.per_field(v, c, kernel, "ds long, n long, edges long, near long, at long, total double").collect()}
    assert len(got) == 300
    for i in range(300):
        r, n = got[3 * i], i % 9 + 1
        assert (r["n"], r["edges"], r["near"]) == (n, n - 1, 2 * (n - 1)) and r["total"] == sum((93 * i + 17 * k) % 23 for k in range(n))
    assert sum(r["at"] > 0 for r in got.values()) > 200


def test_distances_leave_out_edges_to_what_is_reached(spark, monkeypatch):
    written = []

    def settled(df, name="step"):
        out = storage.settled(df, name)
        written.extend([out.count()] if name == "edges" else [])
        return out

    monkeypatch.setattr(graph, "settled", settled)
    e = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(20, 21)], "a long, b long")
    v, s = spark.range(9).union(spark.createDataFrame([(20,), (21,)], "id long")).withColumnRenamed("id", "vid"), spark.createDataFrame([(2, 5), (6, 1)], "vid long, index long")
    got = {r["vid"]: (r["distance"], r["source"], r["source_index"]) for r in graph.distance_field(e, s, v, None).collect()}
    # 4 lies between both sources: the smaller index has it
    assert got == {0: (2.0, 2, 5), 1: (1.0, 2, 5), 2: (0.0, 2, 5), 3: (1.0, 2, 5), 4: (2.0, 6, 1), 5: (1.0, 6, 1), 6: (0.0, 6, 1), 7: (1.0, 6, 1), 8: (2.0, 6, 1), 20: (None, None, None), 21: (None, None, None)}
    assert written[0] == 18 and written[-1] == 2 and written == sorted(written, reverse=True) and len(written) == 4


def test_means_with_neighbours_of_many_paths_are_not_broadcast(spark):
    from isofold.operators import fields
    from isofold.plans.registry import path_edges

    v = spark.range(0, 20_000, 1, 4).select(F.expr("id div 50").alias("ds"), (F.col("id") % 50).alias("vid"), (F.col("id") % 7).cast("double").alias("value"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        out = fields.average_with_neighbours(v, incidence.neighbours(path_edges(v)), "value")
        got = {(r["ds"], r["vid"]): r["value"] for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(got) == 20_000 and got[0, 0] == 0.5 and got[0, 3] == 3.0
    assert "Broadcast" not in plan


def _strip(spark, steps):
    """A gradient on a strip of triangles (i, i + 1, i + 2): from the critical triangle 0 one path leads over all others to a critical edge."""
    pairs = [(0, 1, [i + 1, i + 2], [i + 1, i + 2, i + 3]) for i in range(steps)]
    return spark.createDataFrame([*pairs, (0, 2, [0, 1, 2], None), (0, 1, [steps + 1, steps + 2], None)], "ds long, dim int, cell array<bigint>, paired array<bigint>")


def test_saddles_are_paired_over_paths_of_more_than_sixteen_steps(spark):
    v = spark.range(25).select(F.lit(0).cast("long").alias("ds"), F.col("id").alias("vid"), (-F.col("id")).cast("double").alias("value"))
    out = separatrices.saddle_saddle_pairs(v, None, gradient=_strip(spark, 20)).collect()
    assert [(r["ds"], r["birth_vid"], r["death_vid"], r["birth"], r["death"], r["persistence"]) for r in out] == [(0, 21, 0, -21.0, 0.0, 21.0)]


def test_saddle_pairs_take_gradient_and_ranks_from_one_reading(spark, sf, monkeypatch):
    from isofold.plans import registry

    table, read = registry.table, spark.sparkContext.accumulator(0)

    def counted(spark, d, name):
        def each(batches):
            for b in batches:
                read.add(len(b))
                yield b

        t = table(spark, d, name)
        return t.mapInPandas(each, t.schema) if name == "orders" else t

    monkeypatch.setattr(registry, "table", counted)
    assert len(registry.QUERIES["volume_saddle_pairs"](spark, sf).collect()) > 20
    assert read.value == table(spark, sf, "orders").count()


def test_walls_go_on_after_sixteen_steps(spark):
    out = {(tuple(r["saddle"]), tuple(r["triangle"])) for r in separatrices.descending_walls(_strip(spark, 20)).collect()}
    assert out == {((0, 1, 2), (i, i + 1, i + 2)) for i in range(21)}


def _paths_in_files(spark, tmp_path):
    """Paths of 50 vertices each, whose files are far below what Spark broadcasts."""
    from isofold.plans.registry import path_edges

    v = spark.range(0, 2_000, 1, 2).select(F.expr("id div 50").alias("ds"), (F.col("id") % 50).alias("vid"), F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double").alias("value"))
    v.withColumns({"x": F.col("vid").cast("double"), "y": F.lit(0.0), "z": F.lit(0.0)}).write.parquet(f"{tmp_path}/v")
    v = spark.read.parquet(f"{tmp_path}/v")
    return v, path_edges(v), lambda ds, vid: (ds * 50 + vid) * 7919 % 1009


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extrema_do_not_broadcast_vertices_of_small_files(spark, tmp_path):
    v, c, value = _paths_in_files(spark, tmp_path)
    out = topology.extrema(v, incidence.neighbours(c))
    assert "Broadcast" not in _plan(out)
    want = {}
    for ds in range(40):
        for i in range(50):
            near = [(value(ds, j), j) for j in (i - 1, i + 1) if 0 <= j < 50]
            own = (value(ds, i), i)
            if own < min(near) or own > max(near):
                want[ds, i] = (float(own[0]), kernels.MINIMUM if own < min(near) else kernels.MAXIMUM)
    assert {(r["ds"], r["vid"]): (r["value"], r["CriticalType"]) for r in out.collect()} == want


def _noted(monkeypatch, module):
    """Plans of what the module's loops write."""
    plans = []

    def settled(df, name="step"):
        plans.append(_plan(df))
        return storage.settled(df, name)

    monkeypatch.setattr(module, "settled", settled)
    return plans


def test_lines_do_not_broadcast_pointers_of_small_files(spark, tmp_path, monkeypatch):
    v, c, value = _paths_in_files(spark, tmp_path)
    plans = _noted(monkeypatch, graph)
    out = topology.integral_lines(v, incidence.neighbours(c), v.where("vid % 7 = 3"))
    got = {(r["ds"], r["seed"], r["step"]): (r["vid"], r["DistanceFromSeed"]) for r in out.collect()}
    assert len(plans) > 4 and not any("Broadcast" in p for p in [*plans, _plan(out)])
    want = {}
    for ds in range(40):
        for seed in range(3, 50, 7):
            at, step = seed, 0
            while True:
                want[ds, seed, step] = (at, float(step))
                low = [(value(ds, j) - value(ds, at), (value(ds, j), j), j) for j in (at - 1, at + 1) if 0 <= j < 50 and (value(ds, j), j) < (value(ds, at), at)]
                if not low:
                    break
                at, step = min(low)[2], step + 1
    assert got == want


def test_segmentation_does_not_broadcast_pointers_of_small_files(spark, tmp_path, monkeypatch):
    v, c, value = _paths_in_files(spark, tmp_path)
    plans, steps = _noted(monkeypatch, graph), _noted(monkeypatch, topology)
    out = topology.segmentation(v, incidence.neighbours(c))
    got = {(r["ds"], r["vid"]): (r["AscendingManifold"], r["DescendingManifold"]) for r in out.collect()}
    assert len(steps) == 1 and not any("Broadcast" in p for p in [*plans, *steps, _plan(out)])

    def end(at, best):
        while True:
            to = best(j for j in (at - 1, at, at + 1) if 0 <= j < 50)
            if to == at:
                return at
            at = to

    for ds in range(40):
        key = lambda j, ds=ds: (value(ds, j), j)
        for i in range(50):
            low, high = end(i, lambda near: min(near, key=key)), end(i, lambda near: max(near, key=key))
            assert got[ds, i] == (low, high)


def test_means_with_neighbours_do_not_broadcast_vertices_of_small_files(spark, tmp_path):
    from isofold.operators import fields

    v, c, value = _paths_in_files(spark, tmp_path)
    v = v.select("ds", "vid", F.when(F.col("vid") % 5 != 2, F.col("value")).alias("value"))  # a null counts in no mean
    out = fields.average_with_neighbours(v, incidence.neighbours(c.where("ds > 0")), "value")
    assert "Broadcast" not in _plan(out)
    got = {(r["ds"], r["vid"]): r["value"] for r in out.collect()}
    # without edges each keeps its own
    assert len(got) == 2_000 and all(got[0, i] == (value(0, i) if i % 5 != 2 else None) for i in range(50))
    for ds in range(1, 40):
        for i in range(50):
            near = [value(ds, j) for j in (i - 1, i, i + 1) if 0 <= j < 50 and j % 5 != 2]
            assert got[ds, i] == pytest.approx(sum(near) / len(near))
