import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isofold.operators import diagrams, graph, incidence, kernels, mergetrees, topology
from isofold.operators.assign import bottleneck, diagonal_assignment, hungarian


def path(spark, *fields):
    v = spark.createDataFrame([(ds, i, float(x)) for ds, f in enumerate(fields) for i, x in enumerate(f)], "ds long, vid long, value double")
    return v, incidence.path_cells(v, "vid")


def test_path_diagram(spark):
    v, c = path(spark, [0, 3, 1, 4, 2])
    rows = {(r["birth_vid"], r["death_vid"]): r["persistence"] for r in topology.persistence_diagram(v, c).collect()}
    assert rows == {(2, 1): 2.0, (4, 3): 2.0, (0, 3): 4.0} | {(2, 1): 2.0}
    kinds = {r["vid"]: r["CriticalType"] for r in topology.critical_points(v, c).collect()}
    assert kinds == {0: 0, 1: 3, 2: 0, 3: 3, 4: 0}
    curve = {(r["curve"], r["Persistence"]): r["NumberOfPairs"] for r in topology.persistence_curve(topology.persistence_diagram(v, c)).collect()}
    assert curve[("all", 4.0)] == 1 and max(curve.values()) == topology.persistence_diagram(v, c).count()


def test_flat_field_is_ordered_by_id(spark):
    v, c = path(spark, [1, 1, 1, 1])
    assert {r["vid"]: r["CriticalType"] for r in topology.critical_points(v, c).collect()} == {0: 0, 3: 3}
    assert {r["vid"]: r["CriticalType"] for r in topology.extrema(v, incidence.neighbours(c)).collect()} == {0: 0, 3: 3}


def test_nan_counts_as_zero(spark):
    a, c = path(spark, [0, 3, float("nan"), 4, 2])
    b, _ = path(spark, [0, 3, 0, 4, 2])
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(topology.persistence_diagram(a, c)) == key(topology.persistence_diagram(b, c))


def bumps(spark, n=9, m=8):
    g = incidence.Grid(n, m)
    rng = np.random.default_rng(2)
    vals = rng.normal(size=n * m)
    v = g.vertices(spark).join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(vals)], "vid long, value double"), "vid").select("ds", "vid", "x", "y", "z", "value")
    return g, v, g.cells(spark), vals


def test_euler_characteristic_and_gradient(spark):
    g, v, c, _ = bumps(spark)
    n = {r["dim"]: r["n"] for r in incidence.counts(v, c).collect()}
    assert n[0] - n[1] + n[2] == 1
    critical = {r["dim"]: r["count"] for r in topology.discrete_gradient(v, c).where("paired is null").groupBy("dim").count().collect()}
    assert critical[0] - critical[1] + critical.get(2, 0) == 1
    assert topology.discrete_gradient(v, c).where("dim = 0 and paired is null").count() == topology.extrema(v, g.neighbours(v)).where("CriticalType = 0").count()
    assert topology.critical_points(v, c).where("CriticalType in (0, 3)").count() == topology.extrema(v, g.neighbours(v)).count()


def test_split_tree_is_join_tree_of_negated(spark):
    _, v, c, _ = bumps(spark)
    turned = v.withColumn("value", -F.col("value"))
    key = lambda df: {frozenset((r["downNodeId"], r["upNodeId"])) for r in df.collect()}
    assert key(topology.merge_tree(v, c, "split")["arcs"]) == key(topology.merge_tree(turned, c, "join")["arcs"])
    seg = topology.merge_tree(v, c, "join")["segmentation"]
    assert seg.count() == 72 and seg.where("SegmentationId is null").count() == 0


def test_contour_tree_is_a_tree(spark):
    _, v, c, _ = bumps(spark)
    arcs = topology.merge_tree(v, c, "contour")["arcs"].collect()
    nodes = {x for r in arcs for x in (r["downNodeId"], r["upNodeId"])}
    assert len(arcs) == len(nodes) - 1
    leaves = {r["vid"] for r in topology.extrema(v, incidence.neighbours(c)).collect()}
    assert leaves <= nodes


def test_segmentation_ends_in_extrema(spark):
    g, v, c, _ = bumps(spark)
    kinds = {r["vid"]: r["CriticalType"] for r in topology.extrema(v, g.neighbours(v)).collect()}
    for r in topology.segmentation(v, g.neighbours(v)).collect():
        assert kinds[r["AscendingManifold"]] == 0 and kinds[r["DescendingManifold"]] == 3
    lines = topology.integral_lines(v, g.neighbours(v), v.where("vid % 10 = 0").select("ds", "vid")).toPandas()
    ends = lines.sort_values("step").groupby("seed").last()
    assert all(kinds[e] == 0 for e in ends["vid"])


def test_simplification_keeps_only_what_it_should(spark):
    g, v, c, _ = bumps(spark)
    pairs = topology.persistence_diagram(v, c)
    keep = pairs.where("birth_type = 0 and death_type = 3").select("ds", F.explode(F.array("birth_vid", "death_vid")).alias("vid"))
    s = topology.simplified(v, c, keep)
    left = {r["vid"] for r in topology.extrema(s, g.neighbours(v), "value", "offset").collect()}
    assert left == {r["vid"] for r in keep.collect()}


def test_incidence(spark):
    g = incidence.Grid(2, 2, 2)
    v, c = g.vertices(spark), g.cells(spark)
    assert c.count() == 6
    n = {r["dim"]: r["n"] for r in incidence.counts(v, c).collect()}
    assert n == {0: 8, 1: 19, 2: 18, 3: 6}
    assert incidence.boundary(c, 0).count() == 8 and incidence.boundary(c, 2).count() == 12
    assert incidence.request(c, "star", [0, 7]).count() == 6 and incidence.request(c, "link", [0, 7]).count() == 6
    assert incidence.request(c, "facet", [0, 1, 7]).count() == 3 and incidence.request(c, "cofacet", [0, 1]).count() == 3
    torus = incidence.Grid(4, 4, periodic=True)
    t = {r["dim"]: r["n"] for r in incidence.counts(torus.vertices(spark), torus.cells(spark)).collect()}
    assert t[0] - t[1] + t[2] == 0 and incidence.boundary(torus.cells(spark), 0).count() == 0
    assert torus.neighbours(torus.vertices(spark)).count() == 2 * t[1]


def test_pointers_and_distances(spark):
    p = spark.createDataFrame([(i, i - 1 if i % 50 else None, 2.0) for i in range(200)], "v long, nxt long, w double")
    got = {r["v"]: r for r in graph.roots(p, "w").collect()}
    assert all(got[i]["root"] == i - i % 50 and got[i]["steps"] == i % 50 and got[i]["length"] == 2.0 * (i % 50) for i in range(200))
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)] + [(0, 10, 2.5)], "a long, b long, w double")
    v = spark.range(25).withColumnRenamed("id", "vid")
    src = spark.createDataFrame([(0, 0), (20, 1)], "vid long, index long")
    d = {r["vid"]: (r["distance"], r["source"]) for r in graph.distance_field(e, src, v).collect()}
    assert d[10] == (2.5, 0) and d[8] == (4.5, 0) and d[18] == (2.0, 20) and d[24] == (None, None)


# ---------------------------------------------------------------- kernels
@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 6)), 6
    cost = rng.random((n, m))
    to, total = hungarian(cost)
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    assert abs(total - best) < 1e-9 and len(set(to.tolist())) == n
    square = rng.random((5, 5))
    _, worst = bottleneck(square)
    assert worst == min(max(square[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))


def test_diagram_distances():
    a, b = {0: np.array([[0.0, 4.0], [1.0, 2.0]])}, {0: np.array([[0.0, 5.0]])}
    assert diagrams.wasserstein(a, b, rooted=False) == 1.5
    assert diagrams.wasserstein(a, a) == 0 and diagrams.bottleneck(a, b) == 1.0
    rng = np.random.default_rng(0)
    some = [{0: np.sort(rng.random((4, 2)), 1)} for _ in range(3)]
    d = [[diagrams.wasserstein(x, y) for y in some] for x in some]
    assert all(abs(d[i][j] - d[j][i]) < 1e-12 and d[i][j] <= d[i][k] + d[k][j] + 1e-9 for i in range(3) for j in range(3) for k in range(3))
    pairs, total = diagonal_assignment(np.zeros((0, 2)), np.zeros(0), np.array([1.0, 2.0]))
    assert total == 3.0 and len(pairs) == 2


def test_distance_tables(spark):
    rng = random.Random(1)
    rows = [(ds, b, b + rng.random(), 0) for ds in range(20) for b in (rng.random() for _ in range(3))]
    df = spark.createDataFrame(rows, "ds long, birth double, death double, pair_type int")
    got = {(r["i"], r["j"]): r["dist"] for r in diagrams.by_block_pairs(df, lambda left, right, same: __import__("pandas").DataFrame([(min(i, j), max(i, j), diagrams.wasserstein(diagrams.as_diagram(x), diagrams.as_diagram(y))) for i, x in left.items() for j, y in right.items() if i < j or (not same and i > j)], columns=["i", "j", "dist"]), "i long, j long, dist double", block=4).collect()}
    full = {(r["i"], r["j"]): r["dist"] for r in diagrams.distance_matrix(df).collect()}
    assert len(got) == 190 and len(full) == 400 and all(abs(full[k] - v) < 1e-12 and abs(full[k[::-1]] - v) < 1e-12 for k, v in got.items())


def test_barycenter_of_equal_diagrams():
    a = {0: np.array([[0.0, 4.0], [1.0, 2.0]])}
    centre, energy = diagrams.barycenter_of([a, a, a])
    assert energy < 1e-12 and diagrams.wasserstein(centre, a) < 1e-9


def test_clusters_of_diagrams(spark):
    rows = [(ds, 0.0, 1.0 + 0.01 * ds + (10 if ds >= 4 else 0), 0) for ds in range(8)]
    got, centres = diagrams.cluster(spark.createDataFrame(rows, "ds long, birth double, death double, pair_type int"), 2)
    label = {r["ds"]: r["ClusterAssignment"] for r in got.collect()}
    assert len({label[i] for i in range(4)}) == 1 and len({label[i] for i in range(4, 8)}) == 1 and label[0] != label[7]
    assert centres.count() == 2


def branch(order_of):
    v = np.array(order_of, float)
    n = len(v)
    starts, nbrs = kernels.adjacency(n, np.arange(n - 1), np.arange(1, n))
    return mergetrees.branch_decomposition(kernels.dense_order(v, np.arange(n)), starts, nbrs, v, np.arange(n))


def test_branches_of_a_path():
    t = branch([0, 3, 1, 4, 2])
    got = {int(i): (b, d, int(t.ids[p])) for i, b, d, p in zip(t.ids, t.birth, t.death, t.parent)}
    assert got == {0: (0.0, 4.0, 0), 2: (1.0, 3.0, 0), 4: (2.0, 4.0, 0)}


def test_tree_metric():
    rng = np.random.default_rng(3)
    trees = [branch(rng.random(15)) for _ in range(4)]
    o = mergetrees.Options(eps1=0, eps2=100)
    d = [[mergetrees.tree_distance(a, b, o) for b in trees] for a in trees]
    assert all(d[i][i] == 0 and abs(d[i][j] - d[j][i]) < 1e-9 for i in range(4) for j in range(4))
    assert all(d[i][j] <= d[i][k] + d[k][j] + 1e-9 for i in range(4) for j in range(4) for k in range(4))
    same, energy = mergetrees.barycenter_of([trees[0]] * 3, o)
    assert energy < 1e-12 and mergetrees.tree_distance(same, trees[0], o) < 1e-6
    half = mergetrees.geodesic(trees[0], trees[1], 0.5, o)
    assert abs(mergetrees.tree_distance(trees[0], half, o) - mergetrees.tree_distance(half, trees[1], o)) < 0.3 * d[0][1] + 1e-9
    assert mergetrees.tree_distance(trees[0], mergetrees.geodesic(trees[0], trees[1], 1.0, o), o) < 1e-6


def test_tree_threshold_and_clusters(spark):
    t = branch([0, 3, 2.9, 4, 1])
    kept = mergetrees.preprocessed(t, mergetrees.Options(threshold=10.0))
    assert len(kept.birth) == 2
    fields = [[0, 3, 1, 4, 2]] * 3 + [[0, 9, 1, 2, 8]] * 3
    v, c = path(spark, *[[x + 0.01 * k for x in f] for k, f in enumerate(fields)])
    trees = mergetrees.branch_trees(v, c)
    got, _ = mergetrees.cluster(trees, 2)
    label = {r["ds"]: r["ClusterAssignment"] for r in got.collect()}
    assert len({label[i] for i in range(3)}) == 1 and label[0] != label[5]
    removed, kept = mergetrees.temporal_subsampling(trees, 40)
    assert len(removed) == 2 and 0 not in removed and 5 not in removed
    m = mergetrees.distance_matrix(trees)
    assert m.count() == 36 and m.where("i = j and dist <> 0").count() == 0


def test_barycenter_of_many_starts_at_the_least_sum(spark):
    one, other = [0.0, 5.0, 2.0, 6.0, 1.0, 4.0], [0.0, 90.0, 20.0, 60.0, 10.0, 40.0]
    trees = mergetrees.branch_trees(*path(spark, *[other if ds == 128 else one for ds in range(257)]))
    centre, energy = mergetrees.barycenter(trees, rounds=1)
    first = mergetrees.Tree.of(trees.where("ds = 0").toPandas())
    assert mergetrees.tree_distance(mergetrees.Tree.of(centre.toPandas()), mergetrees.preprocessed(first, mergetrees.Options())) < 1e-6
    assert abs(energy - mergetrees.tree_distance(first, mergetrees.Tree.of(trees.where("ds = 128").toPandas())) ** 2 / 257) < 1e-9


def test_barycenters_in_parallel_and_in_one_task_agree(spark):
    rng = np.random.default_rng(8)
    v, c = path(spark, *[np.round(np.sin(np.arange(20)) + 0.2 * rng.normal(size=20), 3) for _ in range(5)])
    trees = mergetrees.branch_trees(v, c)
    far, energy = mergetrees.barycenter(trees)
    near = mergetrees.barycenters(trees)
    a, b = mergetrees.Tree.of(far.toPandas()), mergetrees.Tree.of(near.toPandas())
    assert abs(energy - near.first()["energy"]) < 1e-9 and mergetrees.tree_distance(a, b) < 1e-6
