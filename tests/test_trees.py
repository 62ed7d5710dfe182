"""Trees of fields of any size against the kernels of one task, on grids where branches meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isofold.operators import incidence, kernels, topology, trees
from isofold.plans import registry

SHAPES = [(7, 6, 1), (1, 9, 1), (4, 4, 4), (1, 1, 1), (9, 5, 1)]


@pytest.fixture(scope="module")
def fields(spark):
    """Random fields with ties on grids of two and three dimensions, each a ds."""
    rng = np.random.default_rng(11)
    v = n = None
    for ds, shape in enumerate(SHAPES):
        g = incidence.Grid(*shape)
        values = rng.integers(0, 12, shape[0] * shape[1] * shape[2]).astype(float).tolist()
        own = spark.createDataFrame([(ds, i, x) for i, x in enumerate(values)], "ds long, vid long, value double")
        near = g.neighbours(own) if max(shape) > 1 else spark.createDataFrame([], "ds long, a long, b long")
        v, n = (own, near) if v is None else (v.unionByName(own), n.unionByName(near))
    return v.cache(), n.cache()


def arrays(fields):
    v, n = (t.toPandas() for t in fields)
    for ds in range(len(SHAPES)):
        own, near = v[v["ds"] == ds].sort_values("vid"), n[(n["ds"] == ds) & (n["a"] < n["b"])]
        order = kernels.dense_order(own["value"].to_numpy(), own["vid"].to_numpy())
        starts, nbrs = kernels.adjacency(len(own), near["a"].to_numpy(np.int64), near["b"].to_numpy(np.int64))
        yield ds, own["value"].to_numpy(), order, starts, nbrs


@pytest.mark.parametrize("kind,kernel_rows", [("join", 1000), ("join", 0), ("split", 6)])
def test_merge_trees_equal_the_kernel(fields, kind, kernel_rows):
    out = {k: t.toPandas() for k, t in trees.merge_tree(*fields, kind, kernel_rows=kernel_rows).items()}
    for ds, values, order, starts, nbrs in arrays(fields):
        rank = order if kind == "join" else len(order) - 1 - order
        arcs, _, owner = kernels.merge_tree(rank, starts, nbrs)
        size = np.bincount(owner, minlength=len(order))
        lo_hi = [(a, *sorted((a, b), key=lambda x: order[x]), size[a]) for a, b in arcs]
        own = out["arcs"][out["arcs"]["ds"] == ds]
        assert sorted(map(tuple, own[["SegmentationId", "downNodeId", "upNodeId", "RegionSize"]].to_numpy().tolist())) == sorted(tuple(int(x) for x in row) for row in lo_hi)
        assert all(values[r.upNodeId] - values[r.downNodeId] == r.RegionSpan for r in own.itertuples())
        part = out["segmentation"][out["segmentation"]["ds"] == ds].sort_values("vid")
        assert part["SegmentationId"].tolist() == owner.tolist()
        nodes = out["nodes"][out["nodes"]["ds"] == ds]
        assert sorted(nodes["NodeId"]) == sorted({x for a in arcs for x in a})


def plain_contour(order, starts, nbrs):
    """(arcs between critical vertices, the arc of every regular vertex), from the tree over all vertices."""
    n = len(order)

    def parents(rank):
        seq, uf, top, parent = np.argsort(rank), kernels.UnionFind(n), list(range(n)), np.full(n, -1)
        for v in seq.tolist():
            for r in {uf.find(int(u)) for u in nbrs[starts[v] : starts[v + 1]] if rank[u] < rank[v]}:
                parent[top[r]] = v
                uf.parent[r] = v
            top[uf.find(v)] = v
        return parent

    at, by = np.argsort(order), order  # vertex of each rank, rank of each vertex
    named = lambda p: np.array([by[p[v]] if p[v] >= 0 else -1 for v in at])
    steps, _, _ = trees.combined(named(parents(order)), named(parents(n - 1 - order)))
    up, down = {}, {}
    for a, b in steps:
        up.setdefault(a, []).append(b)
        down.setdefault(b, []).append(a)
    regular = {v for v in range(n) if len(up.get(v, ())) == 1 and len(down.get(v, ())) == 1}
    arcs, of = [], {}
    for a in range(n):
        if a in regular:
            continue
        for b in up.get(a, ()):
            inside = []
            while b in regular:
                inside.append(b)
                b = up[b][0]
            arcs.append((int(at[a]), int(at[b])))
            of |= {int(at[x]): arcs[-1] for x in inside}
    return arcs, of


@pytest.mark.parametrize("kernel_rows", [1000, 3])
def test_contour_trees_and_their_segmentation(fields, kernel_rows):
    out = {k: t.toPandas() for k, t in trees.merge_tree(*fields, "contour", kernel_rows=kernel_rows).items()}
    for ds, values, order, starts, nbrs in arrays(fields):
        arcs, of = plain_contour(order, starts, nbrs)
        assert sorted(arcs) == sorted((int(a), int(b)) for a, b in kernels.contour_tree(len(order), order, starts, nbrs))
        own = out["arcs"][out["arcs"]["ds"] == ds]
        assert sorted(zip(own["downNodeId"], own["upNodeId"])) == sorted(arcs)
        ends = {r.SegmentationId: (r.downNodeId, r.upNodeId) for r in own.itertuples()}
        part = out["segmentation"][out["segmentation"]["ds"] == ds]
        if arcs:
            assert len(part) == len(order) and own["RegionSize"].sum() == len(order)
        for r in part.itertuples():
            assert ends[r.SegmentationId] == of[r.vid] if r.vid in of else r.vid in ends[r.SegmentationId]


def test_trees_of_nothing(spark):
    v = spark.createDataFrame([], "ds long, vid long, value double")
    n = spark.createDataFrame([], "ds long, a long, b long")
    for kind in ("join", "split", "contour"):
        assert all(t.count() == 0 for t in trees.merge_tree(v, n, kind).values())
    with pytest.raises(ValueError):
        trees.merge_tree(v, n, "other")


def test_no_group_holds_a_field(fields):
    """What goes to one task are edges between basins and critical vertices."""
    v, n = fields
    ranks, edges = trees.numbered(v, n)
    tree = trees.Tree(ranks, edges, 1000)
    assert tree.nodes().count() < v.count() / 2
    assert topology.extrema(v, n).where("CriticalType = 0").count() <= tree.basins.where(F.col("v") == F.col("root")).count()


def test_contour_queries_equal_the_plain_tree(spark, sf):
    v, _, g = registry.day_hour_grid(spark, sf)
    own, near = v.toPandas().sort_values("vid"), g.neighbours(v).toPandas()
    order = kernels.dense_order(own["value"].to_numpy(), own["vid"].to_numpy())
    near = near[near["a"] < near["b"]]
    arcs, of = plain_contour(order, *kernels.adjacency(len(own), near["a"].to_numpy(np.int64), near["b"].to_numpy(np.int64)))
    out = registry.QUERIES["grid_contour_tree"](spark, sf).toPandas()
    assert sorted(zip(out["downNodeId"], out["upNodeId"])) == sorted(arcs) and len(arcs) > 50
    for r in registry.QUERIES["grid_contour_segments"](spark, sf).collect():
        ends = (r["downNodeId"], r["upNodeId"])
        assert ends == of[r["vid"]] if r["vid"] in of else r["vid"] in ends


def test_large_fields_take_the_same_trees(spark):
    rng = np.random.default_rng(2)
    g = incidence.Grid(6, 5)
    v = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(rng.random(30))], "ds long, vid long, value double")
    rows = lambda t: sorted(map(tuple, t.collect()))
    small, large = (topology.merge_tree(v, g.cells(spark), "join", kernel_rows=k) for k in (100, 8))
    assert all(rows(small[k]) == rows(large[k]) for k in ("nodes", "arcs", "segmentation"))
