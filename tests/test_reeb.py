"""Reeb graphs against the components of every level set, found one by one."""

import numpy as np
import pytest

from isofold.operators import kernels, reeb
from isofold.plans import registry


def torus(h, d):
    at = lambda i, j: (i % h) + h * (j % d)
    return [t for i in range(h) for j in range(d) for t in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i, j + 1), at(i + 1, j + 1)))]


def sheet(h, d, holes=()):
    at = lambda i, j: i + h * j
    return [t for i in range(h - 1) for j in range(d - 1) if (i, j) not in holes for t in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i, j + 1), at(i + 1, j + 1)))]


def tetrahedra(n):
    at = lambda i, j, k: i + n * (j + n * k)
    out = []
    for i, j, k in np.ndindex(n - 1, n - 1, n - 1):
        for order in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
            p, cell = [i, j, k], [at(i, j, k)]
            for axis in order:
                p[axis] += 1
                cell.append(at(*p))
            out.append(tuple(cell))
    return out


def meshes():
    rng = np.random.default_rng(5)
    draw = lambda n, m=1000: rng.integers(0, m, n).astype(float).tolist()
    return [
        (draw(42), torus(6, 7)),
        (draw(64, 8), sheet(8, 8, {(2, 2), (5, 4), (4, 5)})),
        (draw(64, 20), tetrahedra(4)),
        (draw(12, 5), [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 4), (7, 8), (9, 10), (9, 10)]),
        ([3.0], []),
        (draw(24), sheet(4, 3) + [tuple(v + 12 for v in t) for t in sheet(4, 3)]),
        ([float(i // 6) for i in range(42)], torus(6, 7)),
    ]


def plain(values, cells):
    """(arcs (lo, hi, inner vertices), nodes (vertex, down, up)) by union-find over the edges of each level between vertices."""
    n = len(values)
    order = kernels.dense_order(np.array(values), np.arange(n)).tolist()
    by_rank = np.argsort(order).tolist()
    subsets = lambda c, k: {tuple(sorted((order[c[i]] for i in range(len(c)) if m >> i & 1))) for m in range(1 << len(c)) if bin(m).count("1") == k}
    edges = sorted({e for c in cells for e in subsets(c, 2)})
    faces = {f for c in cells for f in subsets(c, 3)}

    def classes(r):
        """Sets of edges that cross just above rank r."""
        cross = [e for e in edges if e[0] <= r < e[1]]
        at, uf = {e: i for i, e in enumerate(cross)}, kernels.UnionFind(len(cross))
        for a, b, c in faces:
            if a <= r < c:
                uf.union(at[a, c], at[(a, b) if r < b else (b, c)])
        out = {}
        for e in cross:
            out.setdefault(uf.find(at[e]), set()).add(e)
        return list(out.values())

    below, arc_of, arcs, nodes = [], [], [], []
    for r in range(n):
        above = classes(r)
        linked = {(a, c) for a, b, c in faces if b == r}
        touch_down = [i for i, k in enumerate(below) if any(e[1] == r or e in linked for e in k)]
        touch_up = [j for j, k in enumerate(above) if any(e[0] == r or e in linked for e in k)]
        now = [None] * len(above)
        for i, k in enumerate(below):
            if i not in touch_down:
                now[next(j for j, z in enumerate(above) if k & z)] = arc_of[i]
        if len(touch_down) == 1 and len(touch_up) == 1:
            arcs[arc_of[touch_down[0]]][2].append(by_rank[r])
            now[touch_up[0]] = arc_of[touch_down[0]]
        else:
            nodes.append((by_rank[r], len(touch_down), len(touch_up)))
            for i in touch_down:
                arcs[arc_of[i]][1] = by_rank[r]
            for j in touch_up:
                now[j] = len(arcs)
                arcs.append([by_rank[r], None, []])
        below, arc_of = above, now
    return sorted((lo, hi, tuple(sorted(inner))) for lo, hi, inner in arcs), sorted(nodes)


@pytest.fixture(scope="module")
def tables(spark):
    v = [(ds, i, x) for ds, (values, _) in enumerate(meshes()) for i, x in enumerate(values)]
    c = [(ds, i, list(cell)) for ds, (_, cells) in enumerate(meshes()) for i, cell in enumerate(cells)]
    return spark.createDataFrame(v, "ds long, vid long, value double").cache(), spark.createDataFrame(c, "ds long, cid long, verts array<long>").cache()


@pytest.mark.parametrize("kernel_rows,ways", [(1 << 16, 8), (8, 4), (1, 16)])
def test_equals_all_level_sets(tables, kernel_rows, ways):
    out = {k: t.toPandas() for k, t in reeb.reeb_graph(*tables, kernel_rows=kernel_rows, ways=ways).items()}
    for ds, (values, cells) in enumerate(meshes()):
        arcs, nodes = plain(values, cells)
        own = {k: t[t["ds"] == ds] for k, t in out.items()}
        assert sorted(own["nodes"][["NodeId", "down", "up"]].itertuples(index=False, name=None)) == nodes
        critical = {v for v, _, _ in nodes}
        inner = {}
        for vid, arc in own["segmentation"][["vid", "SegmentationId"]].itertuples(index=False, name=None):
            if vid not in critical:
                inner.setdefault(arc, []).append(vid)
        got = [(r.downNodeId, r.upNodeId, tuple(sorted(inner.get(r.SegmentationId, ())))) for r in own["arcs"].itertuples()]
        assert sorted(got) == arcs
        assert all(r.RegionSize == len(inner.get(r.SegmentationId, ())) and r.RegionSpan == values[r.upNodeId] - values[r.downNodeId] for r in own["arcs"].itertuples())
        ends = {r.SegmentationId: {r.downNodeId, r.upNodeId} for r in own["arcs"].itertuples()}
        assert all(vid not in critical or vid in ends[arc] for vid, arc in own["segmentation"][["vid", "SegmentationId"]].itertuples(index=False, name=None))


def test_a_torus_has_one_loop(tables):
    """Arcs less nodes and one more are loops: one of a torus, whatever its field; none of a sheet without holes."""
    out = reeb.reeb_graph(*tables)
    nodes, arcs = (t.groupBy("ds").count().toPandas().set_index("ds")["count"].to_dict() for t in (out["nodes"], out["arcs"]))
    assert arcs[0] - nodes[0] == 0 and arcs[6] - nodes[6] == 0 and arcs[5] - nodes[5] == -2 and arcs[2] - nodes[2] == -1


def test_empty(spark, tables):
    v, c = (t.limit(0) for t in tables)
    assert all(t.count() == 0 for t in reeb.reeb_graph(v, c).values())


def test_the_registered_torus(spark, sf):
    v, c = registry.week_torus(spark, sf)
    values = [r["value"] for r in v.orderBy("vid").collect()]
    arcs, nodes = plain(values, [tuple(r["verts"]) for r in c.collect()])
    got = registry.QUERIES["torus_reeb_arcs"](spark, sf).collect()
    assert sorted((r["downNodeId"], r["upNodeId"], r["RegionSize"]) for r in got) == sorted((lo, hi, len(inner)) for lo, hi, inner in arcs)
    assert len(got) - len(nodes) == 0 and all(abs(r["RegionSpan"] - (values[r["upNodeId"]] - values[r["downNodeId"]])) < 1e-5 for r in got)
