"""Lines, connectors and walls of a discrete gradient against plain walks."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from isofold.operators import incidence, separatrices, topology
from isofold.plans import registry


def field(spark, shape, seed):
    g = incidence.Grid(*shape)
    values = np.random.default_rng(seed).integers(0, 20, shape[0] * shape[1] * shape[2]).astype(float).tolist()
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(values)], "ds long, vid long, value double"), g.cells(spark)


def gathered(gradient, cells):
    up, critical = {}, set()
    for r in gradient.collect():
        cell = tuple(r["cell"])
        if r["paired"] is None:
            critical.add(cell)
        else:
            up[cell] = tuple(sorted(r["paired"]))
    tops = {tuple(sorted(r["verts"])): r["cid"] for r in cells.collect()}
    return up, critical, tops


def plain_lines(up, critical, tops):
    d = len(next(iter(tops))) - 1
    cofaces, down = {}, {b: a for a, b in up.items()}
    for t in tops:
        for f in combinations(t, d):
            cofaces.setdefault(f, []).append(t)
    out = set()
    for s in critical:
        if len(s) != d:
            continue
        for side, t in enumerate(sorted(cofaces[s], key=tops.get)):
            step = 0
            while t is not None:
                out.add((s, side, step, tops[t]))
                face = down.get(t)
                rest = [x for x in cofaces[face] if x != t] if face is not None else []
                t, step = (rest[0] if rest else None), step + 1
    return out


def plain_reach(up, critical):
    """How many V-paths lead from each critical triangle to each edge."""
    out = Counter()

    def go(s, e):
        out[s, e] += 1
        if len(up.get(e, ())) == 3:
            for f in combinations(up[e], 2):
                if f != e:
                    go(s, f)

    for s in critical:
        if len(s) == 3:
            for e in combinations(s, 2):
                go(s, e)
    return out


def plain_ascent(up, critical, tops):
    triangles = {f for t in tops for f in combinations(t, 3)}
    down = {b: a for a, b in up.items()}
    over = {}
    for t in triangles:
        for e in combinations(t, 2):
            if len(down.get(t, ())) == 2 and down[t] != e:
                over.setdefault(e, []).append(down[t])
    out = set()
    for s in critical:
        if len(s) == 2:
            todo = [s]
            while todo:
                e = todo.pop()
                if (s, e) not in out:
                    out.add((s, e))
                    todo += over.get(e, [])
    return out


@pytest.mark.parametrize("shape", [(7, 6, 1), (4, 4, 3)])
def test_lines_and_walls_equal_plain_walks(spark, shape):
    v, cells = field(spark, shape, 5)
    gradient = topology.discrete_gradient(v, cells).cache()
    up, critical, tops = gathered(gradient, cells)
    assert sum((-1) ** (len(c) - 1) for c in critical) == 1  # Euler's number of a ball
    lines = separatrices.ascending_lines(gradient, cells).collect()
    assert {(tuple(r["saddle"]), r["side"], r["step"], r["cid"]) for r in lines} == plain_lines(up, critical, tops) and len(lines) == len(plain_lines(up, critical, tops))
    walls = {(tuple(r["saddle"]), tuple(r["edge"])) for r in separatrices.ascending_walls(gradient, cells).collect()}
    assert walls == plain_ascent(up, critical, tops)
    reach = plain_reach(up, critical)
    found = {(tuple(r["saddle"]), tuple(r["edge"])): r["paths"] for r in separatrices.saddle_connectors(gradient).collect()}
    assert found == {k: n for k, n in reach.items() if k[1] in critical}
    own = {(tuple(r["saddle"]), tuple(r["triangle"])) for r in separatrices.descending_walls(gradient).collect()}
    assert own == {(s, up[e]) for s, e in reach if len(up.get(e, ())) == 3} | {(c, c) for c in critical if len(c) == 3}


def test_without_saddles(spark):
    g = incidence.Grid(3, 3)
    v = spark.createDataFrame([(0, i, float(i)) for i in range(9)], "ds long, vid long, value double")
    gradient, cells = topology.discrete_gradient(v, g.cells(spark)), g.cells(spark)
    assert separatrices.ascending_lines(gradient, cells).count() == 0 and separatrices.saddle_connectors(gradient).count() == 0
    assert separatrices.ascending_walls(gradient, cells).count() == 0 and separatrices.descending_walls(gradient).count() == 0


def test_queries_equal_plain_walks(spark, sf):
    v, cells, _ = registry.day_hour_grid(spark, sf)
    up, critical, tops = gathered(topology.discrete_gradient(v, cells), cells)
    lines = registry.QUERIES["grid_ascending_lines"](spark, sf).collect()
    assert {(tuple(r["saddle"]), r["side"], r["step"], r["cid"]) for r in lines} == plain_lines(up, critical, tops)
    v, cells = registry.order_volume(spark, sf)
    up, critical, tops = gathered(topology.discrete_gradient(v, cells, value="u"), cells)
    reach = plain_reach(up, critical)
    found = {(tuple(r["saddle"]), tuple(r["edge"])): r["paths"] for r in registry.QUERIES["volume_saddle_connectors"](spark, sf).collect()}
    assert found == {k: n for k, n in reach.items() if k[1] in critical} and len(found) > 20
    walls = {(tuple(r["saddle"]), tuple(r["triangle"])) for r in registry.QUERIES["volume_descending_walls"](spark, sf).collect()}
    assert walls == {(s, up[e]) for s, e in reach if len(up.get(e, ())) == 3} | {(c, c) for c in critical if len(c) == 3}


def dense_pairs(order, tops):
    """(birth vertex, death vertex) of dimension 1 by reducing the whole boundary matrix over Z2, simplices in the order of their last vertex."""
    cells = {f for t in tops for k in range(1, 5) for f in combinations(t, k)}
    key = lambda s: (max(order[v] for v in s), len(s), sorted((order[v] for v in s), reverse=True))
    cells = sorted(cells, key=key)
    at = {s: i for i, s in enumerate(cells)}
    owner, out = {}, Counter()
    for i, s in enumerate(cells):
        own = {at[f] for f in combinations(s, len(s) - 1)} if len(s) > 1 else set()
        while own and max(own) in owner:
            own ^= owner[max(own)]
        if own:
            owner[max(own)] = own
            b, d = (max(cells[k], key=lambda v: order[v]) for k in (max(own), i))
            if len(s) == 3 and b != d:
                out[b, d] += 1
    return out


@pytest.mark.parametrize("kernel_rows", [100_000, 0])
def test_saddle_saddle_pairs_equal_a_dense_reduction(spark, kernel_rows):
    v, c = None, None
    for ds, shape in enumerate([(5, 5, 4), (4, 5, 5)]):
        own, cells = field(spark, shape, 9 + ds)
        own, cells = own.withColumn("ds", own["ds"] + ds), cells.withColumn("ds", cells["ds"] + ds)
        v, c = (own, cells) if v is None else (v.unionByName(own), c.unionByName(cells))
    out = separatrices.saddle_saddle_pairs(v, c, kernel_rows=kernel_rows).collect()
    for ds in (0, 1):
        values = sorted((r["value"], r["vid"]) for r in v.where(f"ds = {ds}").collect())
        order = {vid: i for i, (_, vid) in enumerate(values)}
        want = dense_pairs(order, [tuple(sorted(r["verts"])) for r in c.where(f"ds = {ds}").collect()])
        assert Counter((r["birth_vid"], r["death_vid"]) for r in out if r["ds"] == ds) == want and len(want) > 1


def test_saddle_pairs_of_the_volume(spark, sf):
    v, cells = registry.order_volume(spark, sf)
    values = sorted((r["u"], r["vid"]) for r in v.collect())
    want = dense_pairs({vid: i for i, (_, vid) in enumerate(values)}, [tuple(sorted(r["verts"])) for r in cells.collect()])
    out = registry.QUERIES["volume_saddle_pairs"](spark, sf).collect()
    assert Counter((r["birth_vid"], r["death_vid"]) for r in out) == want and len(out) > 20
