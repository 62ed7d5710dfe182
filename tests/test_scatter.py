"""Continuous scatter plots against tetrahedra cut into smaller ones at every pixel's border."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isofold.operators import incidence, stats
from isofold.plans import registry


def cut(tets, column, bound):
    """Tetrahedra (4, [x, y, z, u, v]) split at a value of one column: (those below, those above)."""
    low, high = [], []
    for t in tets:
        t = t[np.argsort(t[:, column], kind="stable")]
        below = t[:, column] < bound
        n = int(below.sum())
        at = lambda i, j: t[i] + (bound - t[i, column]) / (t[j, column] - t[i, column]) * (t[j] - t[i])  # noqa: B023, E731
        if n in (0, 4):
            (low if n else high).append(t)
        elif n in (1, 3):
            lone = 0 if n == 1 else 3
            rest = [i for i in range(4) if i != lone]
            m = [at(lone, i) for i in rest]
            r = [t[i] for i in rest]
            one = [np.array([t[lone], *m])]
            others = [np.array([m[0], m[1], m[2], r[2]]), np.array([m[0], m[1], r[1], r[2]]), np.array([m[0], r[0], r[1], r[2]])]
            low += one if n == 1 else others
            high += others if n == 1 else one
        else:
            a, b, c, d = at(0, 2), at(0, 3), at(1, 2), at(1, 3)
            low += [np.array([t[0], t[1], c, d]), np.array([t[0], a, c, d]), np.array([t[0], a, b, d])]
            high += [np.array([t[2], t[3], b, d]), np.array([t[2], a, b, d]), np.array([t[2], a, c, d])]
    return low, high


def plain(points, cells, size):
    """{(px, py): volume} of one ds; points {vid: (x, y, z, u, v)}."""
    values = np.array([points[i] for i in sorted(points)], float)
    lo, hi = values[:, 3:].min(0), values[:, 3:].max(0)
    out = {}
    for cell in cells:
        t = np.array([points[i] for i in cell], float)
        for k in (0, 1):
            t[:, 3 + k] = (t[:, 3 + k] - lo[k]) / (hi[k] - lo[k]) * size[k] if hi[k] > lo[k] else 0
        rest = [t]
        for px in range(size[0]):
            column, rest = cut(rest, 3, px + 1) if px < size[0] - 1 else (rest, [])
            for py in range(size[1]):
                part, column = cut(column, 4, py + 1) if py < size[1] - 1 else (column, [])
                out[px, py] = out.get((px, py), 0) + sum(abs(np.linalg.det(p[1:, :3] - p[0, :3])) / 6 for p in part)
    return {k: x for k, x in out.items() if x > 1e-12}


def check(vertices, cells, size):
    got = stats.continuous_scatter(vertices, cells, "u", "v", size).toPandas()
    points, corners = vertices.select("ds", "vid", "x", "y", "z", "u", "v").toPandas(), cells.toPandas()
    for ds in sorted(set(points["ds"])):
        own = {int(r.vid): (r.x, r.y, r.z, r.u, r.v) for r in points[points["ds"] == ds].itertuples()}
        want = plain(own, corners[corners["ds"] == ds]["verts"], size)
        mine = {(int(r.px), int(r.py)): r.density for r in got[got["ds"] == ds].itertuples() if r.density > 1e-12}
        assert set(mine) == set(want) and all(abs(mine[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("kind", ["random", "few values", "line", "slanted line", "one value"])
def test_equals_cut_tetrahedra(spark, kind):
    rng = np.random.default_rng(3)
    g = incidence.Grid(3, 3, 3)
    u, v = rng.random((2, 2, 27)) * 5
    if kind == "few values":
        u, v = np.floor(u / 2), np.floor(v / 2)
    elif kind == "line":
        v = v * 0 + 2
    elif kind == "slanted line":
        u = np.floor(u)
        v = 3 - 2 * u
    elif kind == "one value":
        u, v = u * 0 + 1, v * 0
    values = spark.createDataFrame([(ds, i, float(u[ds, i]), float(v[ds, i])) for ds in (0, 1) for i in range(27)], "ds long, vid long, u double, v double")
    place = g.vertices(spark).select("vid", "x", "y", F.expr("z * 1.5").alias("z"))
    cells = g.cells(spark)
    both = cells.unionByName(cells.withColumn("ds", F.lit(1).cast("long")))
    check(values.join(place, "vid"), both, (4, 3))


def test_the_registered_plot(spark, sf):
    v, c = registry.order_volume(spark, sf)
    got = {(r["px"], r["py"]): r["density"] for r in registry.QUERIES["continuous_scatter_plot"](spark, sf).collect()}
    points = {r["vid"]: (r["x"], r["y"], r["z"], r["u"], r["v"]) for r in v.collect()}
    want = plain(points, [r["verts"] for r in c.collect()], (16, 16))
    assert abs(sum(got.values()) - 7 * 7 * 5) < 1e-3 and all(abs(got.get(k, 0) - want[k]) < 2e-6 for k in want)


def test_left_out(spark):
    v = spark.createDataFrame([(0, i, float(i == 1), float(i == 2), float(i == 3), float(i) if i < 4 else None, float(i % 2)) for i in range(5)], "ds long, vid long, x double, y double, z double, u double, v double")
    c = spark.createDataFrame([(0, 0, [0, 1, 2, 3]), (0, 1, [1, 2, 3, 4]), (0, 2, [0, 1, 2])], "ds long, cid long, verts array<long>")
    total = lambda **k: stats.continuous_scatter(v, c, "u", "v", (3, 2), **k).agg(F.sum("density")).first()[0]
    assert abs(total() - 1 / 6) < 1e-12 and total(dummy=3.0) is None
    assert stats.continuous_scatter(v.limit(0), c, "u", "v", (3, 2)).count() == 0
