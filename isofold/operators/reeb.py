"""Reeb graphs of meshes of any size: the components of all level sets, with no bins; slabs only share out the work.

Vertices are named by rank; vertex r stands at level 2 r, so odd levels lie between vertices. A link (x, y, s, t) says that x and y (vertices or edges) are
in one component of every level from s to t, and a link of x to itself that x is there: a triangle a < b < c links ab with ac up to b, and bc with ac from b on.
A round cuts each slab of levels into `ways`. Links that pass a slab from end to end are contracted there, so that a slab keeps only what its own vertices touch,
and what nothing touches is a tube between its ends. Slabs of few vertices are halved further in a task, down to one vertex each, which is regular if one
component enters and one leaves. What the rounds call by different names at one border is put together by one contraction at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import dense_index
from ..functions.storage import dropped, settled
from . import graph, incidence, kernels, trees

_OUT = "kind int, vertex long, level int, border long, side int, name long, slab long, part long"


def links_of(vertices: DataFrame, cells: DataFrame, value: str = "value", offset: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(ranks (ds, vid, value, r), links (x, y, s, t), how many names there are) of a mesh of lines, triangles or tetrahedra. Names of edges follow the vertices'."""
    ranks, edges = trees.numbered(vertices, incidence.neighbours(cells), value, offset)
    n = (ranks.agg(F.max("r")).first()[0] or 0) + 1
    edges = settled(dense_index(edges.select("lo", "hi"), ["lo", "hi"], "e", n).select("lo", "hi", F.col("e").cast("long").alias("e")), "edges")
    names = n + edges.count()
    corner = incidence.simplices(cells.where(F.size("verts") > 2), 2).select("ds", F.monotonically_increasing_id().alias("t"), "face")
    corner = settled(corner, "triangles").select("ds", "t", F.explode("face").alias("vid")).join(ranks.select("ds", "vid", "r"), ["ds", "vid"])
    abc = corner.groupBy("t").agg(F.array_sort(F.collect_list("r")).alias("p")).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), F.col("p")[2].alias("c"))
    named = lambda lo, hi, e: edges.select(F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("e").alias(e))
    sides = abc.join(named("a", "b", "ab"), ["a", "b"]).join(named("a", "c", "ac"), ["a", "c"]).join(named("b", "c", "bc"), ["b", "c"])

    def link(x: str | Column, y: str | Column, s: str, t: str) -> Column:
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(s) * 2).alias("s"), (F.col(t) * 2).alias("t"))

    out = sides.select(F.explode(F.array(link("ab", "ac", "a", "b"), link("bc", "ac", "b", "c"))).alias("l"))
    out = out.unionByName(edges.select(F.explode(F.array(link("e", "e", "lo", "hi"), link("lo", "e", "lo", "lo"), link("hi", "e", "hi", "hi"))).alias("l")))
    out = out.unionByName(ranks.select(link("r", "r", "r", "r").alias("l")))
    return ranks, settled(out.select("l.*"), "links"), names


def _point(level: int, border: Column, side: Column | int, name: str) -> Column:
    return F.struct(F.lit(level).alias("level"), border.cast("long").alias("border"), F.lit(side).cast("int").alias("side"), F.col(name).cast("long").alias("name"))


def _finer(links: DataFrame, w: int, wider: int, level: int, names: int) -> tuple[DataFrame, DataFrame]:
    """(links of slabs of w vertices, pairs (p, q) of points that are one) of links (slab, x, y, s, t) of slabs of `wider`."""
    low, top = F.col("k") * (2 * w) - 1, (F.col("k") + 1) * (2 * w) - 1
    cut = links.withColumn("k", F.explode(F.expr(f"sequence((s + 1) div {2 * w}, t div {2 * w})")))
    cut = settled(cut.select("k", "x", "y", F.greatest("s", low).alias("s"), F.least("t", top).alias("t")), "cut")
    passes = (F.col("s") == low) & (F.col("t") == top)
    key = lambda c: F.col("k") * names + F.col(c)
    label = graph.components(cut.where(passes).where("x <> y").select(key("x").alias("a"), key("y").alias("b")))
    to = lambda c: label.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"_to{c}"))
    new = cut.join(to("x"), key("x") == F.col("_x"), "left").join(to("y"), key("y") == F.col("_y"), "left")
    name = lambda c: F.coalesce(F.expr(f"pmod(_to{c}, {names})"), F.col(c))
    new = settled(new.select("k", (F.col("x") == F.col("y")).alias("own"), F.col("x").alias("was"), name("x").alias("x"), name("y").alias("y"), "s", "t"), "named")
    part = new.where(~passes).where("own or x <> y").select("k", "x", "y", "s", "t").distinct()
    through = new.where(passes & F.col("own")).select("k", "x", low.alias("s"), top.alias("t")).distinct()
    touched = part.select("k", F.explode(F.array("x", "y")).alias("x")).distinct()
    kept = through.join(touched, ["k", "x"], "left_semi").select("k", "x", F.col("x").alias("y"), "s", "t")
    tubes = through.join(touched, ["k", "x"], "left_anti").select(_point(level + 1, low, -1, "x").alias("p"), _point(level + 1, top, 1, "x").alias("q"))
    finer = settled(part.unionByName(kept).withColumnRenamed("k", "slab"), "links")
    of = wider // w
    inner_low, inner_top = F.col("k") % of != 0, F.col("k") % of != of - 1
    at_low = new.where("own").where(F.col("s") == low).select(_point(level, low, F.when(inner_low, 0).otherwise(-1), "was").alias("p"), _point(level + 1, low, -1, "x").alias("q"))
    at_top = new.where("own").where(F.col("t") == top).select(_point(level, top, F.when(inner_top, 0).otherwise(1), "was").alias("p"), _point(level + 1, top, 1, "x").alias("q"))
    same = settled(at_low.unionByName(at_top).unionByName(tubes).distinct(), "same")
    dropped(cut, new)
    return finer, same


def _halved(w: int, level: int):
    """The kernel of a slab of w vertices (a power of two): what its vertices and the points of its two borders are part of."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        slab = int(pdf["slab"].iloc[0])
        base = slab * w
        names, flat = np.unique(pdf[["x", "y"]].to_numpy(np.int64).ravel(), return_inverse=True)
        x, y = flat.reshape(-1, 2).T
        s, t = pdf["s"].to_numpy(np.int64) - 2 * base, pdf["t"].to_numpy(np.int64) - 2 * base
        stride, k, wide, depth, pairs = len(names), np.zeros(len(x), np.int64), w, 0, []

        def point(depth, border, side, name):
            return ((depth * (2 * w + 1) + border + 1) * 3 + side + 1) * stride + name

        while wide > 1:
            half = wide // 2
            first = (s + 1) // (2 * half)
            times = t // (2 * half) - first + 1
            at = np.repeat(np.arange(len(x)), times)
            k = np.repeat(first, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            low, top = 2 * half * k - 1, 2 * half * (k + 1) - 1
            was, other, s, t = x[at], y[at], np.maximum(s[at], low), np.minimum(t[at], top)
            own, passes = was == other, (s == low) & (t == top)
            keys, both = np.unique(np.concatenate((k * stride + was, k * stride + other)), return_inverse=True)
            a, b = both[: len(at)], both[len(at) :]
            to = keys[kernels.least_labels(len(keys), a[passes], b[passes])] % stride
            x, y = to[a], to[b]
            for end, border, side, inner in ((s == low, low, -1, k % 2 == 1), (t == top, top, 1, k % 2 == 0)):
                e = own & end
                pairs.append((point(depth, border[e], np.where(inner[e], 0, side), was[e]), point(depth + 1, border[e], side, x[e])))
            part = ~passes & (own | (x != y))
            through = np.unique((k * stride + x)[passes & own])
            touched = np.isin(through, np.concatenate(((k * stride + x)[part], (k * stride + y)[part])))
            tk, tx = np.divmod(through[~touched], stride)
            pairs.append((point(depth + 1, 2 * half * tk - 1, -1, tx), point(depth + 1, 2 * half * (tk + 1) - 1, 1, tx)))
            kk, kx = np.divmod(through[touched], stride)
            rows = np.concatenate((np.stack((x[part], y[part], s[part], t[part]), 1), np.stack((kx, kx, 2 * half * kk - 1, 2 * half * (kk + 1) - 1), 1)))
            x, y, s, t = np.unique(rows, axis=0).T
            wide, depth = half, depth + 1
        # a vertex for each slab: the components that enter from below and leave upwards
        k = (s + 1) // 2
        ends = []
        for end, border, side in ((s == 2 * k - 1, 2 * k - 1, -1), (t == 2 * k + 1, 2 * k + 1, 1)):
            code = lambda c: point(depth, border[end], side, c[end])  # noqa: B023, E731
            keys, both = np.unique(np.concatenate((code(x), code(y))), return_inverse=True)
            label = kernels.least_labels(len(keys), both[: len(both) // 2], both[len(both) // 2 :])
            pairs.append((keys, keys[label]))
            roots = np.unique(label)
            vertex = np.zeros(len(keys), np.int64)
            vertex[both[: len(both) // 2]] = k[end]
            ends.append((vertex[roots], keys[roots]))
        (vd, pd_), (vu, pu) = ends
        down, up = np.bincount(vd, minlength=w), np.bincount(vu, minlength=w)
        regular = (down == 1) & (up == 1)
        below, above = np.full(w, -1), np.full(w, -1)
        below[vd], above[vu] = pd_, pu
        pairs.append((below[regular], above[regular]))
        # borders of the whole slab
        code0 = np.unique(np.concatenate([p[(p // stride // 3) < 2 * w + 1] for p in (np.concatenate(q) for q in pairs)]))
        sides = code0 // stride % 3 - 1
        code0, sides = code0[sides != 0], sides[sides != 0]
        p, q = (np.concatenate([z[i] for z in pairs]) for i in (0, 1))
        points, flat = np.unique(np.concatenate((p, q, code0)), return_inverse=True)
        label = kernels.least_labels(len(points), flat[: len(p)], flat[len(p) : 2 * len(p)])
        where = lambda c: label[np.searchsorted(points, c)]
        mine = np.unique(pdf.loc[(pdf["x"] == pdf["y"]), ["x", "s"]].query("x == s / 2 and s % 2 == 0")["x"].to_numpy(np.int64)) - base
        lone = mine[(down[mine] == 0) & (up[mine] == 0)]
        cu, cd = ~regular[vu], ~regular[vd]
        r = np.flatnonzero(regular)
        blocks = [
            (0, None, code0, where(code0)),
            (1, vu[cu], None, where(pu[cu])),
            (2, vd[cd], None, where(pd_[cd])),
            (3, r, None, where(below[r])),
            (4, lone, None, np.full(len(lone), -1)),
        ]
        out = []
        for kind, v, c, part_ in blocks:
            n = len(part_)
            d = {"kind": np.full(n, kind, np.int32), "vertex": v + base if v is not None else np.full(n, -1), "level": np.full(n, level, np.int32), "slab": np.full(n, slab), "part": part_}
            d["border"] = c // stride // 3 % (2 * w + 1) - 1 + 2 * base if c is not None else np.full(n, -1)
            d["side"] = (c // stride % 3 - 1 if c is not None else np.zeros(n)).astype(np.int32)
            d["name"] = names[c % stride] if c is not None else np.full(n, -1)
            out.append(pd.DataFrame(d))
        return pd.concat(out)[["kind", "vertex", "level", "border", "side", "name", "slab", "part"]]

    return of


def reeb_graph(vertices: DataFrame, cells: DataFrame, value: str = "value", offset: str | None = None, kernel_rows: int = 65_536, ways: int = 8) -> dict[str, DataFrame]:
    """The Reeb graph of each ds, a mesh (ds, cid, verts) of lines, triangles or tetrahedra over vertices (ds, vid, value).

    nodes (ds, NodeId, VertexId, CriticalType, Scalar, down, up): the vertices that aren't regular, with how many arcs end and begin there. arcs (ds, SegmentationId,
    downNodeId, upNodeId, RegionSize, RegionSpan), loops included, so that two may have the same ends. segmentation (ds, vid, SegmentationId): the arc of each regular
    vertex, and of each other the first that begins there, else the first that ends there; a lone vertex has none. Ties go by offset, by default the id; null and NaN count as 0.
    A task holds a slab of up to kernel_rows vertices (a power of two, rounded down) and the edges that reach it, never a field; the result doesn't depend on it.
    """
    if ways < 2 or ways & (ways - 1) or kernel_rows < 1:
        raise ValueError("ways is a power of two, kernel_rows 1 or more")
    ranks, links, names = links_of(vertices, cells, value, offset)
    n = ranks.count()
    w = 1 << (kernel_rows.bit_length() - 1)
    widths = [w]
    while widths[-1] < n:
        widths.append(widths[-1] * ways)
    links, same = links.withColumn("slab", F.lit(0).cast("long")), []
    for level, (wider, narrow) in enumerate(zip(widths[:0:-1], widths[-2::-1])):
        links, pairs = _finer(links, narrow, wider, level, names)
        same.append(pairs)
    found = settled(links.select("slab", "x", "y", "s", "t").groupBy("slab").applyInPandas(_halved(w, len(same)), _OUT), "slabs")
    own = F.struct(F.lit(-1).alias("level"), F.col("slab").alias("border"), F.lit(0).alias("side"), F.col("part").alias("name"))
    pairs = found.where("kind = 0").select(F.struct("level", "border", "side", "name").alias("p"), own.alias("q"))
    for t in same:
        pairs = pairs.unionByName(t)
    points = pairs.select(F.col("p").alias("u")).unionByName(pairs.select(F.col("q").alias("u"))).unionByName(found.where("kind between 1 and 3").select(own.alias("u"))).distinct()
    points = settled(dense_index(points, ["u"], "i").select("u", F.col("i").cast("long").alias("i")), "points")
    at = lambda c, i: points.select(F.col("u").alias(c), F.col("i").alias(i))
    label = graph.components(pairs.join(at("p", "a"), "p").join(at("q", "b"), "q").select("a", "b"), points.select("i"))
    ends = found.where("kind between 1 and 3").select("kind", "vertex", own.alias("u")).join(points, "u").join(label.withColumnRenamed("node", "i"), "i")
    ends = settled(ends.select("kind", "vertex", "component"), "ends")
    grouped = ends.groupBy("component").agg(
        *(F.min(F.when(F.col("kind") == k, F.col("vertex"))).alias(c) for k, c in ((1, "lo"), (2, "hi"), (3, "first"))),
        F.count(F.when(F.col("kind") == 3, 1)).alias("RegionSize"),
    )
    arcs = settled(dense_index(grouped, ["lo", "hi", "first"], "SegmentationId"), "arcs").withColumn("SegmentationId", F.col("SegmentationId").cast("long"))
    of = lambda r, *c: ranks.select(F.col("r").alias(r), *c)
    lower = of("lo", "ds", F.col("vid").alias("downNodeId"), F.col("value").alias("v_lo"))
    upper = of("hi", F.col("vid").alias("upNodeId"), F.col("value").alias("v_hi"))
    table = arcs.join(lower, "lo").join(upper, "hi").select("ds", "SegmentationId", "downNodeId", "upNodeId", "RegionSize", (F.col("v_hi") - F.col("v_lo")).alias("RegionSpan"))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    critical = ends.where("kind < 3").groupBy("vertex").agg(count(2).alias("down"), count(1).alias("up"))
    critical = critical.unionByName(found.where("kind = 4").select("vertex", F.lit(0).cast("long").alias("down"), F.lit(0).cast("long").alias("up")))
    kind = (
        F.when(F.col("down") == 0, kernels.MINIMUM).when(F.col("up") == 0, kernels.MAXIMUM)
        .when((F.col("down") > 1) & (F.col("up") > 1), kernels.DEGENERATE).when(F.col("down") > 1, kernels.SADDLE1).otherwise(kernels.SADDLE2)
    )
    nodes = critical.join(of("vertex", "ds", "vid", "value"), "vertex").select("ds", F.col("vid").alias("NodeId"), F.col("vid").alias("VertexId"), kind.alias("CriticalType"), F.col("value").alias("Scalar"), "down", "up")
    first = Window.partitionBy("vertex").orderBy("kind", "SegmentationId")
    belongs = ends.join(arcs.select("component", "SegmentationId"), "component").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return {"nodes": nodes, "arcs": table, "segmentation": belongs.join(of("vertex", "ds", "vid"), "vertex").select("ds", "vid", "SegmentationId")}
