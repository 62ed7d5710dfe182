"""Two fields at once: Jacobi sets, fibers, fiber surfaces, range polygons, Reeb spaces. vertices have (ds, vid, x, y, z, u, v)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, incidence, kernels

#: Edge types of the Jacobi set.
MULTI = -1


def jacobi_set(vertices: DataFrame, cells: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(ds, a, b, type) of the edges that are critical for both fields: 0 minimum, 1 saddle, 2 maximum, -1 several.

    The link of an edge is split by the signed distance of its vertices to the edge's line in the range; ties fall by perturbation with the ids.
    """
    field = vertices.select("ds", "vid", F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"))
    own = cells.select("ds", "cid", "verts", F.explode(F.array_sort(F.flatten(F.transform("verts", lambda a: F.transform("verts", lambda b: F.struct(a.alias("a"), b.alias("b"))))))).alias("e")).where("e.a < e.b")
    link = own.select("ds", F.col("e.a").alias("a"), F.col("e.b").alias("b"), F.filter("verts", lambda w: (w != F.col("e.a")) & (w != F.col("e.b"))).alias("rest"))
    a = field.select("ds", *(F.col(c).alias(f"{c}a") for c in ("u", "v")), F.col("vid").alias("a"))
    b = field.select("ds", *(F.col(c).alias(f"{c}b") for c in ("u", "v")), F.col("vid").alias("b"))
    w = field.select("ds", *(F.col(c).alias(f"{c}w") for c in ("u", "v")), F.col("vid").alias("w"))
    sides = link.select("ds", "a", "b", F.explode("rest").alias("w")).distinct().join(a, ["ds", "a"]).join(b, ["ds", "b"]).join(w, ["ds", "w"])
    distance = F.expr("(ub - ua) * (vw - va) - (vb - va) * (uw - ua)")
    tie = F.expr("cast(b - a as double) * (pow(w, 2) - pow(a, 2)) - (pow(b, 2) - pow(a, 2)) * cast(w - a as double)")
    sides = sides.select("ds", "a", "b", "w", F.when(distance != 0, distance > 0).otherwise(tie > 0).alias("up"))
    gathered = sides.groupBy("ds", "a", "b").agg(F.map_from_entries(F.collect_list(F.struct("w", "up"))).alias("side"))
    around = link.groupBy("ds", "a", "b").agg(F.collect_list("rest").alias("rest"))

    def classify(batches):
        for pdf in batches:
            kinds = []
            for side, rest in zip(pdf["side"], pdf["rest"]):
                side = {int(k): bool(x) for k, x in dict(side).items()}
                n = []
                for up in (False, True):
                    members = {k for k, x in side.items() if x is up}
                    edges = [(int(r[0]), int(r[1])) for r in rest if len(r) == 2 and int(r[0]) in members and int(r[1]) in members]
                    n.append(kernels.link_components(members, edges))
                kinds.append(0 if not n[0] else 2 if not n[1] else -2 if n == [1, 1] else 1 if max(n) == 2 else MULTI)
            yield pd.DataFrame({"ds": pdf["ds"], "a": pdf["a"], "b": pdf["b"], "type": np.array(kinds, np.int32)})

    return gathered.join(around, ["ds", "a", "b"]).mapInPandas(classify, "ds long, a long, b long, type int").where("type <> -2")


# ---------------------------------------------------------------- marching
def _cut_tets(vertices: DataFrame, cells: DataFrame, level: Column, extra: list[str]) -> DataFrame:
    """(ds, cid, n, poly) for tetrahedra that `level` (of struct c) changes sign in: the cut's corners, each interpolated in x, y, z and extra."""
    carry = ["x", "y", "z", *extra]
    v = vertices.select("ds", "vid", *carry)
    corner = cells.where(F.size("verts") == 4).select("ds", "cid", F.posexplode("verts").alias("p", "vid")).join(v, ["ds", "vid"])
    corner = corner.withColumn("f", level)
    tet = corner.groupBy("ds", "cid").agg(F.array_sort(F.collect_list(F.struct("p", "vid", "f", *carry))).alias("c"))

    def cross(a: Column, b: Column) -> Column:
        t = F.try_divide(a["f"], a["f"] - b["f"])
        return F.struct(*((a[n] + t * (b[n] - a[n])).alias(n) for n in carry))

    low, high = F.filter("c", lambda c: c["f"] < 0), F.filter("c", lambda c: c["f"] >= 0)
    tet = tet.select("ds", "cid", low.alias("low"), high.alias("high")).where("size(low) between 1 and 3")
    one = lambda side, other: F.array(*(cross(F.col(side)[0], F.col(other)[k]) for k in range(3)))
    two = F.array(*(cross(F.col("low")[i], F.col("high")[j]) for i, j in ((0, 0), (0, 1), (1, 1), (1, 0))))
    poly = F.when(F.size("low") == 1, one("low", "high")).when(F.size("low") == 3, one("high", "low")).otherwise(two)
    return tet.select("ds", "cid", poly.alias("poly"))


def isosurface(vertices: DataFrame, cells: DataFrame, value: str, level: float, extra: list[str] | None = None) -> DataFrame:
    """(ds, cid, poly): the triangle or quadrangle in which each tetrahedron meets a level, with the other fields interpolated."""
    return _cut_tets(vertices, cells, F.col(value).cast("double") - F.lit(level), [value, *(extra or [])])


def _triangles(polys: DataFrame, keep: list[str]) -> DataFrame:
    p = F.col("poly")
    both = F.when(F.size(p) == 4, F.array(F.array(p[0], p[1], p[2]), F.array(p[0], p[2], p[3]))).otherwise(F.array(F.array(p[0], p[1], p[2])))
    return polys.select(*keep, F.posexplode(both).alias("part", "t"))


def _segments(triangles: DataFrame, level, keep: list[str], carry: list[str]) -> DataFrame:
    """(keep, p, q): where triangles t meet the zero of level(corner)."""
    corners = [F.col("t")[k] for k in range(3)]
    f = [level(c) for c in corners]
    marked = triangles.withColumns({f"f{k}": x for k, x in enumerate(f)})

    def cross(i: int, j: int) -> Column:
        t = F.try_divide(F.col(f"f{i}"), F.col(f"f{i}") - F.col(f"f{j}"))
        return F.when((F.col(f"f{i}") < 0) != (F.col(f"f{j}") < 0), F.struct(*((corners[i][n] + t * (corners[j][n] - corners[i][n])).alias(n) for n in carry)))

    hits = F.array_compact(F.array(cross(0, 1), cross(1, 2), cross(2, 0)))
    return marked.withColumn("h", hits).where("size(h) = 2").select(*keep, F.col("h")[0].alias("p"), F.col("h")[1].alias("q"))


def fiber(vertices: DataFrame, cells: DataFrame, u0: float, v0: float, u: str = "u", v: str = "v") -> DataFrame:
    """(ds, cid, p, q): segments where u = u0 and v = v0."""
    surface = _triangles(isosurface(vertices, cells, u, u0, [v]), ["ds", "cid"])
    return _segments(surface, lambda c: c[v] - F.lit(v0), ["ds", "cid"], ["x", "y", "z", v])


def fiber_surface(vertices: DataFrame, cells: DataFrame, polygon: DataFrame, u: str = "u", v: str = "v", buckets: int = 32) -> DataFrame:
    """(edge, ds, cid, part, poly): the preimage of a range polygon's edges (edge, u0, v0, u1, v1).

    Tetrahedra and edges meet by the cells of a raster over the range that both boxes touch; the cut by the edge's line is clipped to the edge.
    """
    field = vertices.select("ds", "vid", F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"))
    box = cells.where(F.size("verts") == 4).select("ds", "cid", F.explode("verts").alias("vid")).join(field, ["ds", "vid"]).groupBy("ds", "cid").agg(*(f(c).alias(f"{n}{c}") for c in "uv" for n, f in (("lo", F.min), ("hi", F.max))))
    span = field.agg(*(f(c).alias(f"{n}_{c}") for c in "uv" for n, f in (("min", F.min), ("max", F.max))))

    def bins(df: DataFrame, lo: str, hi: str, c: str) -> Column:
        width = F.greatest((F.col(f"max_{c}") - F.col(f"min_{c}")) / buckets, F.lit(1e-300))
        at = [F.floor(F.least(F.greatest((F.expr(x) - F.col(f"min_{c}")) / width, F.lit(-1.0)), F.lit(float(buckets)))) for x in (lo, hi)]
        return F.sequence(*at)

    tets = box.crossJoin(F.broadcast(span))  # one row
    tets = tets.withColumn("bu", F.explode(bins(tets, "lou", "hiu", "u"))).withColumn("bv", F.explode(bins(tets, "lov", "hiv", "v"))).select("ds", "cid", "bu", "bv", "lou", "hiu", "lov", "hiv")
    segs = polygon.crossJoin(F.broadcast(span))
    segs = segs.withColumn("bu", F.explode(bins(segs, "least(u0, u1)", "greatest(u0, u1)", "u"))).withColumn("bv", F.explode(bins(segs, "least(v0, v1)", "greatest(v0, v1)", "v"))).select("edge", "u0", "v0", "u1", "v1", "bu", "bv")
    met = tets.join(segs, ["bu", "bv"]).where("lou <= greatest(u0, u1) and hiu >= least(u0, u1) and lov <= greatest(v0, v1) and hiv >= least(v0, v1)").select("ds", "cid", "edge", "u0", "v0", "u1", "v1").distinct()
    stride = (polygon.agg(F.max("edge")).first()[0] or 0) + 1
    pair = met.join(cells.select("ds", "cid", "verts"), ["ds", "cid"]).select("ds", (F.col("cid") * stride + F.col("edge")).alias("cid"), "verts", "u0", "v0", "u1", "v1")
    own = vertices.select("ds", "vid", "x", "y", "z", F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"))
    corner = pair.select("ds", "cid", "u0", "v0", "u1", "v1", F.posexplode("verts").alias("p", "vid")).join(own, ["ds", "vid"])
    corner = corner.withColumn("f", F.expr("(u1 - u0) * (v - v0) - (v1 - v0) * (u - u0)")).withColumn("t", F.try_divide(F.expr("(u - u0) * (u1 - u0) + (v - v0) * (v1 - v0)"), F.expr("pow(u1 - u0, 2) + pow(v1 - v0, 2)")))
    carry = ["x", "y", "z", "t"]
    tet = corner.groupBy("ds", "cid").agg(F.array_sort(F.collect_list(F.struct("p", "f", *carry))).alias("c"))

    def clip(batches):
        for pdf in batches:
            out = []
            for ds, cid, c in zip(pdf["ds"], pdf["cid"], pdf["c"]):
                pts = np.array([[k["f"], k["x"], k["y"], k["z"], k["t"]] for k in c], float)
                low, high = pts[pts[:, 0] < 0], pts[pts[:, 0] >= 0]
                if not len(low) or not len(high):
                    continue
                ring = [(0, j) for j in range(3)] if len(low) == 1 else [(i, 0) for i in range(3)] if len(low) == 3 else [(0, 0), (0, 1), (1, 1), (1, 0)]
                poly = [low[i] + low[i, 0] / (low[i, 0] - high[j, 0]) * (high[j] - low[i]) for i, j in ring]
                for sign, bound in ((1, 0.0), (-1, -1.0)):
                    new = []
                    for k, b in enumerate(poly):
                        a = poly[k - 1]
                        da, db = sign * a[4] - bound, sign * b[4] - bound
                        if (da < 0) != (db < 0):
                            new.append(a + da / (da - db) * (b - a))
                        if db >= 0:
                            new.append(b)
                    poly = new
                if len(poly) >= 3:
                    out.append((cid % stride, ds, cid // stride, [list(map(float, q[1:4])) for q in poly]))
            yield pd.DataFrame(out, columns=["edge", "ds", "cid", "poly"])

    return tet.mapInPandas(clip, "edge long, ds long, cid long, poly array<array<double>>")


def range_polygon(points: DataFrame, closed: bool = True) -> DataFrame:
    """(edge, u0, v0, u1, v1): the polyline through points (id, u, v) in order, closed by an edge back to the first."""
    w = Window.orderBy("id")
    out = points.select((F.row_number().over(w) - 1).alias("edge"), F.col("u").alias("u0"), F.col("v").alias("v0"), F.lead("u").over(w).alias("u1"), F.lead("v").over(w).alias("v1"))
    if closed:
        first = points.agg(F.min_by("u", "id").alias("fu"), F.min_by("v", "id").alias("fv"))
        out = out.crossJoin(F.broadcast(first)).select("edge", "u0", "v0", F.coalesce("u1", "fu").alias("u1"), F.coalesce("v1", "fv").alias("v1"))  # one row
    return out.where("u1 is not null")


def surface_polygon(vertices: DataFrame, cells: DataFrame, rounds: int = 0) -> DataFrame:
    """(ds, a, b) edges of a surface's boundary with smoothed coordinates (ax, ay, az, bx, by, bz)."""
    from .fields import smooth_geometry

    rim = incidence.simplices(cells, 1).where("star = 1").select("ds", F.col("face")[0].alias("a"), F.col("face")[1].alias("b"))
    both = rim.union(rim.select("ds", F.col("b").alias("a"), F.col("a").alias("b")))
    on = vertices.join(both.select("ds", F.col("a").alias("vid")).distinct(), ["ds", "vid"], "left_semi")
    v = smooth_geometry(on, both, rounds) if rounds else on
    for side in "ab":
        rim = rim.join(v.select("ds", F.col("vid").alias(side), *(F.col(c).alias(f"{side}{c}") for c in "xyz")), ["ds", side])
    return rim


def reeb_space(vertices: DataFrame, cells: DataFrame, u: str = "u", v: str = "v", bins: int = 16) -> dict[str, DataFrame]:
    """Sheets of a bivariate field: 1-sheets are connected parts of the Jacobi set; 3-sheets are components of cells whose fields' means fall in one
    range bin (a quantised Reeb space), with domain volume, range area and their product.

    Relational at any size; finer bins come nearer the continuous sheets.
    """
    jacobi = jacobi_set(vertices, cells, u, v)
    ends = jacobi.select("ds", F.explode(F.array("a", "b")).alias("node")).distinct()
    lines = graph.components_within(jacobi.select("ds", "a", "b"), ends).withColumnRenamed("node", "a")
    one = jacobi.join(lines, ["ds", "a"]).select("ds", "a", "b", "type", F.col("component").alias("sheet1"))
    field = vertices.select("ds", "vid", "x", "y", "z", F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"))
    span = field.groupBy("ds").agg(*(f(c).alias(f"{n}_{c}") for c in "uv" for n, f in (("min", F.min), ("max", F.max))))
    tet = cells.where(F.size("verts") == 4).select("ds", "cid", F.posexplode("verts").alias("p", "vid")).join(field, ["ds", "vid"])
    mean = tet.groupBy("ds", "cid").agg(F.avg("u").alias("u"), F.avg("v").alias("v"), F.array_sort(F.collect_list(F.struct("p", "x", "y", "z", "u", "v"))).alias("c"))
    d = {(n, k): F.col("c")[k][n] - F.col("c")[0][n] for n in "xyz" for k in (1, 2, 3)}
    volume = F.abs(d["x", 1] * (d["y", 2] * d["z", 3] - d["z", 2] * d["y", 3]) - d["y", 1] * (d["x", 2] * d["z", 3] - d["z", 2] * d["x", 3]) + d["z", 1] * (d["x", 2] * d["y", 3] - d["y", 2] * d["x", 3])) / 6
    binned = mean.join(span, "ds")
    place = {c: F.coalesce(F.least(F.floor(F.try_divide((F.col(c) - F.col(f"min_{c}")) * bins, F.col(f"max_{c}") - F.col(f"min_{c}"))), F.lit(bins - 1)), F.lit(0)) for c in "uv"}
    binned = binned.select("ds", "cid", (place["u"] * bins + place["v"]).alias("bin"), volume.alias("volume"), ((F.col("max_u") - F.col("min_u")) * (F.col("max_v") - F.col("min_v")) / bins**2).alias("area"))
    near = incidence.cell_neighbours(cells)
    same = near.join(binned.select("ds", F.col("cid").alias("a"), F.col("bin").alias("ba")), ["ds", "a"]).join(binned.select("ds", F.col("cid").alias("b"), F.col("bin").alias("bb")), ["ds", "b"]).where("ba = bb")
    label = graph.components_within(same.select("ds", "a", "b"), binned.select("ds", F.col("cid").alias("node"))).withColumnRenamed("node", "cid")
    three = binned.join(label, ["ds", "cid"]).select("ds", "cid", "bin", F.col("component").alias("sheet3"), "volume", "area")
    sheets = three.groupBy("ds", "sheet3").agg(F.first("bin").alias("bin"), F.count("*").alias("cells"), F.sum("volume").alias("domain_volume"), F.first("area").alias("range_area"))
    return {"sheets1": one, "cells": three, "sheets3": sheets.withColumn("hyper_volume", F.col("domain_volume") * F.col("range_area"))}
