"""Subdivision, quadrangulation, graph strips, planar layouts, depth images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import dense_index
from . import incidence


def barycentric_subdivision(vertices: DataFrame, cells: DataFrame, levels: int = 1) -> tuple[DataFrame, DataFrame]:
    """Each triangle becomes six. New points are the vertices, then edge midpoints, then triangle centres, tagged with their parent's dimension."""
    for _ in range(levels):
        if not cells.where(F.size("verts") != 3).isEmpty():
            raise ValueError("only triangles can be subdivided")
        base = (vertices.agg(F.max("vid")).first()[0] or 0) + 1
        e = dense_index(incidence.simplices(cells, 1), ["ds", "face"], "eid")
        n = e.count()
        v = vertices.select("ds", "vid", "x", "y", "z")
        mid = e.select("ds", "face", (F.col("eid") + base).alias("pid"))
        points = v.select("ds", "vid", "x", "y", "z", F.lit(0).alias("parent_dim"))
        tri = dense_index(cells.select("ds", "cid", "verts"), ["ds", "cid"], "tid").withColumn("pid", F.col("tid") + base + n)
        for part, dim, face in ((mid, 1, "face"), (tri, 2, "verts")):
            c = part.select("ds", "pid", F.explode(face).alias("vid")).join(v, ["ds", "vid"]).groupBy("ds", "pid").agg(*(F.avg(x).alias(x) for x in "xyz"))
            points = points.unionByName(c.select("ds", F.col("pid").alias("vid"), "x", "y", "z", F.lit(dim).alias("parent_dim")))
        sides = tri.select("ds", "tid", F.col("pid").alias("centre"), F.explode(F.array(*(F.array(F.col("verts")[i], F.col("verts")[j]) for i, j in ((0, 1), (1, 2), (2, 0))))).alias("s"))
        sides = sides.withColumn("face", F.array_sort("s")).join(mid.withColumnRenamed("pid", "m"), ["ds", "face"])
        six = sides.select("ds", "tid", F.explode(F.array(F.array(F.col("s")[0], "m", "centre"), F.array("m", F.col("s")[1], "centre"))).alias("verts"))
        cells = dense_index(six, ["ds", "tid", "verts"], "cid").select("ds", "cid", "verts")
        vertices = points
    return vertices, cells


def subdivide(vertices: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each triangle becomes a quadrangle about each of its vertices, each tetrahedron a hexahedron: by edge, face and cell centres, which cells share.

    (points (ds, key, x, y, z), cells (ds, cid, vid, keys)): a point's key is the sorted vertices it is the centre of.
    """
    v = vertices.select("ds", "vid", "x", "y", "z")
    keys = None
    for d in range(4):
        part = (incidence.simplices(cells, d) if d else v.select("ds", F.array("vid").alias("face"))).select("ds", F.col("face").alias("key"))
        keys = part if keys is None else keys.unionByName(part)
    points = keys.select("ds", "key", F.explode("key").alias("vid")).join(v, ["ds", "vid"]).groupBy("ds", "key").agg(*(F.avg(c).alias(c) for c in "xyz"))
    own = cells.select("ds", "cid", F.explode("verts").alias("vid"), "verts")
    others = F.array_except("verts", F.array("vid"))

    def key(*parts: Column) -> Column:
        return F.array_sort(F.array("vid", *parts))

    o = [others[k] for k in range(3)]
    quad = F.array(key(), key(o[0]), key(o[0], o[1]), key(o[1]))
    hexa = F.array(key(), key(o[0]), key(o[0], o[1]), key(o[1]), key(o[2]), key(o[0], o[2]), key(o[0], o[1], o[2]), key(o[1], o[2]))
    line = F.array(key(), key(o[0]))
    new = own.select("ds", "cid", "vid", F.when(F.size("verts") == 2, line).when(F.size("verts") == 3, quad).otherwise(hexa).alias("keys"))
    return points, new


def quad_subdivision(points: DataFrame, quads: DataFrame, levels: int = 1, relax: int = 0) -> tuple[DataFrame, DataFrame]:
    """Each quadrangle becomes four about its centre and edge midpoints; relax moves every point to its neighbours' mean so many times."""
    for _ in range(levels):
        base = (points.agg(F.max("vid")).first()[0] or 0) + 1
        sides = quads.select("ds", "cid", "verts", F.posexplode(F.array(*(F.array(F.col("verts")[k], F.col("verts")[(k + 1) % 4]) for k in range(4)))).alias("k", "s"))
        e = dense_index(sides.select("ds", F.array_sort("s").alias("face")).distinct(), ["ds", "face"], "n").withColumn("mid", F.col("n") + base)
        n = e.count()
        c = dense_index(quads, ["ds", "cid"], "n").withColumn("centre", F.col("n") + base + n)
        xyz = points.select("ds", "vid", "x", "y", "z")
        fresh = e.select("ds", F.col("mid").alias("p"), F.explode("face").alias("vid")).unionByName(c.select("ds", F.col("centre").alias("p"), F.explode("verts").alias("vid")))
        fresh = fresh.join(xyz, ["ds", "vid"]).groupBy("ds", "p").agg(*(F.avg(x).alias(x) for x in "xyz")).withColumnRenamed("p", "vid")
        mids = sides.withColumn("face", F.array_sort("s")).join(e.select("ds", "face", "mid"), ["ds", "face"]).groupBy("ds", "cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mid"))), lambda m: m["mid"]).alias("m"))
        four = c.join(mids, ["ds", "cid"]).select("ds", "cid", F.posexplode(F.array(*(F.array(F.col("verts")[k], F.col("m")[k], "centre", F.col("m")[(k + 3) % 4]) for k in range(4)))).alias("k", "verts"))
        quads = dense_index(four, ["ds", "cid", "k"], "id").select("ds", F.col("id").alias("cid"), "verts")
        points = xyz.unionByName(fresh.select("ds", "vid", "x", "y", "z"))
    if relax:
        from .fields import smooth_geometry

        sides = quads.select("ds", F.explode(F.array(*(F.array(F.col("verts")[k], F.col("verts")[(k + 1) % 4]) for k in range(4)))).alias("s"))
        near = sides.select("ds", F.col("s")[0].alias("a"), F.col("s")[1].alias("b")).union(sides.select("ds", F.col("s")[1].alias("a"), F.col("s")[0].alias("b"))).distinct()
        points = smooth_geometry(points, near, relax)
    return points, quads


def quadrangulation(separatrices: DataFrame, segmentation: DataFrame, gradient: DataFrame) -> DataFrame:
    """(ds, minimum1, saddle1, minimum2, saddle2, maximum): quadrangles of a 2-D Morse-Smale complex as their corners.

    A saddle edge joins the minima that its two paths end in; saddles between the same two minima, in order, bound the quadrangles between them.
    """
    ends = separatrices.groupBy("ds", "saddle", "side").agg(F.max_by("vid", "step").alias("minimum"))
    both = ends.groupBy("ds", "saddle").agg(F.array_sort(F.collect_list("minimum")).alias("m")).where("size(m) = 2 and m[0] <> m[1]")
    w = Window.partitionBy("ds", "m").orderBy("saddle")
    return both.select("ds", F.col("m")[0].alias("minimum1"), F.col("m")[1].alias("minimum2"), F.col("saddle").alias("saddle1"), F.lead("saddle").over(w).alias("saddle2")).where("saddle2 is not null")


def mesh_graph(nodes: DataFrame, edges: DataFrame, mode: str = "linear", subdivisions: int = 0, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Graph edges as strips of a surface: (points (pid, x, y, z), polygons (cid, pids)).

    linear: one polygon an edge, its two sides interpolated at `subdivisions` places; quadratic: two quadrangles an edge, narrowed to a third at its middle.
    Nodes (vid, x, y, z) are as wide as the size column says.
    """
    width = F.col(size).cast("double") if size else F.lit(1.0)
    n = nodes.select("vid", "x", "y", "z", (width / 2).alias("h"))
    e = dense_index(edges.select("a", "b"), ["a", "b"], "eid")
    e = e.join(n.select(F.col("vid").alias("a"), *(F.col(c).alias(f"{c}0") for c in "xyzh")), "a").join(n.select(F.col("vid").alias("b"), *(F.col(c).alias(f"{c}1") for c in "xyzh")), "b")
    steps = [0.0, 0.5, 1.0] if mode == "quadratic" else [k / (subdivisions + 1) for k in range(subdivisions + 2)]
    per = 2 * len(steps)
    narrow = {0.5: 1 / 3} if mode == "quadratic" else {}
    pts = []
    for k, t in enumerate(steps):
        half = f"((h0 + ({t}) * (h1 - h0)) * {narrow.get(t, 1.0)})"
        for s, sign in enumerate((1, -1)):
            pts.append(F.struct((F.col("eid") * per + 2 * k + s).alias("pid"), F.expr(f"x0 + {t} * (x1 - x0)").alias("x"), F.expr(f"y0 + {t} * (y1 - y0) + {sign} * {half}").alias("y"), F.expr(f"z0 + {t} * (z1 - z0)").alias("z")))
    points = e.select(F.explode(F.array(*pts)).alias("p")).select("p.*")
    if mode == "quadratic":
        polys = F.array(*(F.array(*(F.col("eid") * per + o for o in (2 * k, 2 * k + 2, 2 * k + 3, 2 * k + 1))) for k in range(2)))
    else:
        top, bottom = [2 * k for k in range(len(steps))], [2 * k + 1 for k in reversed(range(len(steps)))]
        polys = F.array(F.array(*(F.col("eid") * per + o for o in top + bottom)))
    return points, e.select("eid", F.posexplode(polys).alias("k", "pids")).select((F.col("eid") * (2 if mode == "quadratic" else 1) + F.col("k")).alias("cid"), "pids")


def planar_layout(nodes: DataFrame, edges: DataFrame, sequence: str = "sequence", size: str | None = None, sweeps: int = 4) -> DataFrame:
    """(vid, px, py): x is the rank of a node's sequence value, y its place in its column, which sweeps order by the mean place of its neighbours.

    Wide nodes take as much room as their size.
    """
    w = F.col(size).cast("double") if size else F.lit(1.0)
    ranks = dense_index(nodes.select(sequence).distinct(), [sequence], "px")
    now = nodes.join(ranks, sequence).select("vid", "px", w.alias("w"), F.col("vid").cast("double").alias("key"))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in range(sweeps):
        place = now.withColumn("py", F.row_number().over(Window.partitionBy("px").orderBy("key", "vid")).cast("double"))
        mean = both.join(place.select(F.col("vid").alias("b"), "py"), "b").groupBy(F.col("a").alias("vid")).agg(F.avg("py").alias("m"))
        now = place.join(mean, "vid", "left").select("vid", "px", "w", F.coalesce("m", "py").alias("key"))
    order = Window.partitionBy("px").orderBy("key", "vid").rowsBetween(Window.unboundedPreceding, 0)
    return now.select("vid", "px", (F.sum("w").over(order) - F.col("w") / 2).alias("py"))


#: Depths beyond this are background.
BACKGROUND = 0.98


def depth_geometry(pixels: DataFrame, width: int, height: int, position: tuple[float, float, float], direction: tuple[float, float, float], up: tuple[float, float, float], near_far: tuple[float, float], size: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """(points (pid, x, y, z), triangles (cid, pids, distortion)) of a depth image (px, py, depth) of an orthographic camera.

    Background pixels have no distance; a triangle's distortion is its largest difference of depths, null with a corner in the background.
    """
    import numpy as np

    d = np.array(direction, float) / np.linalg.norm(direction)
    right = np.cross(d, np.array(up, float))
    right /= np.linalg.norm(right)
    top = np.cross(right, d)
    u = (F.col("px") / max(width - 1, 1) - 0.5) * size[0]
    v = (F.col("py") / max(height - 1, 1) - 0.5) * size[1]
    far = F.when(F.col("depth") > BACKGROUND, 0.0).otherwise(near_far[0] + F.col("depth") * (near_far[1] - near_far[0]))
    points = pixels.select((F.col("py") * width + F.col("px")).alias("pid"), *((F.lit(float(position[k])) + u * float(right[k]) + v * float(top[k]) + far * float(d[k])).alias(c) for k, c in enumerate("xyz")))
    depth = pixels.select((F.col("py") * width + F.col("px")).alias("pid"), F.when(F.col("depth") <= BACKGROUND, F.col("depth")).alias("depth"))
    base = pixels.where((F.col("px") < width - 1) & (F.col("py") < height - 1)).select((F.col("py") * width + F.col("px")).alias("p"))
    tri = base.select("p", F.posexplode(F.array(F.array(F.col("p"), F.col("p") + 1, F.col("p") + width), F.array(F.col("p") + 1, F.col("p") + width + 1, F.col("p") + width))).alias("k", "pids"))
    tri = tri.select((F.col("p") * 2 + F.col("k")).alias("cid"), "pids")
    corner = tri.select("cid", F.explode("pids").alias("pid")).join(depth, "pid").groupBy("cid").agg(F.when(F.count("depth") == 3, F.max("depth") - F.min("depth")).alias("distortion"))
    return points, tri.join(corner, "cid")


def layout_slots(nodes: DataFrame, level: str = "level", size: str = "size") -> DataFrame:
    """nodes with slot_lo and slot_hi: room side by side within each level, as wide as their sizes."""
    w = Window.partitionBy(level).orderBy("vid").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("slot_hi", F.sum(size).over(w)).withColumn("slot_lo", F.col("slot_hi") - F.col(size))


