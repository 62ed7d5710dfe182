"""Generated point sets, spheres and camera rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gaussian_points(spark: SparkSession, n: int, dim: int = 3, seed: int = 0) -> DataFrame:
    """(vid, x, y, z): a direction uniform in a cube and normalised, times one normal radius; axes beyond dim are 0."""
    out = spark.range(n).withColumnRenamed("id", "vid").withColumns({f"d{k}": F.rand(seed * 7 + k) * 2 - 1 for k in range(dim)}).withColumn("r", F.randn(seed * 7 + 5))
    norm = F.sqrt(sum((F.col(f"d{k}") * F.col(f"d{k}") for k in range(dim)), F.lit(0.0)))
    return out.select("vid", *((F.try_divide(F.col(f"d{k}"), norm) * F.col("r") if k < dim else F.lit(0.0)).alias(c) for k, c in enumerate("xyz")))


def _icosahedron() -> tuple[list[tuple[float, float, float]], list[tuple[int, int, int]]]:
    """Corners at (0, +-1, +-golden ratio) and its turns; faces are the triples that are an edge length, 2, apart."""
    g = (1 + math.sqrt(5)) / 2
    pts = [p for a in (-1.0, 1.0) for b in (-g, g) for p in ((0.0, a, b), (a, b, 0.0), (b, 0.0, a))]
    near = [[j for j in range(12) if abs(math.dist(pts[i], pts[j]) - 2) < 1e-9] for i in range(12)]
    faces = [(i, j, k) for i in range(12) for j in near[i] if j > i for k in near[i] if k > j and k in near[j]]
    return pts, faces


def icosphere(spark: SparkSession, subdivisions: int = 0, radius: float = 1.0, centre: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """(vertices (ds, vid, x, y, z), cells (ds, cid, verts)): 10 * 4^s + 2 points, 20 * 4^s triangles. Edges share their midpoints."""
    pts, faces = _icosahedron()
    v = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "vid long, x double, y double, z double")
    c = spark.createDataFrame([(i, list(f)) for i, f in enumerate(faces)], "cid long, verts array<bigint>")
    for s in range(subdivisions):
        n = 10 * 4**s + 2
        side = c.select("cid", "verts", F.posexplode(F.array(*(F.array_sort(F.array(F.col("verts")[i], F.col("verts")[j])) for i, j in ((0, 1), (1, 2), (2, 0))))).alias("k", "e"))
        from pyspark.sql import Window

        e = side.select("e").distinct()
        e = e.withColumn("m", F.row_number().over(Window.orderBy("e")) - 1 + n) if s < 3 else _numbered(e, n)
        a, b = v.select(F.col("vid").alias("_a"), *(F.col(x).alias(f"{x}a") for x in "xyz")), v.select(F.col("vid").alias("_b"), *(F.col(x).alias(f"{x}b") for x in "xyz"))
        mid = e.withColumn("_a", F.col("e")[0]).withColumn("_b", F.col("e")[1]).join(a, "_a").join(b, "_b").select(F.col("m").alias("vid"), *((F.col(f"{x}a") + F.col(f"{x}b")).alias(x) for x in "xyz"))
        v = v.unionByName(mid)
        m = side.join(e, "e").groupBy("cid", "verts").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda q: q["m"]).alias("m"))
        o = F.col("verts")
        four = F.array(F.array(o[0], F.col("m")[0], F.col("m")[2]), F.array(o[1], F.col("m")[1], F.col("m")[0]), F.array(o[2], F.col("m")[2], F.col("m")[1]), F.array(F.col("m")[0], F.col("m")[1], F.col("m")[2]))
        c = m.select("cid", F.posexplode(four).alias("k", "v")).select((F.col("cid") * 4 + F.col("k")).alias("cid"), F.col("v").cast("array<bigint>").alias("verts"))
        length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
        v = v.select("vid", *((F.col(x) / length).alias(x) for x in "xyz"))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    v = v.select(F.lit(0).cast("long").alias("ds"), F.col("vid").cast("long").alias("vid"), *((F.col(x) / length * radius + o).alias(x) for x, o in zip("xyz", centre)))
    return v, c.select(F.lit(0).cast("long").alias("ds"), "cid", "verts")


def _numbered(e: DataFrame, start: int) -> DataFrame:
    from ..functions.order import dense_index

    return dense_index(e, ["e"], "m", start)


def icosphere_around(vertices: DataFrame, subdivisions: int = 0, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """An icosphere about a data set's box: at its centre, scale times half its diagonal."""
    box = vertices.agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    centre = tuple((box[f"lo{c}"] + box[f"hi{c}"]) / 2 for c in "xyz")
    return icosphere(vertices.sparkSession, subdivisions, scale * math.dist([box[f"lo{c}"] for c in "xyz"], [box[f"hi{c}"] for c in "xyz"]) / 2, centre)


def _at_points(points: DataFrame, sphere: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A copy of a small sphere at each point (vid, x, y, z, ...), which keeps the point's columns; ids are point by point."""
    v, c = sphere
    n, m = v.count(), c.count()
    glyph = F.broadcast(v.select(F.col("vid").alias("_g"), *(F.col(x).alias(f"_{x}") for x in "xyz")))
    placed = points.withColumnRenamed("vid", "point").crossJoin(glyph)  # a fixed number of points of one sphere
    vertices = placed.select((F.col("point") * n + F.col("_g")).alias("vid"), *((F.col(x) + F.col(f"_{x}")).alias(x) for x in "xyz"), "point", *(k for k in points.columns if k not in ("vid", "x", "y", "z")))
    cells = points.select(F.col("vid").alias("point")).crossJoin(F.broadcast(c.select(F.col("cid").alias("_c"), F.col("verts").alias("_v"))))
    return vertices, cells.select((F.col("point") * m + F.col("_c")).alias("cid"), F.transform("_v", lambda x: x + F.col("point") * n).alias("verts"), "point")


def icospheres_at(points: DataFrame, subdivisions: int = 0, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    return _at_points(points, icosphere(points.sparkSession, subdivisions, radius))


def spheres_at(points: DataFrame, theta: int = 8, phi: int = 8, radius: float = 1.0, angles: tuple[float, float, float, float] = (0.0, 360.0, 0.0, 180.0)) -> tuple[DataFrame, DataFrame]:
    """Spheres of theta by phi points over (start, end) angles of both."""
    spark = points.sparkSession
    t0, t1, p0, p1 = (math.radians(a) for a in angles)
    grid = spark.range(theta * phi).select(F.col("id").alias("vid"), (F.lit(t0) + F.col("id") % theta * ((t1 - t0) / theta)).alias("t"), (F.lit(p0) + (F.floor(F.col("id") / theta) + 0.5) * ((p1 - p0) / phi)).alias("p"))
    v = grid.select("vid", (radius * F.sin("p") * F.cos("t")).alias("x"), (radius * F.sin("p") * F.sin("t")).alias("y"), (radius * F.cos("p")).alias("z"))
    quad = spark.range(theta * (phi - 1)).select("id", (F.col("id") % theta).alias("i"), F.floor(F.col("id") / theta).alias("j"))
    a, b, c, d = (F.col("j") * theta + F.col("i"), F.col("j") * theta + (F.col("i") + 1) % theta, (F.col("j") + 1) * theta + F.col("i"), (F.col("j") + 1) * theta + (F.col("i") + 1) % theta)
    cells = quad.select("id", F.posexplode(F.array(F.array(a, b, d), F.array(a, d, c))).alias("k", "verts")).select((F.col("id") * 2 + F.col("k")).alias("cid"), "verts")
    return _at_points(points, (v, cells))


def raster(vertices: DataFrame, value: str, width: int, height: int, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(px, py, value, depth): for each pixel of an orthographic view down the third axis, the value and depth (0 near, 1 far) of the nearest point."""
    a, b, c = axes
    box = vertices.agg(*(f(k).alias(f"{n}_{k}") for k in axes for n, f in (("lo", F.min), ("hi", F.max))))
    own = vertices.crossJoin(F.broadcast(box))  # one row
    at = {k: F.coalesce(F.least(F.floor(F.try_divide((F.col(k) - F.col(f"lo_{k}")) * n, F.col(f"hi_{k}") - F.col(f"lo_{k}"))), F.lit(n - 1)), F.lit(0)) for k, n in ((a, width), (b, height))}
    depth = F.coalesce(F.try_divide(F.col(f"hi_{c}") - F.col(c), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0))
    return own.select(at[a].alias("px"), at[b].alias("py"), depth.alias("depth"), F.col(value).alias("value"), "vid").groupBy("px", "py").agg(F.min(F.struct("depth", "vid", "value")).alias("n")).select("px", "py", F.col("n.value").alias("value"), F.col("n.depth").alias("depth"))


def cameras(vertices: DataFrame, views: int = 8, distance: float = 2.0) -> DataFrame:
    """(camera, px, py, pz, fx, fy, fz, near, far): cameras on a circle about a data set's box, each focused on its centre."""
    box = vertices.agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    r = F.expr("sqrt(pow(hix - lox, 2) + pow(hiy - loy, 2) + pow(hiz - loz, 2)) / 2")
    one = box.withColumns({"r": r, **{f"f{c}": F.expr(f"(lo{c} + hi{c}) / 2") for c in "xyz"}})
    turn = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("camera")).withColumn("t", F.col("camera") * (2 * math.pi / views))
    return turn.select("camera", (F.col("fx") + distance * F.col("r") * F.cos("t")).alias("px"), (F.col("fy") + distance * F.col("r") * F.sin("t")).alias("py"), F.col("fz").alias("pz"), "fx", "fy", "fz", ((distance - 1) * F.col("r")).alias("near"), ((distance + 1) * F.col("r")).alias("far"))
