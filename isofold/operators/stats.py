"""Statistics of ensembles and distances between fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _power(d: Column, n: int | str) -> Column:
    return F.abs(d) if n == "inf" else F.pow(F.abs(d), F.lit(int(n)))


def _rooted(d: Column, n: int | str) -> Column:
    return F.max(d) if n == "inf" else F.pow(F.sum(d), F.lit(1.0 / int(n)))


def check_norm(n: int | str) -> None:
    if n != "inf" and int(n) < 1:
        raise ValueError("n is a whole number from 1, or inf")


def field_distance(df: DataFrame, a: str, b: str, n: int | str = 2, groups: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with |a - b|^n in `difference`, the distance of each group)."""
    check_norm(n)
    points = df.withColumn("difference", _power(F.col(a).cast("double") - F.col(b).cast("double"), n))
    return points, points.groupBy(*(groups or [])).agg(_rooted(F.col("difference"), n).alias("distance"))


def distance_matrix(fields: DataFrame, n: int | str = 2, ds: str = "ds", vid: str = "vid", value: str = "value", mirror: bool = True) -> DataFrame:
    """(i, j, dist) between all blocks' fields: a join by vertex with i < j, then, with mirror, the other half and the zeros."""
    check_norm(n)
    a = fields.select(F.col(ds).alias("i"), F.col(vid).alias("v"), F.col(value).cast("double").alias("a"))
    b = fields.select(F.col(ds).alias("j"), F.col(vid).alias("v"), F.col(value).cast("double").alias("b"))
    half = a.join(b, "v").where("i < j").groupBy("i", "j").agg(_rooted(_power(F.col("a") - F.col("b"), n), n).alias("dist"))
    if not mirror:
        return half
    zero = fields.select(F.col(ds).alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("dist"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")).unionByName(zero)


def wide_matrix(matrix: DataFrame, width: int = 0) -> DataFrame:
    """A matrix with a column for each j, named with zeros in front; j's count is the ensemble's size."""
    names = sorted(r[0] for r in matrix.select("j").distinct().collect())
    width = width or len(str(max(names, default=0)))
    out = matrix.groupBy("i").pivot("j", names).agg(F.first("dist"))
    return out.select("i", *(F.col(str(c)).alias(f"Dataset{c:0{width}d}") for c in names))


def uncertainty(fields: DataFrame, bins: int = 10, vid: str = "vid", value: str = "value") -> DataFrame:
    """(vid, lower, upper, mean, bin_0 ...): bounds and mean of each vertex over the ensemble, and the share of members in each of `bins` equal bins.

    Bins span the range of all values; its top is in the last. Both aggregates combine before their shuffle.
    """
    if bins < 1:
        raise ValueError("bins is 1 or more")
    v = F.col(value).cast("double")
    span = fields.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    binned = fields.crossJoin(F.broadcast(span))  # one row
    place = F.coalesce(F.least(F.floor(F.try_divide((v - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)), F.lit(0))
    counts = [(F.sum(F.when(F.col("_bin") == k, 1).otherwise(0)) / F.count(F.lit(1))).alias(f"bin_{k}") for k in range(bins)]
    return binned.withColumn("_bin", place).groupBy(vid).agg(F.min(v).alias("lower"), F.max(v).alias("upper"), F.avg(v).alias("mean"), *counts)


def continuous_scatter(vertices: DataFrame, cells: DataFrame, u: str, v: str, resolution: tuple[int, int], dummy: float | None = None) -> DataFrame:
    """(ds, px, py, density, hits): the volume of each ds's tetrahedra over a raster of its two fields' ranges, and how many of them reach the pixel.

    A tetrahedron's projection is a triangle or a quadrangle whose density is greatest where its longest fibre projects to, and falls linearly to nothing at the
    rim: three or four triangles, clipped to each pixel of its box and integrated. One that projects to a line or a point is cut by its fields' values. All volume is
    counted, once. Corners with the dummy value or without values leave a tetrahedron out.
    """
    w, h = resolution
    own = vertices.select("ds", "vid", "x", "y", "z", F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"))
    span = own.groupBy("ds").agg(F.min("u").alias("u_lo"), F.max("u").alias("u_hi"), F.min("v").alias("v_lo"), F.max("v").alias("v_hi"))
    place = {n: F.coalesce(F.try_divide((F.col(n) - F.col(f"{n}_lo")) * size, F.col(f"{n}_hi") - F.col(f"{n}_lo")), F.when(F.col(n).isNotNull(), 0.0)) for n, size in (("u", w), ("v", h))}
    at = own.join(span, "ds").select("ds", "vid", "x", "y", "z", F.col("u").alias("u0"), F.col("v").alias("v0"), place["u"].alias("u"), place["v"].alias("v"))
    corner = cells.where(F.size("verts") == 4).select("ds", "cid", F.posexplode("verts").alias("p", "vid")).join(at, ["ds", "vid"])
    held = F.col("u").isNotNull() & F.col("v").isNotNull()
    if dummy is not None:
        held = held & (F.col("u0") != dummy) & (F.col("v0") != dummy)
    c = F.array_sort(F.collect_list(F.struct("p", "x", "y", "z", "u", "v")))
    tets = corner.groupBy("ds", "cid").agg(c.alias("c"), F.count(F.when(held, 1)).alias("n")).where("n = 4")
    d = {(n, k): F.col("c")[k][n] - F.col("c")[0][n] for n in "xyz" for k in (1, 2, 3)}
    volume = F.abs(d["x", 1] * (d["y", 2] * d["z", 3] - d["z", 2] * d["y", 3]) - d["y", 1] * (d["x", 2] * d["z", 3] - d["z", 2] * d["x", 3]) + d["z", 1] * (d["x", 2] * d["y", 3] - d["y", 2] * d["x", 3])) / 6

    def pixels(n: str, size: int) -> Column:
        values = F.transform("c", lambda k: k[n])
        last = lambda x: F.least(F.floor(x), F.lit(size - 1))
        return F.explode(F.sequence(last(F.array_min(values)), last(F.array_max(values))))

    met = tets.select("ds", "c", volume.alias("volume"), pixels("u", w).alias("px")).select("*", pixels("v", h).alias("py"))
    flat = met.select("ds", "px", "py", "volume", *(F.col("c")[k][n].alias(f"{n}{k}") for k in range(4) for n in "uv"))

    def measured(batches):
        for pdf in batches:
            xy = pdf[[f"{n}{k}" for k in range(4) for n in "uv"]].to_numpy(float).reshape(-1, 4, 2)
            pixel = pdf[["px", "py"]].to_numpy(float)
            mass = np.concatenate([_pixel_volumes(xy[i : i + 8192], pixel[i : i + 8192], (w, h)) for i in range(0, len(pdf), 8192)] or [np.zeros(0)])
            yield pd.DataFrame({"ds": pdf["ds"], "px": pdf["px"], "py": pdf["py"], "density": mass * pdf["volume"]})

    parts = flat.mapInPandas(measured, "ds long, px long, py long, density double").where("density > 0")
    return parts.groupBy("ds", "px", "py").agg(F.sum("density").alias("density"), F.count(F.lit(1)).alias("hits"))


def _pixel_volumes(xy: np.ndarray, pixel: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """The share of each tetrahedron (n, 4 corners, 2 fields in pixels) that lies in its pixel (n, 2)."""
    cross = lambda a, b: a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]
    # weights with sum 0 that balance the four projected corners: what has one sign meets what has the other at the peak
    rest = ((1, 2, 3), (0, 2, 3), (0, 1, 3), (0, 1, 2))
    weight = np.stack([(-1) ** i * cross(xy[:, b] - xy[:, a], xy[:, c] - xy[:, a]) for i, (a, b, c) in enumerate(rest)], 1)
    scale = np.abs(weight).max(1)
    extent = np.ptp(xy, axis=1)
    thin = scale <= 1e-12 * np.maximum(extent.max(1) ** 2, 1e-300)
    out = np.zeros(len(xy))
    out[thin] = _thin_volumes(xy[thin], pixel[thin], size)
    xy, pixel, weight = xy[~thin], pixel[~thin], weight[~thin]
    plus = weight > 0
    many = plus.sum(1)
    share = np.where(plus, weight, 0)
    peak = (share[:, :, None] * xy).sum(1) / share.sum(1)[:, None]
    total, hull = np.zeros(len(xy)), np.zeros(len(xy))
    for i in range(4):
        for j in range(i + 1, 4):
            # the rim runs between the signs if they are two and two, else among the three
            rim = np.where(many == 2, plus[:, i] != plus[:, j], plus[:, i] == plus[:, j])
            area = np.abs(cross(xy[:, i] - peak, xy[:, j] - peak)) / 2
            hull += np.where(rim, area, 0)
            used = np.flatnonzero(rim & (area > 0))
            corners = np.stack((peak[used], xy[used, i], xy[used, j]), 1) - pixel[used, None, :]
            height = np.broadcast_to(np.array([1.0, 0.0, 0.0])[None, :, None], (len(used), 3, 1))
            total[used] += _clipped_mass(np.concatenate((corners, height), 2))
    out[~thin] = 3 * total / hull
    return out


def _clipped_mass(poly: np.ndarray) -> np.ndarray:
    """The integral of a linear height over each polygon's (n, k, (u, v, height)) part in the unit square."""
    for axis, sign, bound in ((0, 1, 0.0), (0, -1, -1.0), (1, 1, 0.0), (1, -1, -1.0)):
        nxt = np.roll(poly, -1, 1)
        da, db = sign * poly[..., axis] - bound, sign * nxt[..., axis] - bound
        crosses = (da < 0) != (db < 0)
        on = poly + np.where(crosses, da / np.where(crosses, da - db, 1), 0)[..., None] * (nxt - poly)
        slots = np.stack((on, nxt), 2).reshape(len(poly), 2 * poly.shape[1], 3)
        there = np.stack((crosses, db >= 0), 2).reshape(len(poly), 2 * poly.shape[1])
        # what isn't there repeats what comes before it, around the polygon
        k = there.shape[1]
        last = np.maximum.accumulate(np.where(there, np.arange(k), -1), 1)
        last = np.where(last < 0, last[:, -1:], last)
        poly = np.where(there.any(1)[:, None, None], np.take_along_axis(slots, np.maximum(last, 0)[..., None], 1), 0.0)
    a, b, c = poly[:, :1], poly[:, 1:-1], poly[:, 2:]
    area = np.abs((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])) / 2
    return (area * (a[..., 2] + b[..., 2] + c[..., 2]) / 3).sum(1)


def _below(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of a tetrahedron where a field is at most x; t (n, 4) are its sorted values at the corners."""
    t0, t1, t2, t3 = t.T
    s = lambda a, b: np.clip((x - a) / np.where(b > a, b - a, 1), 0, 1)
    two = s(t1, t2) * s(t1, t3) + s(t0, t2) * s(t1, t3) * (1 - s(t1, t2)) + s(t0, t2) * s(t0, t3) * (1 - s(t1, t3))
    one, three = s(t0, t1) * s(t0, t2) * s(t0, t3), 1 - (1 - s(t0, t3)) * (1 - s(t1, t3)) * (1 - s(t2, t3))
    return np.select([x < t0, x < t1, x < t2, x < t3], [np.zeros_like(x), one, two, three], 1.0)


def _thin_volumes(xy: np.ndarray, pixel: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """As `_pixel_volumes` where the corners project to a line or a point."""
    n = np.arange(len(xy))
    extent = np.ptp(xy, axis=1)
    main = (extent[:, 1] > extent[:, 0]).astype(int)
    t, other = xy[n, :, main], xy[n, :, 1 - main]
    lo, hi = pixel[n, main], pixel[n, main] + 1
    limit = np.array(size, float)
    a, b = t.argmin(1), t.argmax(1)
    flat = (extent[n, 1 - main] <= 1e-12 * extent[n, main]) | (extent[n, main] == 0)
    slope = (other[n, b] - other[n, a]) / np.where(t[n, b] > t[n, a], t[n, b] - t[n, a], 1)
    back = lambda y: t[n, a] + (y - other[n, a]) / np.where(flat, 1, slope)
    e0, e1 = back(pixel[n, 1 - main]), back(pixel[n, 1 - main] + 1)
    lo = np.where(flat, lo, np.maximum(lo, np.minimum(e0, e1)))
    hi = np.where(flat, hi, np.minimum(hi, np.maximum(e0, e1)))
    here = ~flat | (np.minimum(np.floor(other[n, a]), limit[1 - main] - 1) == pixel[n, 1 - main])
    t = np.sort(t, 1)
    share = np.where(hi > lo, _below(t, hi) - _below(t, lo), 0.0)
    point = t[:, 0] == t[:, 3]
    share = np.where(point, np.minimum(np.floor(t[:, 0]), limit[main] - 1) == pixel[n, main], share)
    return np.where(here, share, 0.0)
