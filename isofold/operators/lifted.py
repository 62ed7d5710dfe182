"""Persistence diagrams lifted by geometry: costs that weigh where critical points lie as well as their values, tracks under them, and splits and merges of tracks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import dense_index
from . import diagrams as dg
from . import graph, kernels
from .assign import bottleneck as bottleneck_assignment
from .assign import diagonal_assignment

PAIR = ["birth", "death", "kind", "top", "bx", "by", "bz", "dx", "dy", "dz"]
MINIMUM, SADDLES, MAXIMUM = 0, 1, 2


@dataclass(frozen=True)
class Weights:
    """Of the values of a pair's extremum and saddle, and of the distance along each axis; by default values alone."""

    extremum: float = 1.0
    saddle: float = 1.0
    x: float = 0.0
    y: float = 0.0
    z: float = 0.0


def lifted(diagrams: DataFrame, points: DataFrame) -> DataFrame:
    """Diagrams with both critical points' coordinates, from points (ds, vid, x, y, z).

    kind is 0 for pairs with a minimum, else 2 for those with a maximum, else 1: only pairs of a kind can be partners. top says that the later point is a
    maximum, as of the global pair, which is of kind 0. Null coordinates, and points that lack, count as 0.
    """
    d = diagrams
    for vid, c in (("birth_vid", "b"), ("death_vid", "d")):
        at = points.select(F.col("ds"), F.col("vid").alias(vid), *(F.col(a).cast("double").alias(f"{c}{a}") for a in "xyz"))
        d = d.join(at, ["ds", vid], "left")
    top = F.col("death_type") == kernels.MAXIMUM
    kind = F.when(F.col("birth_type") == kernels.MINIMUM, MINIMUM).when(top, MAXIMUM).otherwise(SADDLES)
    return d.fillna(0.0, [f"{c}{a}" for c in "bd" for a in "xyz"]).select("ds", "birth_vid", "death_vid", "birth", "death", kind.alias("kind"), top.alias("top"), *PAIR[4:])


def _parts(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    return rows[:, 0:2], rows[:, 3] > 0, rows[:, 4:7], rows[:, 7:10]


def costs(a: np.ndarray, b: np.ndarray, w: Weights, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(between, to the diagonal of a, of b) of pairs of one kind, rows of PAIR, to the power p without a root.

    Between: the weighted differences of both values and of the extremum's coordinates (two saddles: of their middle). Two pairs with a maximum are
    told apart at it, others at the minimum. Diagonal: the weighted persistence and the way between a pair's own two points.
    """
    axes = np.array([w.x, w.y, w.z])
    (va, ta, ba, da), (vb, tb, bb, db) = _parts(a), _parts(b)
    kind = int((a if len(a) else b)[0, 2]) if len(a) or len(b) else MINIMUM
    diff = np.abs(va[:, None, :] - vb[None, :, :]) ** p
    way = lambda x, y: (np.abs(x[:, None, :] - y[None, :, :]) ** p) @ axes
    if kind == SADDLES:
        between = w.saddle * diff.sum(2) + way((ba + da) / 2, (bb + db) / 2)
    else:
        high = ta[:, None] & tb[None, :]
        at_top = w.saddle * diff[..., 0] + w.extremum * diff[..., 1] + way(da, db)
        at_bottom = w.extremum * diff[..., 0] + w.saddle * diff[..., 1] + way(ba, bb)
        between = np.where(high, at_top, at_bottom)
    value = w.saddle if kind == SADDLES else w.extremum
    own = [value * np.abs(v[:, 1] - v[:, 0]) ** p + (np.abs(e - s) ** p) @ axes for v, s, e in ((va, ba, da), (vb, bb, db))]
    return between, own[0], own[1]


def partners(a: np.ndarray, b: np.ndarray, w: Weights, p: float) -> tuple[list[tuple[int, int, float]], float]:
    """(matched rows of a and b, with -1 for the diagonal, and the cost of each; the sum of costs, for p = inf the largest) of the best matching of two diagrams."""
    out, total = [], 0.0
    for kind in (MINIMUM, SADDLES, MAXIMUM):
        ia, ib = np.flatnonzero(a[:, 2] == kind), np.flatnonzero(b[:, 2] == kind)
        n, m = len(ia), len(ib)
        if not n + m:
            continue
        between, da, db = costs(a[ia], b[ib], w, 1.0 if np.isinf(p) else p)
        if np.isinf(p):
            full = np.zeros((n + m, n + m))
            full[:n, :m], full[:n, m:], full[n:, :m] = between, da[:, None], db[None, :]
            to, worst = bottleneck_assignment(full)
            found = [(i, int(j), float(full[i, j])) for i, j in enumerate(to) if i < n or j < m]
            total = max(total, float(worst))
        else:
            found, least = diagonal_assignment(between, da, db)
            total += least
        out += [(int(ia[i]) if 0 <= i < n else -1, int(ib[j]) if 0 <= j < m else -1, c) for i, j, c in found]
    return out, total


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[PAIR].to_numpy(float).reshape(-1, len(PAIR))


def distance_matrix(pairs: DataFrame, w: Weights = Weights(), p: float = 2.0) -> DataFrame:
    """(i, j, dist) for i < j of all lifted diagrams: the root of the least sum of costs; for p = inf the bottleneck's, whose costs are sums of plain differences."""

    def kernel(left, right, same):
        a, b = ({d: _rows(g) for d, g in side.items()} for side in (left, right))
        out = []
        for i, x in a.items():
            for j, y in b.items():
                if i < j or (not same and i > j):
                    total = partners(x, y, w, p)[1]
                    out.append((min(i, j), max(i, j), total if np.isinf(p) else total ** (1 / p)))
        return pd.DataFrame(out, columns=["i", "j", "dist"])

    return dg.by_block_pairs(pairs.select("ds", *PAIR), kernel, "i long, j long, dist double")


def tracks(pairs: DataFrame, w: Weights = Weights(), p: float = 2.0) -> DataFrame:
    """(t, birth, death, kind, top, birth_vid, death_vid, x, y, z, track): chains of partners in successive lifted diagrams, whose ds is time.

    x, y, z are the extremum's (two saddles: their middle's); a track is named by the number of its first pair. Steps are matched beside one another, chains followed by doubled jumps.
    """
    d = dense_index(pairs.select("ds", "birth_vid", "death_vid", *PAIR), ["ds", "kind", "birth", "death", "birth_vid", "death_vid"], "v")
    steps = d.select(F.col("ds").alias("i")).distinct().withColumn("j", F.lead("i").over(Window.orderBy("i"))).where("j is not null")
    left = steps.join(d.withColumnRenamed("ds", "i"), "i").select("i", "v", *PAIR)
    right = steps.join(d.withColumnRenamed("ds", "j"), "j").select(F.col("i").alias("step"), "v", *PAIR)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("v"), b.sort_values("v")
        x, y = a["v"].to_numpy(), b["v"].to_numpy()
        return pd.DataFrame([(int(y[j]), int(x[i])) for i, j, _ in partners(_rows(a), _rows(b), w, p)[0] if i >= 0 and j >= 0], columns=["v", "nxt"])

    links = left.groupBy("i").cogroup(right.groupBy("step")).applyInPandas(run, "v long, nxt long")
    ends = graph.roots(d.select("v").join(links, "v", "left")).select("v", F.col("root").alias("track"))
    place = [F.when(F.col("kind") == SADDLES, (F.col(f"b{a}") + F.col(f"d{a}")) / 2).when(F.col("top"), F.col(f"d{a}")).otherwise(F.col(f"b{a}")).alias(a) for a in "xyz"]
    return d.join(ends, "v").select(F.col("ds").alias("t"), "birth", "death", "kind", "top", "birth_vid", "death_vid", *place, "track")


def meetings(found: DataFrame, radius: float) -> DataFrame:
    """(track, other, t, event, distance): a track that begins (a split) or ends (a merge) nearer than the radius to another one's extremum of the same sense at that time.

    Found over cubes as wide as the radius: an end looks into the 27 about it. Tracks of two saddles take no part.
    """
    if not radius > 0:
        raise ValueError("the radius must be positive")
    own = found.where(F.col("kind") != SADDLES).select("track", "t", "top", "x", "y", "z")
    span = own.groupBy("track").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    cube = lambda a: F.floor(F.col(a) / radius)
    ends = own.join(span, "track").select("*", F.explode(F.expr("filter(array(if(t = first, 'begins', null), if(t = last, 'ends', null)), e -> e is not null)")).alias("event"))
    ends = ends.select("track", "t", "top", "event", *(F.col(a).alias(f"e{a}") for a in "xyz"), *(cube(a).alias(f"_{a}") for a in "xyz"))
    for a in "xyz":
        ends = ends.withColumn(f"_{a}", F.explode(F.sequence(F.col(f"_{a}") - 1, F.col(f"_{a}") + 1)))
    there = own.withColumnRenamed("track", "other").withColumns({f"_{a}": cube(a) for a in "xyz"})
    apart = F.sqrt(sum((F.col(f"e{a}") - F.col(a)) ** 2 for a in "xyz"))
    met = ends.join(there, ["t", "top", "_x", "_y", "_z"]).where(F.col("track") != F.col("other")).withColumn("distance", apart).where(F.col("distance") < radius)
    return met.groupBy("track", "other", "t", "event").agg(F.min("distance").alias("distance"))


def merged(found: DataFrame, radius: float) -> DataFrame:
    """tracks() with `component`: the smallest track that each is joined to by meetings."""
    met = meetings(found, radius)
    whole = graph.components(met.select(F.col("track").alias("a"), F.col("other").alias("b")), found.select(F.col("track").alias("node")).distinct())
    return found.join(whole.withColumnRenamed("node", "track"), "track")
