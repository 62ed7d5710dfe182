"""Distances, barycenters and clusters of persistence diagrams: rows (ds, birth, death, pair_type[, birth_type, death_type])."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .assign import bottleneck as bottleneck_assignment
from .assign import diagonal_assignment

Diagram = dict[int, np.ndarray]


def constrained(diagrams: DataFrame, mode: str = "full", k: int = 0, threshold: float = 0.0) -> DataFrame:
    """Pairs of positive persistence: all (full), the k most persistent of each ds (top), or those with persistence above a bound: `absolute`, a share of the ds's largest (`relative`), a share of the largest of all (`global`)."""
    p = diagrams.withColumn("_p", F.col("death") - F.col("birth")).where("_p > 0")
    if mode == "top":
        w = Window.partitionBy("ds").orderBy(F.desc("_p"), "birth", "death", "pair_type")
        p = p.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    elif mode == "absolute":
        p = p.where(F.col("_p") > threshold)
    elif mode == "relative":
        most = p.groupBy(F.col("ds").alias("_ds")).agg(F.max("_p").alias("_m"))
        p = p.join(most, F.col("ds") == F.col("_ds")).where(F.col("_p") > threshold * F.col("_m")).drop("_ds", "_m")
    elif mode == "global":
        p = p.crossJoin(F.broadcast(p.agg(F.max("_p").alias("_m")))).where(F.col("_p") > threshold * F.col("_m")).drop("_m")  # one row
    elif mode != "full":
        raise ValueError(mode)
    return p.drop("_p")


def as_diagram(pdf: pd.DataFrame) -> Diagram:
    return {int(t): g[["birth", "death"]].to_numpy(float) for t, g in pdf.groupby("pair_type")}


def matching(a: np.ndarray, b: np.ndarray, p: float = 2.0) -> tuple[list[tuple[int, int, float]], float]:
    """The cheapest matching of two sets of (birth, death), the diagonal included, and its cost without a root."""
    cost = (np.abs(a[:, None, :] - b[None, :, :]) ** p).sum(2) if len(a) and len(b) else np.zeros((len(a), len(b)))
    diagonal = [2 * (np.abs(x[:, 1] - x[:, 0]) / 2) ** p if len(x) else np.zeros(0) for x in (a, b)]
    return diagonal_assignment(cost, *diagonal)


def wasserstein(a: Diagram, b: Diagram, p: float = 2.0, rooted: bool = True) -> float:
    none = np.zeros((0, 2))
    total = sum(matching(a.get(t, none), b.get(t, none), p)[1] for t in sorted(set(a) | set(b)))
    return total ** (1 / p) if rooted else total


def bottleneck(a: Diagram, b: Diagram) -> float:
    """The largest cost over pair types of the matching whose largest cost is least."""
    worst, none = 0.0, np.zeros((0, 2))
    for t in sorted(set(a) | set(b)):
        x, y = a.get(t, none), b.get(t, none)
        n, m = len(x), len(y)
        cost = np.zeros((n + m, n + m))
        if n and m:
            cost[:n, :m] = np.abs(x[:, None, :] - y[None, :, :]).max(2)
        cost[:n, m:] = ((x[:, 1] - x[:, 0]) / 2)[:, None] if n else 0
        cost[n:, :m] = ((y[:, 1] - y[:, 0]) / 2)[None, :] if m else 0
        worst = max(worst, bottleneck_assignment(cost)[1])
    return worst


def by_block_pairs(members: DataFrame, kernel, schema: str, block: int = 16) -> DataFrame:
    """kernel(left {ds: rows}, right {ds: rows}, same) for each pair of blocks of members; a member goes to as many pairs as there are blocks."""
    n = members.select("ds").distinct().count()
    blocks = max(1, -(-n // block))
    own = F.pmod(F.xxhash64("ds"), F.lit(blocks))
    tagged = members.withColumn("_b", own).withColumn("_o", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    tagged = tagged.withColumns({"_lo": F.least("_b", "_o"), "_hi": F.greatest("_b", "_o")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
        left = {int(d): g for d, g in pdf[pdf["_b"] == lo].groupby("ds")}
        right = {int(d): g for d, g in pdf[pdf["_b"] == hi].groupby("ds")}
        return kernel(left, right, lo == hi)

    return tagged.groupBy("_lo", "_hi").applyInPandas(run, schema)


def distance_matrix(diagrams: DataFrame, p: float = 2.0, rooted: bool = True, kind: str = "wasserstein", mirror: bool = True) -> DataFrame:
    """(i, j, dist) between all diagrams; with mirror both halves and zeros."""
    own = diagrams.select("ds", "birth", "death", "pair_type")

    def kernel(left, right, same):
        a, b = ({d: as_diagram(g) for d, g in side.items()} for side in (left, right))
        out = []
        for i, x in a.items():
            for j, y in b.items():
                if i < j or (not same and i > j):
                    d = bottleneck(x, y) if kind == "bottleneck" else wasserstein(x, y, p, rooted)
                    out.append((min(i, j), max(i, j), d))
        return pd.DataFrame(out, columns=["i", "j", "dist"])

    half = by_block_pairs(own, kernel, "i long, j long, dist double")
    if not mirror:
        return half
    zero = diagrams.select(F.col("ds").alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("dist"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")).unionByName(zero)


def matchings(diagrams: DataFrame, pairs: DataFrame, p: float = 2.0) -> DataFrame:
    """(i, j, pair_type, birth1, death1, birth2, death2, cost) of the pairs (i, j) of diagrams; null where the diagonal is the partner."""
    d = diagrams.select("ds", "birth", "death", "pair_type")
    left = pairs.join(d.withColumnRenamed("ds", "i"), "i")
    right = pairs.join(d.withColumnRenamed("ds", "j"), "j").select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("birth").alias("birth2"), F.col("death").alias("death2"), F.col("pair_type").alias("type2"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        i, j = (a[["i", "j"]] if len(a) else b[["i2", "j2"]]).iloc[0]
        x, y = as_diagram(a) if len(a) else {}, as_diagram(b.rename(columns={"birth2": "birth", "death2": "death", "type2": "pair_type"})) if len(b) else {}
        none = np.zeros((0, 2))
        for t in sorted(set(x) | set(y)):
            u, v = x.get(t, none), y.get(t, none)
            for k, m, c in matching(u, v, p)[0]:
                out.append((int(i), int(j), t, *(u[k] if k >= 0 else (None, None)), *(v[m] if m >= 0 else (None, None)), c))
        return pd.DataFrame(out, columns=["i", "j", "pair_type", "birth1", "death1", "birth2", "death2", "cost"])

    return left.groupBy("i", "j").cogroup(right.groupBy("i2", "j2")).applyInPandas(run, "i long, j long, pair_type int, birth1 double, death1 double, birth2 double, death2 double, cost double")


def _updated(centre: Diagram, members: list[Diagram]) -> Diagram:
    """One step of a barycenter: a point moves to the mean of its partners, where those on the diagonal pull it there; points without one appear."""
    out: Diagram = {}
    none, n = np.zeros((0, 2)), len(members)
    for t in sorted(set(centre).union(*members)):
        c = centre.get(t, none)
        total, k, fresh = np.zeros_like(c), np.zeros(len(c)), []
        for m in members:
            y = m.get(t, none)
            for i, j, _ in matching(c, y)[0]:
                if i >= 0 and j >= 0:
                    total[i] += y[j]
                    k[i] += 1
                elif j >= 0:
                    middle = y[j].mean()
                    fresh.append((y[j] + (n - 1) * middle) / n)
        points = []
        for i in range(len(c)):
            if k[i]:
                mean = total[i] / k[i]
                points.append((k[i] * mean + (n - k[i]) * mean.mean()) / n)
        points = np.array(points + fresh).reshape(-1, 2)
        out[t] = points[points[:, 1] - points[:, 0] > 1e-9]
    return out


def barycenter_of(members: list[Diagram], rounds: int | None = None, tolerance: float = 1e-3) -> tuple[Diagram, float]:
    """(barycenter, energy): the mean of squared distances falls until it changes by less than the tolerance; if `rounds` are given and are over before, a warning says so."""
    energy = [sum(wasserstein(m, x, rooted=False) for x in members) for m in members]
    start = int(np.argmin(energy))
    centre, last = members[start], energy[start] / len(members)
    for done in itertools.count():
        if rounds is not None and done >= rounds:
            warnings.warn(f"the energy still falls after {rounds} rounds: it is {last}", stacklevel=2)
            return centre, last
        new = _updated(centre, members)
        now = sum(wasserstein(new, m, rooted=False) for m in members) / len(members)
        if now > last - tolerance * max(last, 1e-12):
            return (new, now) if now <= last else (centre, last)
        centre, last = new, now


def barycenters(diagrams: DataFrame, group: str = "cluster", rounds: int | None = None) -> DataFrame:
    """(group, pair_type, birth, death, energy) of each group's diagrams (ds); a group is one task's, so its diagrams should be filtered first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        centre, energy = barycenter_of([as_diagram(g) for _, g in pdf.groupby("ds")], rounds)
        rows = [(pdf[group].iloc[0], t, b, d, energy) for t, x in centre.items() for b, d in x]
        return pd.DataFrame(rows, columns=[group, "pair_type", "birth", "death", "energy"])

    return diagrams.select(group, "ds", "birth", "death", "pair_type").groupBy(group).applyInPandas(run, f"{group} long, pair_type int, birth double, death double, energy double")


def cluster(diagrams: DataFrame, k: int, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignment (ds, ClusterAssignment, distance), centroids (cluster, pair_type, birth, death)): k-means under squared Wasserstein distance.

    The first centroid is the diagram with the least ds, each further one the diagram farthest from those chosen. Centroids, k diagrams, live on the
    driver and are broadcast; assignment runs over the diagrams' groups, barycenters over the clusters'. Rounds go on until the sum of distances falls
    no more; if `rounds` are given and are over before, a warning says so.
    """
    from ..functions.storage import settled

    spark = diagrams.sparkSession
    own = settled(diagrams.select("ds", "birth", "death", "pair_type"), "diagrams")

    def fetch(ds: int) -> Diagram:
        return as_diagram(own.where(F.col("ds") == ds).toPandas())

    def assigned(centres: list[Diagram]) -> DataFrame:
        shared = spark.sparkContext.broadcast(centres)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            d = [wasserstein(as_diagram(pdf), c, rooted=False) for c in shared.value]
            return pd.DataFrame([(int(pdf["ds"].iloc[0]), int(np.argmin(d)), float(min(d)))], columns=["ds", "ClusterAssignment", "distance"])

        return settled(own.groupBy("ds").applyInPandas(run, "ds long, ClusterAssignment long, distance double"), "assigned")

    first = own.agg(F.min("ds")).first()[0]
    if first is None:
        return spark.createDataFrame([], "ds long, ClusterAssignment long, distance double"), spark.createDataFrame([], "cluster long, pair_type int, birth double, death double")
    centres = [fetch(first)]
    now = assigned(centres)
    while len(centres) < k:
        far = now.orderBy(F.desc("distance"), "ds").first()
        if far is None or far["distance"] <= 0:
            break
        centres.append(fetch(far["ds"]))
        now = assigned(centres)
    last = now.agg(F.sum("distance")).first()[0]
    for done in itertools.count():
        if rounds is not None and done >= rounds:
            warnings.warn(f"the sum of distances still falls after {rounds} rounds: it is {last}", stacklevel=2)
            break
        rows = barycenters(own.join(now.select("ds", F.col("ClusterAssignment").alias("cluster")), "ds")).toPandas()
        made = {int(c): as_diagram(g) for c, g in rows.groupby("cluster")}
        new = [made.get(i, c) for i, c in enumerate(centres)]
        then = assigned(new)
        inertia = then.agg(F.sum("distance")).first()[0]
        if inertia >= last - 1e-9:
            break
        centres, now, last = new, then, inertia
    rows = [(i, t, float(b), float(d)) for i, c in enumerate(centres) for t, x in c.items() for b, d in x]
    return now, spark.createDataFrame(rows, "cluster long, pair_type int, birth double, death double")
