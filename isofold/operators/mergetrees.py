"""The Wasserstein metric of merge trees: distances, matchings, barycenters, geodesics, k-means, temporal subsampling.

A tree is kept as its branch decomposition: branches with birth, death and the branch they hang on. Rows are
(ds, branch, parent, birth, death); the root's parent is itself.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import settled
from . import diagrams, kernels, topology
from .assign import diagonal_assignment

BRANCHES = "ds long, branch long, parent long, birth double, death double"


@dataclass
class Tree:
    birth: np.ndarray
    death: np.ndarray
    parent: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        n = len(self.birth)
        if not len(self.ids):
            self.ids = np.arange(n)
        self.root = int(np.flatnonzero(self.parent == np.arange(n))[0]) if n else -1
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i, p in enumerate(self.parent.tolist()):
            if i != p:
                self.children[p].append(i)

    @property
    def persistence(self) -> np.ndarray:
        return np.abs(self.death - self.birth)

    def preorder(self) -> list[int]:
        out, stack = [], [self.root] if self.root >= 0 else []
        while stack:
            i = stack.pop()
            out.append(i)
            stack += reversed(self.children[i])
        return out

    def subset(self, keep: np.ndarray) -> Tree:
        """The branches with keep set; one whose parent goes hangs on the next that stays."""
        parent = self.parent.copy()
        for i in self.preorder():
            while not keep[parent[i]]:
                parent[i] = parent[parent[i]]
        at = np.cumsum(keep) - 1
        rows = np.flatnonzero(keep)
        return Tree(self.birth[rows], self.death[rows], at[parent[rows]], self.ids[rows])

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Tree:
        pdf = pdf.sort_values("branch")
        ids = pdf["branch"].to_numpy()
        return cls(pdf["birth"].to_numpy(float), pdf["death"].to_numpy(float), np.searchsorted(ids, pdf["parent"].to_numpy()), ids)

    def rows(self, ds: int) -> pd.DataFrame:
        return pd.DataFrame({"ds": ds, "branch": self.ids, "parent": self.ids[self.parent], "birth": self.birth, "death": self.death})


@dataclass(frozen=True)
class Options:
    """Percentages: eps1 merges saddles closer than that part of the widest gap (of the range, if farthest); a branch with more than 1 - eps2 of its parent's persistence and
    less than eps3 of the root's goes up a level; threshold drops the least persistent. By default nothing is merged.
    """

    eps1: float = 0.0
    eps2: float = 0.0
    eps3: float = 100.0
    farthest: bool = False
    threshold: float = 0.0
    normalized: bool = True
    min_max_pair: bool = True


def branch_decomposition(order: np.ndarray, starts: np.ndarray, nbrs: np.ndarray, values: np.ndarray, ids: np.ndarray) -> Tree:
    """Branches of the join tree in `order`'s sense by the elder rule: one ends where it meets an elder one and hangs on that."""
    n = len(order)
    seq = np.argsort(order)
    uf, birth, ends, on = kernels.UnionFind(n), list(range(n)), {}, {}
    for v in seq.tolist():
        lower = {uf.find(int(u)) for u in nbrs[starts[v] : starts[v + 1]] if order[u] < order[v]}
        if not lower:
            continue
        elder = min(lower, key=lambda r: order[birth[r]])
        for r in lower - {elder}:
            ends[birth[r]], on[birth[r]] = v, birth[elder]
        for r in lower:
            uf.parent[r] = elder
        uf.parent[v] = elder
    # of several components the one with the least extremum is the root, and the others hang on it
    tops = [r for r in range(n) if uf.find(r) == r]
    last = {}
    for v in seq.tolist():
        last[uf.find(v)] = v
    root = min((birth[r] for r in tops), key=lambda b: order[b]) if tops else None
    for r in tops:
        ends[birth[r]], on[birth[r]] = last[r], root
    nodes = sorted(ends)
    at = {b: i for i, b in enumerate(nodes)}
    return Tree(values[nodes], values[[ends[b] for b in nodes]], np.array([at[on[b]] for b in nodes], np.int64), ids[nodes])


def branch_trees(vertices: DataFrame, cells: DataFrame, kind: str = "join", value: str = "value", offset: str | None = None) -> DataFrame:
    """The branch decomposition of each ds's join or split tree."""

    def kernel(ds, f, _):
        order = f.order if kind == "join" else len(f.ids) - 1 - f.order
        return branch_decomposition(order, f.starts, f.nbrs, f.values, f.ids).rows(ds)

    return topology.per_field(vertices, cells, kernel, BRANCHES, value, offset)


def preprocessed(tree: Tree, o: Options) -> Tree:
    """Drops branches up to the persistence threshold (with a tolerance of 1e-6, and those of no persistence), hangs branches whose saddle is close to their parent's on
    the grandparent, and then those that are nearly as persistent as their parent one level up.
    """
    if not len(tree.birth):
        return tree
    pers = tree.persistence
    most = pers[tree.root]
    if len(pers) > 1:
        bound = o.threshold / 100 * most
        second = np.sort(np.delete(pers, tree.root))[-1]
        if bound >= second:
            bound = 0.99 * second
        keep = pers > bound + 1e-6
        keep[tree.root] = True
        tree = tree.subset(keep)
        pers = tree.persistence
    parent = tree.parent.copy()
    gaps = [abs(tree.death[i] - tree.death[p]) for i, p in enumerate(parent) if i != p and p != tree.root]
    near = o.eps1 / 100 * (most if o.farthest else max(gaps, default=0.0))
    for i in tree.preorder():
        p = int(parent[i])
        while p != tree.root and i != p and abs(tree.death[i] - tree.death[p]) < near:
            p = int(parent[p])
        parent[i] = p
    # one level up, from the root on: a parent that went up itself takes its children's grandparent along
    for i in Tree(tree.birth, tree.death, parent, tree.ids).preorder():
        p = int(parent[i])
        if p != tree.root and i != p and pers[p] > 0 and pers[i] / pers[p] > 1 - o.eps2 / 100 and most > 0 and pers[i] / most < o.eps3 / 100:
            parent[i] = parent[p]
    return Tree(tree.birth, tree.death, parent, tree.ids)


def relative(tree: Tree, normalized: bool) -> np.ndarray:
    """Each branch's (birth, death), within its parent's range if normalized; the root's as it is."""
    out = np.stack((tree.birth, tree.death), 1).astype(float)
    if normalized and len(out):
        lo = np.minimum(tree.birth, tree.death)[tree.parent]
        span = tree.persistence[tree.parent]
        inner = np.arange(len(out)) != tree.root
        ok = inner & (span > 0)
        out[ok] = (out[ok] - lo[ok, None]) / span[ok, None]
    return out


def absolute(rel: np.ndarray, parent: np.ndarray, root: int, normalized: bool) -> Tree:
    """The tree with such relative branches."""
    out = rel.copy()
    tree = Tree(out[:, 0], out[:, 1], parent)
    if normalized:
        for i in tree.preorder():
            if i != root:
                lo, hi = sorted(out[parent[i]])
                out[i] = lo + rel[i] * (hi - lo)
    return Tree(out[:, 0].copy(), out[:, 1].copy(), parent)


def tree_matching(a: Tree, b: Tree, o: Options) -> tuple[list[tuple[int, int]], float]:
    """(matched branches, squared distance): partial isomorphisms that map the root to the root and children to children; what is unmatched goes with its subtree."""
    if not len(a.birth) or not len(b.birth):
        t = a if len(a.birth) else b
        rel = relative(t, o.normalized)
        return [], float(((rel[:, 1] - rel[:, 0]) ** 2 / 2).sum())
    ra, rb = relative(a, o.normalized), relative(b, o.normalized)

    def gone(t: Tree, rel: np.ndarray) -> np.ndarray:
        cost = (rel[:, 1] - rel[:, 0]) ** 2 / 2
        for i in reversed(t.preorder()):
            cost[i] += sum(cost[c] for c in t.children[i])
        return cost

    da, db = gone(a, ra), gone(b, rb)
    same = ((ra[:, None, :] - rb[None, :, :]) ** 2).sum(2)
    if not o.min_max_pair:
        same[a.root, b.root] = 0.0
    # without children on one side all children of the other go
    below = [np.array([sum(d[c] for c in kids) for kids in t.children]) for t, d in ((a, da), (b, db))]
    cost = same + below[0][:, None] + below[1][None, :]
    how: dict[tuple[int, int], list[tuple[int, int]]] = {}
    depth = [np.zeros(len(t.birth), int) for t in (a, b)]
    for t, d in zip((a, b), depth):
        for i in t.preorder():
            if i != t.root:
                d[i] = d[t.parent[i]] + 1
    # only branches of one depth can be partners; deepest first
    for level in range(min(depth[0].max(), depth[1].max()), -1, -1):
        for i in np.flatnonzero(depth[0] == level).tolist():
            ca = a.children[i]
            if not ca:
                continue
            for j in np.flatnonzero(depth[1] == level).tolist():
                cb = b.children[j]
                if cb:
                    pairs, total = diagonal_assignment(cost[np.ix_(ca, cb)], da[ca], db[cb])
                    cost[i, j] = same[i, j] + total
                    how[i, j] = [(ca[x], cb[y]) for x, y, _ in pairs if x >= 0 and y >= 0]
    out, stack = [], [(a.root, b.root)]
    while stack:
        pair = stack.pop()
        out.append(pair)
        stack += how.get(pair, [])
    return out, float(cost[a.root, b.root])


def tree_distance(a: Tree, b: Tree, o: Options = Options()) -> float:
    return float(np.sqrt(max(tree_matching(preprocessed(a, o), preprocessed(b, o), o)[1], 0.0)))


def distance_matrix(trees: DataFrame, o: Options = Options(), mirror: bool = True) -> DataFrame:
    """(i, j, dist) between all trees."""

    def kernel(left, right, same):
        a, b = ({d: preprocessed(Tree.of(g), o) for d, g in side.items()} for side in (left, right))
        out = [(min(i, j), max(i, j), float(np.sqrt(max(tree_matching(x, y, o)[1], 0.0)))) for i, x in a.items() for j, y in b.items() if i < j or (not same and i > j)]
        return pd.DataFrame(out, columns=["i", "j", "dist"])

    half = diagrams.by_block_pairs(trees.select("ds", "branch", "parent", "birth", "death"), kernel, "i long, j long, dist double")
    if not mirror:
        return half
    zero = trees.select(F.col("ds").alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("dist"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")).unionByName(zero)


def matching_table(trees: DataFrame, i: int, j: int, o: Options = Options()) -> DataFrame:
    """(branch1, branch2, MatchingType, MeanMatchedPersistence, Cost) of two trees: type 3 is the root's, 2 a leaf branch's, 1 another's."""
    spark = trees.sparkSession
    a, b = (preprocessed(Tree.of(trees.where(F.col("ds") == d).toPandas()), o) for d in (i, j))
    pairs, _ = tree_matching(a, b, o)
    ra, rb = relative(a, o.normalized), relative(b, o.normalized)
    rows = [(int(a.ids[x]), int(b.ids[y]), 3 if x == a.root else 2 if not a.children[x] and not b.children[y] else 1, float((a.persistence[x] + b.persistence[y]) / 2), float(((ra[x] - rb[y]) ** 2).sum())) for x, y in pairs]
    return spark.createDataFrame(rows, "branch1 long, branch2 long, MatchingType int, MeanMatchedPersistence double, Cost double")


def _contribution(centre: Tree, member: Tree, o: Options) -> tuple[float, list[tuple[int, float, float]], list[tuple[bool, int, float, float]]]:
    """(squared distance, matched (branch of the centre, birth, death), unmatched (hangs on a matched one, its parent's place, birth, death)) of one member.

    An unmatched branch's parent is a branch of the centre, or by its place an unmatched one before it.
    """
    pairs, cost = tree_matching(centre, member, o)
    rel = relative(member, o.normalized)
    to = {y: (True, x) for x, y in pairs}
    fresh: list[tuple[bool, int, float, float]] = []
    for y in member.preorder():
        if y not in to:
            fresh.append((*to[int(member.parent[y])], *rel[y].tolist()))
            to[y] = (False, len(fresh) - 1)
    return cost, [(x, *rel[y].tolist()) for x, y in pairs], fresh


def _moved(centre: Tree, total: np.ndarray, mass: np.ndarray, fresh: list[list[tuple[float, bool, int, float, float]]], o: Options) -> Tree:
    """The centre's branches at the weighted mean of their partners, where what has none there pulls to the diagonal, with the unmatched branches added.

    total and mass: weighted sums of partners and weights by branch; fresh: each member's unmatched (weight, on a matched one, parent, birth, death).
    """
    n = len(centre.birth)
    rel = relative(centre, o.normalized)
    mean = total / np.where(mass > 0, mass, 1)[:, None]
    new = np.where(mass[:, None] > 0, mass[:, None] * mean + (1 - mass[:, None]) * mean.mean(1)[:, None], rel.mean(1)[:, None])
    more, hang = [], []
    for own in fresh:
        base = n + len(more)
        for w, matched, parent, b, d in own:
            middle = (b + d) / 2
            more.append((w * b + (1 - w) * middle, w * d + (1 - w) * middle))
            hang.append(parent if matched else base + parent)
    new = np.concatenate((new, np.array(more).reshape(-1, 2)))
    tree = absolute(new, np.concatenate((centre.parent, np.array(hang, np.int64))), centre.root, o.normalized)
    keep = np.abs(new[:, 1] - new[:, 0]) > 1e-6
    keep[centre.root] = True
    return tree.subset(keep)


def _mean_step(centre: Tree, members: list[Tree], weights: np.ndarray, o: Options) -> tuple[Tree, float]:
    """The centre after one assignment and update, and the energy before it."""
    n = len(centre.birth)
    total, mass, fresh, energy = np.zeros((n, 2)), np.zeros(n), [], 0.0
    for m, w in zip(members, weights):
        cost, matched, own = _contribution(centre, m, o)
        energy += w * cost
        for x, b, d in matched:
            total[x] += (w * b, w * d)
            mass[x] += w
        fresh.append([(w, *f) for f in own])
    return _moved(centre, total, mass, fresh, o), energy


def _goes_on(energies: list[float], rounds: int | None) -> bool:
    """Whether another round is due: not once the energy has changed by a 125th or less, nor when ten rounds have found none lower, nor after `rounds`, if any, of which a warning tells."""
    if len(energies) > 1 and abs(energies[-2] - energies[-1]) <= energies[-1] / 125:
        return False
    if len(energies) - 1 - int(np.argmin(energies)) >= 10:
        return False
    if rounds is not None and len(energies) >= rounds:
        warnings.warn(f"the energy still changes after {rounds} rounds: it was {energies[-2:]}", stacklevel=3)
        return False
    return True


def barycenter(trees: DataFrame, o: Options = Options(), rounds: int | None = None) -> tuple[DataFrame, float]:
    """(branches of the barycenter, energy) of all trees. It starts at the tree with the least sum of squared distances to the others. The centre, one tree, lives on the driver; each round matches all members to it in
    parallel, sums partners by branch in Spark, and brings back those sums and the branches that are to be added. Rounds end as `_goes_on` says.
    """
    spark = trees.sparkSession
    own = settled(trees.select("ds", "branch", "parent", "birth", "death"), "trees")
    n = own.select("ds").distinct().count()
    if not n:
        return spark.createDataFrame([], BRANCHES), 0.0
    sums = distance_matrix(own, o).groupBy("i").agg(F.sum(F.col("dist") * F.col("dist")).alias("s"))
    start = sums.orderBy("s", "i").first()["i"]
    centre = preprocessed(Tree.of(own.where(F.col("ds") == start).toPandas()), o)
    best, least, energies = centre, np.inf, []
    while True:
        shared = spark.sparkContext.broadcast(centre)

        def match(pdf: pd.DataFrame) -> pd.DataFrame:
            cost, matched, fresh = _contribution(shared.value, preprocessed(Tree.of(pdf), o), o)
            ds = int(pdf["ds"].iloc[0])
            rows = [(ds, 0, 0, False, 0, cost, 0.0)] + [(ds, 1, x, True, 0, b, d) for x, b, d in matched]
            rows += [(ds, 2, k, on, p, b, d) for k, (on, p, b, d) in enumerate(fresh)]
            return pd.DataFrame(rows, columns=["ds", "kind", "x", "matched", "parent", "b", "d"])

        parts = settled(own.groupBy("ds").applyInPandas(match, "ds long, kind int, x long, matched boolean, parent long, b double, d double"), "matched")
        energy = parts.where("kind = 0").agg(F.sum("b")).first()[0] / n
        energies.append(energy)
        if energy < least:
            best, least = centre, energy
        if not _goes_on(energies, rounds):
            break
        sums = parts.where("kind = 1").groupBy("x").agg(F.sum("b").alias("b"), F.sum("d").alias("d"), F.count("*").alias("k")).toPandas()
        total, mass = np.zeros((len(centre.birth), 2)), np.zeros(len(centre.birth))
        total[sums["x"]] = sums[["b", "d"]].to_numpy() / n
        mass[sums["x"]] = sums["k"].to_numpy() / n
        added = parts.where("kind = 2").orderBy("ds", "x").toPandas()
        fresh = [[(1 / n, bool(on), int(p), b, d) for on, p, b, d in g[["matched", "parent", "b", "d"]].itertuples(index=False)] for _, g in added.groupby("ds")]
        centre = _moved(centre, total, mass, fresh, o)
    return spark.createDataFrame(best.rows(0), BRANCHES), float(least)


def barycenter_of(trees: list[Tree], o: Options = Options(), weights: np.ndarray | None = None, rounds: int | None = None) -> tuple[Tree, float]:
    """(barycenter, energy). Starts at the tree with the least sum of distances; rounds end as `_goes_on` says."""
    if o.normalized is None:
        raise ValueError("normalized is true or false")
    members = [preprocessed(t, o) for t in trees]
    w = np.full(len(members), 1 / len(members)) if weights is None else np.asarray(weights, float)
    sums = [sum(wj * tree_matching(a, b, o)[1] for b, wj in zip(members, w)) for a in members]
    centre = members[int(np.argmin(sums))]
    best, least, energies = centre, np.inf, []
    while True:
        new, energy = _mean_step(centre, members, w, o)
        energies.append(energy)
        if energy < least:
            best, least = centre, energy
        if not _goes_on(energies, rounds):
            break
        centre = new
    return best, float(least)


def geodesic(a: Tree, b: Tree, alpha: float, o: Options = Options()) -> Tree:
    """The tree at 1 - alpha of the way from a to b: the barycenter of both by these weights."""
    a, b = preprocessed(a, o), preprocessed(b, o)
    return _mean_step(a, [a, b], np.array([alpha, 1 - alpha]), o)[0]


def barycenters(trees: DataFrame, group: str | None = None, o: Options = Options()) -> DataFrame:
    """(group, branch, parent, birth, death, energy): one barycenter for each group, in a task of its own."""
    g = group or "cluster"
    own = trees if group else trees.withColumn(g, F.lit(0).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        centre, energy = barycenter_of([Tree.of(x) for _, x in pdf.groupby("ds")], o)
        out = centre.rows(0)[["branch", "parent", "birth", "death"]]
        out.insert(0, g, int(pdf[g].iloc[0]))
        out["energy"] = energy
        return out

    return own.select(g, "ds", "branch", "parent", "birth", "death").groupBy(g).applyInPandas(run, f"{g} long, branch long, parent long, birth double, death double, energy double")


def cluster(trees: DataFrame, k: int, o: Options = Options(), rounds: int | None = None, second: DataFrame | None = None, mix: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(assignment (ds, ClusterAssignment, distance), centroids): k-means of trees.

    With a second set of trees (e.g. split besides join) a squared distance is mix of the first and 1 - mix of the second. The first centroid is the
    tree with the most branches, the least ds on ties; each further one is the farthest tree, which also takes an empty cluster's place.
    Rounds go on until the sum of distances falls no more; if `rounds` are given and are over before, a warning says so.
    """
    spark = trees.sparkSession
    own = settled(trees.select("ds", F.lit(0).alias("side"), "branch", "parent", "birth", "death"), "trees")
    if second is not None:
        own = settled(own.unionByName(second.select("ds", F.lit(1).alias("side"), "branch", "parent", "birth", "death")), "trees")
    share = (mix, 1 - mix) if second is not None else (1.0,)

    def sides(pdf: pd.DataFrame) -> list[Tree]:
        return [preprocessed(Tree.of(pdf[pdf["side"] == s]), o) for s in range(len(share))]

    def fetch(ds: int) -> list[Tree]:
        return sides(own.where(F.col("ds") == ds).toPandas())

    def assigned(centres) -> DataFrame:
        shared = spark.sparkContext.broadcast(centres)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            t = sides(pdf)
            d = [sum(w * tree_matching(x, c, o)[1] for w, x, c in zip(share, t, cs)) for cs in shared.value]
            return pd.DataFrame([(int(pdf["ds"].iloc[0]), int(np.argmin(d)), float(min(d)))], columns=["ds", "ClusterAssignment", "distance"])

        return settled(own.groupBy("ds").applyInPandas(run, "ds long, ClusterAssignment long, distance double"), "assigned")

    largest = own.groupBy("ds").count().orderBy(F.desc("count"), "ds").first()
    if largest is None:
        return spark.createDataFrame([], "ds long, ClusterAssignment long, distance double"), spark.createDataFrame([], "cluster long, side int, branch long, parent long, birth double, death double")
    centres = [fetch(largest["ds"])]
    now = assigned(centres)
    while len(centres) < k:
        far = now.orderBy(F.desc("distance"), "ds").first()
        if far["distance"] <= 0:
            break
        centres.append(fetch(far["ds"]))
        now = assigned(centres)
    last, done = now.agg(F.sum("distance")).first()[0], 0
    while True:
        if rounds is not None and done >= rounds:
            warnings.warn(f"the sum of distances still falls after {rounds} rounds: it is {last}", stacklevel=2)
            break
        done += 1
        labelled = own.join(now.select("ds", F.col("ClusterAssignment").alias("cluster")), "ds")

        def update(pdf: pd.DataFrame) -> pd.DataFrame:
            s = int(pdf["side"].iloc[0])
            centre, _ = barycenter_of([Tree.of(x) for _, x in pdf.groupby("ds")], o)
            out = centre.rows(0)[["branch", "parent", "birth", "death"]]
            out.insert(0, "side", s)
            out.insert(0, "cluster", int(pdf["cluster"].iloc[0]))
            return out

        rows = labelled.groupBy("cluster", "side").applyInPandas(update, "cluster long, side int, branch long, parent long, birth double, death double").toPandas()
        new = []
        for i in range(len(centres)):
            part = rows[rows["cluster"] == i]
            new.append([Tree.of(part[part["side"] == s]) for s in range(len(share))] if len(part) else fetch(now.orderBy(F.desc("distance"), "ds").first()["ds"]))
        then = assigned(new)
        inertia = then.agg(F.sum("distance")).first()[0]
        if inertia >= last - 0.01 * abs(last) or then.join(now, ["ds", "ClusterAssignment"]).count() == now.count():
            if inertia < last:
                centres, now = new, then
            break
        centres, now, last = new, then, inertia
    rows = pd.concat([t.rows(0)[["branch", "parent", "birth", "death"]].assign(cluster=i, side=s) for i, c in enumerate(centres) for s, t in enumerate(c)])
    return now, spark.createDataFrame(rows[["cluster", "side", "branch", "parent", "birth", "death"]], "cluster long, side int, branch long, parent long, birth double, death double")


def temporal_subsampling(trees: DataFrame, percent: float, o: Options = Options()) -> tuple[list[int], DataFrame]:
    """(ds removed in turn, kept trees): greedily the tree goes that its kept neighbours' geodesic restores best, with all between them that went before.

    The costs of a round's candidates are worked out in parallel; the first and last tree stay.
    """
    spark = trees.sparkSession
    ids = sorted(r[0] for r in trees.select("ds").distinct().collect())
    shared = spark.sparkContext.broadcast({int(d): preprocessed(Tree.of(g), o) for d, g in trees.toPandas().groupby("ds")})
    kept, removed = list(ids), []
    for _ in range(max(0, min(int(len(ids) * percent / 100), len(ids) - 3))):
        tasks = [(kept[i - 1], kept[i], kept[i + 1]) for i in range(1, len(kept) - 1)]
        gone = list(removed)

        def cost(batches):
            all_ = shared.value
            for pdf in batches:
                out = []
                for a, c, b in pdf.itertuples(index=False):
                    total = 0.0
                    for x in sorted([c] + [g for g in gone if a < g < b]):
                        t = geodesic(all_[a], all_[b], (b - x) / (b - a), o)
                        total += tree_matching(t, all_[x], o)[1]
                    out.append((c, total))
                yield pd.DataFrame(out, columns=["c", "cost"])

        best = spark.createDataFrame(tasks, "a long, c long, b long").repartition(len(tasks)).mapInPandas(cost, "c long, cost double").orderBy("cost", "c").first()
        kept.remove(best["c"])
        removed.append(int(best["c"]))
    return removed, trees.where(F.col("ds").isin(kept))
