"""Merge and contour trees of fields of any size: no task holds a field, only its critical vertices where kernel_rows allows, and those by joins beyond it.

Vertices are named by their rank in the order of all (ds, value, offset), so that comparing names compares vertices; a split tree is a join tree of ranks counted from
above. Basins of steepest descent, the lowest saddle between each two, and contraction by joins give every minimum the saddle where it ends and the elder branch
there. A branch's saddles in order are its arcs. Where a vertex belongs is found by jumps of doubled length, from its minimum up the tree as far as the vertex is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import cleaned, dense_index
from ..functions.storage import settled
from . import graph, kernels


def numbered(vertices: DataFrame, neighbours: DataFrame, value: str = "value", offset: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranks (ds, vid, value, r), edges (lo, hi)) of vertices and adjacency (ds, a, b) in both directions."""
    own = vertices.select("ds", "vid", cleaned(value).alias("value"), F.col(offset or "vid").cast("long").alias("offset"))
    ranks = settled(dense_index(own, ["ds", "value", "offset"], "r").select("ds", "vid", "value", F.col("r").cast("long").alias("r")), "ranks")
    of = lambda side: ranks.select("ds", F.col("vid").alias(side), F.col("r").alias(f"r{side}"))
    met = neighbours.select("ds", "a", "b").join(of("a"), ["ds", "a"]).join(of("b"), ["ds", "b"]).where("rb < ra")
    return ranks, settled(met.select(F.col("rb").alias("lo"), F.col("ra").alias("hi")), "edges")


def climbed(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """starts with `cur` moved along jumps (v, to, w) as long as each w on the way is `bound` at most.

    Jumps are doubled, w being the greatest on the way, and tried from the longest down: rounds are twice the logarithm of the longest way.
    """
    levels = [settled(jumps.select("v", "to", "w"), "jumps")]
    while True:
        j = levels[-1]
        far = j.join(j.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2")), "to")
        far = settled(far.select("v", F.col("to2").alias("to"), F.greatest("w", "w2").alias("w")), "jumps")
        if far.isEmpty():
            break
        levels.append(far)
    columns = [c for c in starts.columns if c != "cur"]
    for k, j in enumerate(reversed(levels)):
        met = starts.join(j.select(F.col("v").alias("_v"), "to", "w"), F.col("cur") == F.col("_v"), "left")
        starts = met.select(*columns, F.when(F.col("w") <= F.col("bound"), F.col("to")).otherwise(F.col("cur")).alias("cur"))
        if k % 4 == 3:
            starts = settled(starts, "climb")
    return starts


def _swept(pdf: pd.DataFrame) -> pd.DataFrame:
    """(c, into, s): each younger basin, the elder that it meets, and where; edges (c, d, s) between basins in the order of s."""
    ids = np.unique(pdf[["c", "d"]].to_numpy())
    c, d, s = np.searchsorted(ids, pdf["c"]), np.searchsorted(ids, pdf["d"]), pdf["s"].to_numpy()
    uf, out = kernels.UnionFind(len(ids)), []
    for e in np.argsort(s, kind="stable").tolist():
        x, y = uf.find(int(c[e])), uf.find(int(d[e]))
        if x != y:
            old, young = min(x, y), max(x, y)
            out.append((ids[young], ids[old], s[e]))
            uf.union(old, young)
    return pd.DataFrame(out, columns=["c", "into", "s"]).astype("int64")


class Tree:
    """The join tree of ranks: `parents` (v, to) from each node but the last, `saddles` (v), `basins` (v, root) of all vertices."""

    def __init__(self, ranks: DataFrame, edges: DataFrame, kernel_rows: int):
        falls = edges.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("nxt"))
        self.basins = settled(graph.roots(ranks.select(F.col("r").alias("v")).join(falls, "v", "left")).select("v", "root"), "basins")
        of = lambda side: self.basins.select(F.col("v").alias(side), F.col("root").alias(f"r{side}"))
        across = edges.join(of("lo"), "lo").join(of("hi"), "hi").where("rlo <> rhi")
        across = settled(across.groupBy(F.least("rlo", "rhi").alias("c"), F.greatest("rlo", "rhi").alias("d")).agg(F.min("hi").alias("s")), "across")
        ended = []
        while across.limit(kernel_rows + 1).count() > kernel_rows:
            # a basin whose lowest saddle leads to an elder ends there; edges then lead to where its way of ends goes
            both = across.unionByName(across.select(F.col("d").alias("c"), F.col("c").alias("d"), "s"))
            low = both.groupBy("c").agg(F.min(F.struct("s", "d")).alias("m"))
            dead = settled(low.where("m.d < c").select("c", F.col("m.d").alias("into"), F.col("m.s").alias("s")), "ended")
            ended.append(dead)
            way = dead.select(F.col("c").alias("v"), F.col("into").alias("nxt"))
            ends = way.select(F.col("nxt").alias("v")).distinct().join(way.select("v"), "v", "left_anti").withColumn("nxt", F.lit(None).cast("long"))
            to = settled(graph.roots(way.unionByName(ends)).select("v", "root"), "to")
            new = lambda side: to.select(F.col("v").alias(side), F.col("root").alias(f"t{side}"))  # noqa: B023, E731
            moved = across.join(new("c"), "c", "left").join(new("d"), "d", "left").select(F.coalesce("tc", "c").alias("c"), F.coalesce("td", "d").alias("d"), "s").where("c <> d")
            across = settled(moved.groupBy(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).agg(F.min("s").alias("s")), "across")
        field = ranks.select(F.col("r").alias("c"), "ds")
        rest = settled(across.join(field, "c").groupBy("ds").applyInPandas(_swept, "c long, into long, s long"), "ended")
        merges = rest
        for part in ended:
            merges = merges.unionByName(part)
        merges = settled(merges, "merges") if ended else rest
        if ended:
            # what ended by joins may have met a basin that had ended before: the elder is up its way
            far = climbed(merges.select("c", "s", F.col("s").alias("bound"), F.col("into").alias("cur")), merges.select(F.col("c").alias("v"), F.col("into").alias("to"), F.col("s").alias("w")))
            elders = settled(far.select("c", F.col("cur").alias("into"), "s"), "elders")
        else:
            elders = merges
        minima = self.basins.where("v = root").select("v")
        last = graph.roots(minima.join(merges.select(F.col("c").alias("v"), F.col("into").alias("nxt")), "v", "left")).select(F.col("v").alias("root"), F.col("root").alias("last"))
        tops = self.basins.join(last, "root").groupBy("last").agg(F.max("v").alias("node"))
        # of every branch: its minimum, the saddles of those that end in it, and its own saddle or the last vertex
        on = minima.select(F.col("v").alias("b"), F.col("v").alias("node")).unionByName(elders.select(F.col("into").alias("b"), F.col("s").alias("node")))
        on = on.unionByName(elders.select(F.col("c").alias("b"), F.col("s").alias("node"))).unionByName(tops.select(F.col("last").alias("b"), "node")).distinct()
        arcs = on.select(F.col("node").alias("v"), F.lead("node").over(Window.partitionBy("b").orderBy("node")).alias("to"))
        self.parents = settled(arcs.where("to is not null"), "parents")
        self.saddles = settled(elders.select(F.col("s").alias("v")).distinct(), "saddles")
        self.minima = minima

    def nodes(self) -> DataFrame:
        """(v): minima, saddles and last vertices."""
        return self.minima.unionByName(self.saddles).unionByName(self.parents.select(F.col("to").alias("v"))).distinct()

    def owners(self, of: DataFrame, parents: DataFrame | None = None) -> DataFrame:
        """(v, owner): the node that each vertex's arc begins at; saddles own themselves, a last vertex that isn't one belongs to the arc that it ends."""
        parents = self.parents.join(self.saddles.select(F.col("v").alias("to")), "to", "left_semi") if parents is None else parents
        starts = of.select("v").join(self.basins, "v").select("v", F.col("v").alias("bound"), F.col("root").alias("cur"))
        return climbed(starts, parents.select("v", "to", F.col("to").alias("w"))).select("v", F.col("cur").alias("owner"))

    def augmented(self, nodes: DataFrame) -> DataFrame:
        """(v, to): parents when further nodes (v) stand on the arcs that pass them."""
        more = nodes.join(self.nodes(), "v", "left_anti")
        on = self.owners(more).select(F.col("owner").alias("b"), "v").unionByName(self.parents.select(F.col("v").alias("b"), F.explode(F.array("v", "to")).alias("v"))).distinct()
        arcs = on.select("v", F.lead("v").over(Window.partitionBy("b").orderBy("v")).alias("to"))
        return settled(arcs.where("to is not null"), "augmented")


def _turned(edges: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    n = ranks.count()
    return ranks.withColumn("r", F.lit(n - 1) - F.col("r")), edges.select((F.lit(n - 1) - F.col("hi")).alias("lo"), (F.lit(n - 1) - F.col("lo")).alias("hi")), n


def _described(ranks: DataFrame, arcs: DataFrame, owners: DataFrame | None, by: str) -> dict[str, DataFrame]:
    """Nodes, arcs and segmentation by vid, of arcs (SegmentationId, lo, hi) between ranks and owners (v, SegmentationId)."""
    at = lambda c, *more: ranks.select(F.col("r").alias(c), F.col("vid").alias(f"{c}_vid"), *(F.col(x).alias(f"{c}_{x}") for x in more))
    sizes = owners.groupBy("SegmentationId").agg(F.count("*").alias("RegionSize"))
    met = arcs.join(at("lo", "ds", "value"), "lo").join(at("hi", "value"), "hi").join(sizes, "SegmentationId", "left")
    own = met.select(F.col("lo_ds").alias("ds"), "SegmentationId", F.col("lo_vid").alias("downNodeId"), F.col("hi_vid").alias("upNodeId"), F.coalesce("RegionSize", F.lit(0)).cast("long").alias("RegionSize"), (F.col("hi_value") - F.col("lo_value")).alias("RegionSpan"))
    parts = owners.join(at("v", "ds"), "v").select(F.col("v_ds").alias("ds"), F.col("v_vid").alias("vid"), "SegmentationId")
    if by == "node":  # arcs are named by the vertex that they begin at
        name = ranks.select(F.col("r").alias("SegmentationId"), F.col("vid").alias("_name"))
        own, parts = (t.join(name, "SegmentationId").drop("SegmentationId").withColumnRenamed("_name", "SegmentationId") for t in (own, parts))
    ends = own.select("ds", F.col("downNodeId").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(own.select("ds", F.col("upNodeId").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    degrees = ends.groupBy("ds", "v").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    kind = F.when(F.col("down") == 0, kernels.MINIMUM).when(F.col("up") == 0, kernels.MAXIMUM).when((F.col("down") > 1) & (F.col("up") <= 1), kernels.SADDLE1).when((F.col("up") > 1) & (F.col("down") <= 1), kernels.SADDLE2).when(F.col("down") > 1, kernels.DEGENERATE).otherwise(kernels.REGULAR)
    nodes = degrees.join(ranks.select("ds", F.col("vid").alias("v"), "value"), ["ds", "v"]).select("ds", F.col("v").alias("NodeId"), F.col("v").alias("VertexId"), kind.cast("int").alias("CriticalType"), F.col("value").alias("Scalar"))
    order = ["ds", "SegmentationId", "downNodeId", "upNodeId", "RegionSize", "RegionSpan"]
    return {"nodes": nodes, "arcs": own.select(*order), "segmentation": parts.select("ds", "vid", "SegmentationId")}


def merge_tree(vertices: DataFrame, neighbours: DataFrame, kind: str = "join", value: str = "value", offset: str | None = None, kernel_rows: int = 1_000_000) -> dict[str, DataFrame]:
    """nodes, arcs and segmentation of each ds's join, split or contour tree, as `topology.merge_tree` gives them, for fields of any size.

    neighbours: (ds, a, b) in both directions. What a task holds are basins' edges of a ds, once contraction by joins has left kernel_rows of them in all, and for a
    contour tree its critical vertices. Arcs of join and split trees are named by the vertex that they begin at; those of a contour tree are numbered in each ds, and its
    critical vertices belong to their first arc up, a maximum to its first arc down. A contour tree is that of a simply connected domain.
    """
    ranks, edges = numbered(vertices, neighbours, value, offset)
    if kind == "join":
        tree = Tree(ranks, edges, kernel_rows)
        owners = settled(tree.owners(tree.basins).select("v", F.col("owner").alias("SegmentationId")), "owners")
        return _described(ranks, tree.parents.select(F.col("v").alias("SegmentationId"), F.col("v").alias("lo"), F.col("to").alias("hi")), owners, "node")
    turned, down, n = _turned(edges, ranks)
    back = lambda c: F.lit(n - 1) - F.col(c)
    split = Tree(turned, down, kernel_rows)
    if kind == "split":
        owners = settled(split.owners(split.basins).select(back("v").alias("v"), back("owner").alias("SegmentationId")), "owners")
        return _described(ranks, split.parents.select(back("v").alias("SegmentationId"), back("to").alias("lo"), back("v").alias("hi")), owners, "node")
    if kind != "contour":
        raise ValueError(kind)
    return _contour(ranks, Tree(ranks, edges, kernel_rows), split, n)


def combined(jp: np.ndarray, sp: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(arcs (lower, upper), of_j, of_s): the contour tree of nodes 0 to n - 1 in order, from the parents of both trees over all of them (-1: none).

    Leaves are taken one by one, a lower one with its arc up the join tree, an upper one with its arc down the split tree. of_j[v] is the arc that took the join tree's
    edge up from v, so of_s for the split tree's; n if none did. Arcs are numbered as they are taken.
    """
    n = len(jp)
    jp, sp = jp.tolist(), sp.tolist()
    jc, sc = [set() for _ in range(n)], [set() for _ in range(n)]
    for v in range(n):
        if jp[v] >= 0:
            jc[jp[v]].add(v)
        if sp[v] >= 0:
            sc[sp[v]].add(v)
    trees = ((jp, jc, [[v] for v in range(n)], np.full(n, n, np.int64)), (sp, sc, [[v] for v in range(n)], np.full(n, n, np.int64)))
    arcs, gone = [], [False] * n
    queue = [v for v in range(n) if len(jc[v]) + len(sc[v]) == 1]
    while queue:
        v = queue.pop()
        if gone[v] or len(jc[v]) + len(sc[v]) != 1:
            continue
        parent, _, path, taken = trees[0] if not jc[v] else trees[1]
        w = parent[v]
        if w < 0:
            continue
        waiting = [path[v]]
        while waiting:  # paths are lists of lists
            for x in waiting.pop():
                if isinstance(x, list):
                    waiting.append(x)
                else:
                    taken[x] = len(arcs)
        arcs.append((min(v, w), max(v, w)))
        gone[v] = True
        for parent, children, path, _ in trees:
            p = parent[v]
            for c in children[v]:
                parent[c] = p
                path[c] = [path[c], path[v]]
                if p >= 0:
                    children[p].add(c)
            if p >= 0:
                children[p].discard(v)
        if len(jc[w]) + len(sc[w]) == 1:
            queue.append(w)
    return arcs, trees[0][3], trees[1][3]


def _contour(ranks: DataFrame, join: Tree, split: Tree, n: int) -> dict[str, DataFrame]:
    back = lambda c: F.lit(n - 1) - F.col(c)
    nodes = settled(join.nodes().unionByName(split.nodes().select(back("v").alias("v"))).distinct(), "nodes")
    up = join.augmented(nodes)
    down = split.augmented(nodes.select(back("v").alias("v")))
    both = nodes.join(up.select("v", F.col("to").alias("jp")), "v", "left").join(down.select(back("v").alias("v"), back("to").alias("sp")), "v", "left").join(ranks.select(F.col("r").alias("v"), "ds"), "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        ids = pdf["v"].to_numpy()
        at = lambda c: np.where(pdf[c].isna(), -1, np.searchsorted(ids, pdf[c].fillna(-1).to_numpy(np.int64)))
        arcs, of_j, of_s = combined(at("jp"), at("sp"))
        none = np.full(len(ids), -1, np.int64)
        lo, hi = (np.array([a[k] for a in arcs], np.int64) for k in (0, 1))
        rows = [pd.DataFrame({"what": "arc", "k": np.arange(len(arcs)), "lo": ids[lo], "hi": ids[hi]})]
        rows += [pd.DataFrame({"what": what, "k": of, "lo": ids, "hi": none}) for what, of in (("j", of_j), ("s", of_s))]
        out = pd.concat(rows)
        out["ds"] = int(pdf["ds"].iloc[0])
        return out[["ds", "what", "k", "lo", "hi"]]

    found = settled(both.groupBy("ds").applyInPandas(run, "ds long, what string, k long, lo long, hi long"), "contour")
    arcs = found.where("what = 'arc'").select("ds", "k", "lo", "hi")
    # arcs of one ds are numbered as they are taken: a name over all is ds's first rank and that
    first = ranks.groupBy("ds").agg(F.min("r").alias("first"))
    arcs = settled(arcs.join(first, "ds").select((F.col("first") + F.col("k")).alias("SegmentationId"), "lo", "hi"), "arcs")
    critical = arcs.select(F.col("lo").alias("v"), F.struct(F.lit(0).alias("o"), F.col("SegmentationId").alias("k")).alias("s")).unionByName(arcs.select(F.col("hi").alias("v"), F.struct(F.lit(1).alias("o"), F.col("SegmentationId").alias("k")).alias("s")))
    critical = critical.groupBy("v").agg(F.min("s").alias("s")).select("v", F.col("s.k").alias("SegmentationId"))
    # another vertex lies in the arc that first took one of its two trees' edges
    regular = join.basins.join(nodes, "v", "left_anti").select("v")
    of_j = join.owners(regular, up).join(found.where("what = 'j'").select(F.col("lo").alias("owner"), F.col("k").alias("kj")), "owner", "left").select("v", "kj")
    of_s = split.owners(regular.select(back("v").alias("v")), down).select(back("v").alias("v"), back("owner").alias("owner")).join(found.where("what = 's'").select(F.col("lo").alias("owner"), F.col("k").alias("ks")), "owner", "left").select("v", "ks")
    met = of_j.join(of_s, "v").join(ranks.select(F.col("r").alias("v"), "ds"), "v").join(first, "ds").select("v", (F.col("first") + F.least("kj", "ks")).alias("SegmentationId"))
    owners = settled(met.unionByName(critical), "owners")
    out = _described(ranks, arcs, owners, "number")
    named = lambda t: t.join(first, "ds").withColumn("SegmentationId", F.col("SegmentationId") - F.col("first")).drop("first")
    return out | {k: named(out[k]) for k in ("arcs", "segmentation")}
