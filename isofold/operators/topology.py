"""Topology of scalar fields: vertices are (ds, vid, value[, offset]), cells (ds, cid, verts).

What is local to a vertex is relational or grouped by vertex, so one large field spreads over all tasks. Sweeps (trees, pairs, simplification)
are a kernel for each ds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import cleaned
from ..functions.storage import settled
from . import graph, incidence, kernels, trees


def ordered(vertices: DataFrame, value: str = "value", offset: str | None = None, *more: str) -> DataFrame:
    """(ds, vid, value, key, more): key compares as (value, offset) does, offset being vid by default."""
    o = F.col(offset or "vid").cast("long")
    return vertices.select("ds", "vid", cleaned(value).alias("value"), F.struct(cleaned(value).alias("v"), o.alias("o")).alias("key"), *more)


def _end(keyed: DataFrame, side: str, n: int, *more: str) -> DataFrame:
    """(ds, a, ka, more) of vertices as an edge's end, more with the end's number. There are as many as vertices and Spark takes sizes from files, which are several times smaller: it is told to merge, not to broadcast."""
    return keyed.select("ds", F.col("vid").alias(side), F.col("key").alias(f"k{side}"), *(F.col(c).alias(f"{c}{n}") for c in more)).hint("merge")


def _with_keys(pairs: DataFrame, keyed: DataFrame, *more: str) -> DataFrame:
    """(ds, a, b, ka, kb) for adjacency (ds, a, b), and what more the vertices have as c1 and c2."""
    return pairs.join(_end(keyed, "a", 1, *more), ["ds", "a"]).join(_end(keyed, "b", 2, *more), ["ds", "b"])


def _around(vertices: DataFrame, neighbours: DataFrame, value: str, offset: str | None) -> DataFrame:
    """(ds, a, ka, lo, hi): of each vertex with neighbours, the lowest and the highest of them as (kb, b)."""
    keyed = ordered(vertices, value, offset)
    near = F.struct("kb", "b")
    ends = neighbours.join(_end(keyed, "b", 2), ["ds", "b"]).groupBy("ds", "a").agg(F.min(near).alias("lo"), F.max(near).alias("hi"))
    return ends.join(_end(keyed, "a", 1), ["ds", "a"])


def extrema(vertices: DataFrame, neighbours: DataFrame, value: str = "value", offset: str | None = None) -> DataFrame:
    """(ds, vid, value, CriticalType) of minima and maxima: an aggregate over neighbours, with no Python."""
    kind = F.when(F.col("ka") < F.col("lo.kb"), kernels.MINIMUM).when(F.col("ka") > F.col("hi.kb"), kernels.MAXIMUM)
    return _around(vertices, neighbours, value, offset).select("ds", F.col("a").alias("vid"), F.col("ka.v").alias("value"), kind.cast("int").alias("CriticalType")).where("CriticalType is not null")


def critical_points(vertices: DataFrame, cells: DataFrame, value: str = "value", offset: str | None = None, with_regular: bool = False) -> DataFrame:
    """(ds, vid, CriticalType, IsOnBoundary) by the components of each vertex's lower and upper link.

    A vertex's star is gathered at the vertex, which bounds a group by the mesh's degree.
    """
    keyed = ordered(vertices, value, offset)
    dim = (cells.agg(F.max(F.size("verts"))).first()[0] or 2) - 1
    corner = cells.select("ds", "cid", "verts", F.explode("verts").alias("v"))
    # of every cell: its vertices with their keys, gathered once
    keys = corner.join(keyed.select("ds", F.col("vid").alias("v"), "key"), ["ds", "v"]).groupBy("ds", "cid").agg(F.collect_list(F.struct(F.col("v").alias("id"), "key")).alias("corners"))
    own = keys.select("ds", F.explode("corners").alias("me"), "corners")
    rest = F.filter("corners", lambda c: c["id"] != F.col("me.id"))
    low = F.transform(F.filter(rest, lambda c: c["key"] < F.col("me.key")), lambda c: c["id"])
    high = F.transform(F.filter(rest, lambda c: c["key"] > F.col("me.key")), lambda c: c["id"])
    stars = own.select("ds", F.col("me.id").alias("vid"), F.col("me.key.v").alias("value"), low.alias("low"), high.alias("high")).groupBy("ds", "vid", "value").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))

    def classify(batches):
        for pdf in batches:
            kinds = []
            for low, high in zip(pdf["low"], pdf["high"]):
                parts = []
                for side in (low, high):
                    members, edges = set(), []
                    for s in side:
                        members.update(int(v) for v in s)
                        edges += [(int(s[0]), int(v)) for v in s[1:]]
                    parts.append(kernels.link_components(members, edges))
                kinds.append(kernels.critical_type(parts[0], parts[1], dim))
            yield pd.DataFrame({"ds": pdf["ds"], "vid": pdf["vid"], "value": pdf["value"], "CriticalType": np.array(kinds, np.int32)})

    kinds = stars.mapInPandas(classify, "ds long, vid long, value double, CriticalType int")
    if not with_regular:
        kinds = kinds.where(F.col("CriticalType") != kernels.REGULAR)
    rim = incidence.boundary(cells, 0).select("ds", F.col("face")[0].alias("vid"), F.lit(1).alias("b"))
    return kinds.join(rim, ["ds", "vid"], "left").select("ds", "vid", "value", "CriticalType", F.coalesce("b", F.lit(0)).cast("tinyint").alias("IsOnBoundary"))


# ---------------------------------------------------------------- kernels for each ds
class Field:
    """One ds as arrays: ids, values, dense order and adjacency."""

    def __init__(self, v: pd.DataFrame, e: pd.DataFrame):
        v = v.sort_values("vid")
        self._fill(*(v[c].to_numpy() for c in ("vid", "value", "offset")), *(e[c].to_numpy() for c in ("a", "b")))

    def _fill(self, ids: np.ndarray, values: np.ndarray, offset: np.ndarray, a: np.ndarray, b: np.ndarray) -> Field:
        self.ids = ids
        self.values = np.nan_to_num(values.astype(float), nan=0.0)
        self.order = kernels.dense_order(self.values, offset)
        self.starts, self.nbrs = kernels.adjacency(len(ids), np.searchsorted(ids, a), np.searchsorted(ids, b))
        return self


#: Small fields go to Python so many vertices at a time: a call for each of very many fields takes longer than their sweeps.
CALL_ROWS = 4096


def _fields_of(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[int, Field, pd.DataFrame, pd.DataFrame]]:
    """(ds, field, its vertices by id, its edges) of all ds in vertices left and edges right."""
    left, right = left.sort_values(["ds", "vid"]), right.sort_values("e_ds", kind="stable")
    ds, first = np.unique(left["ds"].to_numpy(), return_index=True)
    ends = np.append(first[1:], len(left))
    of = right["e_ds"].to_numpy()
    lo, hi = np.searchsorted(of, ds, "left"), np.searchsorted(of, ds, "right")
    cols = [left[c].to_numpy() for c in ("vid", "value", "offset")]
    sides = [right[c].to_numpy() for c in ("a", "b")]
    for d, i, j, k, m in zip(ds.tolist(), first.tolist(), ends.tolist(), lo.tolist(), hi.tolist()):
        yield d, Field.__new__(Field)._fill(*(c[i:j] for c in cols), *(c[k:m] for c in sides)), left.iloc[i:j], right.iloc[k:m]


def _with_fields(v: DataFrame, cells: DataFrame, run: Callable[[int, Field, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rows: int) -> DataFrame:
    """run(ds, field, vertices, edges) for each ds of v (ds, vid, value, offset, ...), which has so many rows, a group of whole fields in a call."""
    groups = max(rows // CALL_ROWS, 1)
    dealt = lambda t, c: t.withColumn(f"{c}_call", F.pmod(F.hash(c), F.lit(groups))).groupBy(f"{c}_call")
    names = [c.split()[0] for c in schema.split(", ")]

    def call(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [run(*f)[names] for f in _fields_of(left, right)]
        parts = [p for p in parts if len(p)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({n: [] for n in names})

    return dealt(v, "ds").cogroup(dealt(_edges_apart(cells), "e_ds")).applyInPandas(call, schema)


def per_field(vertices: DataFrame, cells: DataFrame, kernel: Callable[[int, Field, pd.DataFrame], pd.DataFrame], schema: str, value: str = "value", offset: str | None = None) -> DataFrame:
    """kernel(ds, field, edges) for each ds; its result's columns are the schema's."""
    v = vertices.select("ds", "vid", cleaned(value).alias("value"), F.col(offset or "vid").cast("long").alias("offset"))
    return _with_fields(v, cells, lambda ds, f, _, e: kernel(ds, f, e), schema, vertices.count())


def _edges_apart(cells: DataFrame) -> DataFrame:
    """Edges with a key of another name than the vertices', from which the cells may come."""
    return incidence.edges(cells).select(F.col("ds").alias("e_ds"), "a", "b")


DIAGRAM = "ds long, birth_vid long, death_vid long, pair_type int, birth_type int, death_type int, birth double, death double, persistence double"


def persistence_diagram(vertices: DataFrame, cells: DataFrame, value: str = "value", offset: str | None = None, dim: int | None = None, keep_global_twice: bool = False, kernel_rows: int = 1_000_000) -> DataFrame:
    """A row for each pair: extremum-saddle pairs of both sweeps and the global pair, by default once.

    pair_type 0 is of a minimum, dim - 1 of a maximum. A ds of up to kernel_rows vertices is swept in one task; where one has more, basins and the
    saddles between them are found by joins, and the same pairs come from contracting those.
    """
    d = dim if dim is not None else (cells.agg(F.max(F.size("verts"))).first()[0] or 2) - 1
    if vertices.limit(kernel_rows + 1).count() > kernel_rows and vertices.groupBy("ds").count().agg(F.max("count")).first()[0] > kernel_rows:
        return _diagram_at_large(vertices, cells, d, keep_global_twice, value, offset, kernel_rows)

    def kernel(ds, f, _):
        rows = kernels.diagram(f.order, f.starts, f.nbrs, d)
        if keep_global_twice:
            rows += [(b, e, max(d - 1, 0), x, y) for b, e, t, x, y in rows if (x, y) == (kernels.MINIMUM, kernels.MAXIMUM) and t == 0 and d > 1]
        b, e = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], int)
        return pd.DataFrame({"ds": ds, "birth_vid": f.ids[b], "death_vid": f.ids[e], "pair_type": [r[2] for r in rows], "birth_type": [r[3] for r in rows], "death_type": [r[4] for r in rows], "birth": f.values[b], "death": f.values[e], "persistence": f.values[e] - f.values[b]})

    return per_field(vertices, cells, kernel, DIAGRAM, value, offset)


def saddle_pairs(vertices: DataFrame, neighbours: DataFrame, descending: bool = True, value: str = "value", offset: str | None = None, kernel_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(pairs (ds, extremum, saddle), owners (ds, vid, extremum, last)) of minima, or of maxima if not descending, of fields of any size.

    Every vertex falls to its extremum by steepest descent; of the edges between two basins the lowest, by its upper end, is kept. A basin whose lowest edge
    leads to one with a lower extremum ends there, whatever else happens: each round contracts all such basins. What is left is swept in a task for each ds
    once it has kernel_rows edges or fewer. owners has each vertex's own extremum and the one that its part of the field ends with.
    """
    sense = 1 if descending else -1
    keyed = ordered(vertices, value, offset).select("ds", "vid", F.struct((sense * F.col("key.v")).alias("v"), (sense * F.col("key.o")).alias("o")).alias("key"))
    keyed = settled(keyed, "keys")
    stride = (keyed.agg(F.max("vid")).first()[0] or 0) + 1
    name = lambda ds, vid: F.col(ds) * stride + F.col(vid)
    met = settled(_with_keys(neighbours, keyed).where("kb < ka").select(name("ds", "a").alias("a"), name("ds", "b").alias("b"), "ka", "kb"), "down")
    falls = met.groupBy(F.col("a").alias("v")).agg(F.min(F.struct("kb", "b")).alias("n"))
    nodes = keyed.select(name("ds", "vid").alias("v"), "key")
    own = settled(graph.roots(nodes.select("v").join(falls.select("v", F.col("n.b").alias("nxt")), "v", "left")).select("v", "root"), "basins")
    of = lambda side: own.select(F.col("v").alias(side), F.col("root").alias(f"r{side}"))
    across = met.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("c"), F.greatest("ra", "rb").alias("d"), F.struct("ka", "a").alias("s"))
    across = settled(across.groupBy("c", "d").agg(F.min("s").alias("s")), "across")
    tops = settled(own.where("v = root").select("v").join(nodes, "v"), "tops")
    ended: list[DataFrame] = []
    while True:
        n = across.count()
        if n <= kernel_rows:
            break
        both = across.union(across.select(F.col("d").alias("c"), F.col("c").alias("d"), "s"))
        key = lambda side, out: tops.select(F.col("v").alias(side), F.col("key").alias(out))  # noqa: B023, E731
        low = both.join(key("d", "kd"), "d").groupBy("c").agg(F.min(F.struct("s", "kd", "d")).alias("m")).join(key("c", "kc"), "c")
        dead = settled(low.where(F.col("m.kd") < F.col("kc")).select("c", F.col("m.d").alias("into"), F.col("m.s.a").alias("saddle")), "ended")
        ended.append(dead)
        to = settled(graph.roots(dead.select(F.col("c").alias("v"), F.col("into").alias("nxt")).unionByName(dead.select(F.col("into").alias("v")).distinct().join(dead.select(F.col("c").alias("v")), "v", "left_anti").withColumn("nxt", F.lit(None).cast("long")))).select("v", "root"), "to")
        ends = lambda side: to.select(F.col("v").alias(side), F.col("root").alias(f"t{side}"))  # noqa: B023, E731
        moved = across.join(ends("c"), "c", "left").join(ends("d"), "d", "left").select(F.coalesce("tc", "c").alias("c"), F.coalesce("td", "d").alias("d"), "s").where("c <> d")
        across = settled(moved.groupBy(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).agg(F.min("s").alias("s")), "across")

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf[["c", "d"]].to_numpy())
        c, d = np.searchsorted(ids, pdf["c"]), np.searchsorted(ids, pdf["d"])
        rank = np.empty(len(ids), np.int64)
        by_id = {**dict(zip(pdf["c"], zip(pdf["cv"], pdf["co"]))), **dict(zip(pdf["d"], zip(pdf["dv"], pdf["do"])))}
        rank[sorted(range(len(ids)), key=lambda i: by_id[ids[i]])] = np.arange(len(ids))
        uf, out = kernels.UnionFind(len(ids)), []
        for e in np.lexsort((pdf["so"], pdf["sv"])).tolist():
            x, y = uf.find(int(c[e])), uf.find(int(d[e]))
            if x != y:
                old, young = (x, y) if rank[x] < rank[y] else (y, x)
                out.append((ids[young], ids[old], pdf["sa"].iloc[e]))
                uf.union(old, young)
        return pd.DataFrame(out, columns=["c", "into", "saddle"])

    flat = across.join(tops.select(F.col("v").alias("c"), F.col("key").alias("kc")), "c").join(tops.select(F.col("v").alias("d"), F.col("key").alias("kd")), "d")
    flat = flat.select(F.expr(f"c div {stride}").alias("ds"), "c", "d", F.col("kc.v").alias("cv"), F.col("kc.o").alias("co"), F.col("kd.v").alias("dv"), F.col("kd.o").alias("do"), F.col("s.ka.v").alias("sv"), F.col("s.ka.o").alias("so"), F.col("s.a").alias("sa"))
    rest = settled(flat.groupBy("ds").applyInPandas(sweep, "c long, into long, saddle long"), "ended")
    for part in ended:
        rest = rest.unionByName(part)
    pointers = tops.select("v").join(rest.select(F.col("c").alias("v"), F.col("into").alias("nxt")), "v", "left")
    last = settled(graph.roots(pointers).select(F.col("v").alias("root"), F.col("root").alias("last")), "last")
    back = lambda c: F.expr(f"pmod({c}, {stride})")
    pairs = rest.select(F.expr(f"(c - pmod(c, {stride})) div {stride}").alias("ds"), back("c").alias("extremum"), back("saddle").alias("saddle"))
    owners = own.join(last, "root").select(F.expr(f"(v - pmod(v, {stride})) div {stride}").alias("ds"), back("v").alias("vid"), back("root").alias("extremum"), back("last").alias("last"))
    return pairs, owners


def _diagram_at_large(vertices: DataFrame, cells: DataFrame, d: int, keep_global_twice: bool, value: str, offset: str | None, kernel_rows: int) -> DataFrame:
    near = incidence.neighbours(cells)
    low, below = saddle_pairs(vertices, near, True, value, offset, kernel_rows)
    high, above = saddle_pairs(vertices, near, False, value, offset, kernel_rows)
    last = max(d - 1, 0)
    kind = lambda t, b, e: (F.lit(t).alias("pair_type"), F.lit(b).alias("birth_type"), F.lit(e).alias("death_type"))
    rows = low.select("ds", F.col("extremum").alias("birth_vid"), F.col("saddle").alias("death_vid"), *kind(0, kernels.MINIMUM, kernels.SADDLE1 if d > 1 else kernels.MAXIMUM))
    rows = rows.unionByName(high.select("ds", F.col("saddle").alias("birth_vid"), F.col("extremum").alias("death_vid"), *kind(last, kernels.SADDLE2 if d > 2 else kernels.SADDLE1 if d > 1 else kernels.MINIMUM, kernels.MAXIMUM)))
    # the global pair of each part of a field: the maximum that ends it, and the minimum that the maximum's vertex ends with
    tops = above.select("ds", F.col("last").alias("vid")).distinct()
    whole = tops.join(below.select("ds", "vid", F.col("last").alias("birth_vid")), ["ds", "vid"]).select("ds", "birth_vid", F.col("vid").alias("death_vid"), *kind(0, kernels.MINIMUM, kernels.MAXIMUM))
    rows = rows.unionByName(whole)
    if keep_global_twice and d > 1:
        rows = rows.unionByName(whole.withColumn("pair_type", F.lit(last)))
    at = ordered(vertices, value, offset)
    for side in ("birth", "death"):
        rows = rows.join(at.select("ds", F.col("vid").alias(f"{side}_vid"), F.col("value").alias(side)), ["ds", f"{side}_vid"])
    return rows.select("ds", "birth_vid", "death_vid", "pair_type", "birth_type", "death_type", "birth", "death", (F.col("death") - F.col("birth")).alias("persistence"))


def persistence_curve(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """(ds, curve, Persistence, NumberOfPairs): for each value how many pairs of the ds are at least as persistent; curves are all and each pair type."""
    kind = F.explode(F.array(F.lit("all"), F.concat(F.lit("type"), F.col("pair_type").cast("string"))))
    p = pairs.select("ds", kind.alias("curve"), F.greatest(F.col("persistence"), F.lit(10.0**-digits)).alias("Persistence"))
    counts = p.groupBy("ds", "curve", "Persistence").agg(F.count("*").alias("n"))
    w = Window.partitionBy("ds", "curve").orderBy(F.desc("Persistence"))
    return counts.select("ds", "curve", "Persistence", F.sum("n").over(w).alias("NumberOfPairs"))


def merge_tree(vertices: DataFrame, cells: DataFrame, kind: str = "join", value: str = "value", offset: str | None = None, kernel_rows: int = 1_000_000) -> dict[str, DataFrame]:
    """The join, split or contour tree of each ds: nodes, arcs, and for join and split trees the segmentation of vertices.

    Regular vertices belong to the arc that passes them, critical ones to the arc above them. A ds of up to kernel_rows vertices is swept in one task; where one has
    more, `trees.merge_tree` makes them all, with a segmentation of contour trees as well.
    """
    if kind not in ("join", "split", "contour"):
        raise ValueError(kind)
    if vertices.limit(kernel_rows + 1).count() > kernel_rows and vertices.groupBy("ds").count().agg(F.max("count")).first()[0] > kernel_rows:
        return trees.merge_tree(vertices, incidence.neighbours(cells), kind, value, offset, kernel_rows)

    def arcs_of(f):
        if kind == "contour":
            return kernels.contour_tree(len(f.ids), f.order, f.starts, f.nbrs), None
        order = f.order if kind == "join" else len(f.ids) - 1 - f.order
        arcs, _, owner = kernels.merge_tree(order, f.starts, f.nbrs)
        return arcs, owner

    def arcs_kernel(ds, f, _):
        arcs, owner = arcs_of(f)
        size = np.bincount(owner, minlength=len(f.ids)) if owner is not None else np.zeros(len(f.ids), int)
        a, b = np.array([x for x, _ in arcs], int), np.array([y for _, y in arcs], int)
        lo = np.where(f.order[a] < f.order[b], a, b) if len(arcs) else a
        hi = np.where(f.order[a] < f.order[b], b, a) if len(arcs) else b
        return pd.DataFrame({"ds": ds, "SegmentationId": f.ids[a], "downNodeId": f.ids[lo], "upNodeId": f.ids[hi], "RegionSize": size[a], "RegionSpan": f.values[hi] - f.values[lo]})

    def nodes_kernel(ds, f, _):
        arcs, _ = arcs_of(f)
        up, down = {}, {}
        for a, b in arcs:
            lo, hi = (a, b) if f.order[a] < f.order[b] else (b, a)
            up[lo] = up.get(lo, 0) + 1
            down[hi] = down.get(hi, 0) + 1
        ids = sorted(set(up) | set(down))
        kinds = [kernels.MINIMUM if not down.get(i) else kernels.MAXIMUM if not up.get(i) else kernels.SADDLE1 if down[i] > 1 and up.get(i, 0) <= 1 else kernels.SADDLE2 if up[i] > 1 and down[i] <= 1 else kernels.DEGENERATE if down[i] > 1 else kernels.REGULAR for i in ids]
        at = np.array(ids, int)
        return pd.DataFrame({"ds": ds, "NodeId": f.ids[at], "VertexId": f.ids[at], "CriticalType": kinds, "Scalar": f.values[at]})

    def segments_kernel(ds, f, _):
        _, owner = arcs_of(f)
        return pd.DataFrame({"ds": ds, "vid": f.ids, "SegmentationId": f.ids[owner]})

    out = {
        "nodes": per_field(vertices, cells, nodes_kernel, "ds long, NodeId long, VertexId long, CriticalType int, Scalar double", value, offset),
        "arcs": per_field(vertices, cells, arcs_kernel, "ds long, SegmentationId long, downNodeId long, upNodeId long, RegionSize long, RegionSpan double", value, offset),
    }
    if kind != "contour":
        out["segmentation"] = per_field(vertices, cells, segments_kernel, "ds long, vid long, SegmentationId long", value, offset)
    return out


def reeb_graph(vertices: DataFrame, cells: DataFrame, slabs: int = 64, value: str = "value") -> dict[str, DataFrame]:
    """An approximate Reeb graph of each ds, relational at any size: components of its mesh within equal slabs of its range, joined where they touch.

    nodes (slab, component, n), arcs (from, to) between components of neighbouring slabs.
    """
    v = vertices.select("ds", "vid", cleaned(value).alias("value"))
    span = v.groupBy("ds").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v = v.join(span, "ds")
    v = v.select("ds", "vid", F.coalesce(F.least(F.floor(F.try_divide((F.col("value") - F.col("lo")) * slabs, F.col("hi") - F.col("lo"))), F.lit(slabs - 1)), F.lit(0)).alias("slab"))
    e = incidence.edges(cells)
    met = e.join(v.select("ds", F.col("vid").alias("a"), F.col("slab").alias("sa")), ["ds", "a"]).join(v.select("ds", F.col("vid").alias("b"), F.col("slab").alias("sb")), ["ds", "b"])
    label = graph.components_within(met.where("sa = sb").select("ds", "a", "b"), v.select("ds", F.col("vid").alias("node"))).withColumnRenamed("node", "vid")
    nodes = v.join(label, ["ds", "vid"]).groupBy("ds", "slab", "component").agg(F.count("*").alias("n"))
    la, lb = label.select("ds", F.col("vid").alias("a"), F.col("component").alias("ca")), label.select("ds", F.col("vid").alias("b"), F.col("component").alias("cb"))
    arcs = met.where("sa <> sb").join(la, ["ds", "a"]).join(lb, ["ds", "b"]).select("ds", F.when(F.col("sa") < F.col("sb"), F.col("ca")).otherwise(F.col("cb")).alias("from"), F.when(F.col("sa") < F.col("sb"), F.col("cb")).otherwise(F.col("ca")).alias("to")).distinct()
    return {"nodes": nodes, "arcs": arcs}


def simplified(vertices: DataFrame, cells: DataFrame, keep: DataFrame, value: str = "value", offset: str | None = None) -> DataFrame:
    """(ds, vid, value, offset) in which only the extrema in keep (ds, vid) remain. offset is the vertex's place in the new order."""
    marked = vertices.join(keep.select("ds", "vid", F.lit(1).alias("_keep")), ["ds", "vid"], "left")
    v = marked.select("ds", "vid", cleaned(value).alias("value"), F.col(offset or "vid").cast("long").alias("offset"), F.coalesce("_keep", F.lit(0)).alias("keep"))

    def run(ds: int, f: Field, own: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        wanted = set(np.flatnonzero(own["keep"].to_numpy() > 0).tolist())
        values, order = kernels.simplify(f.values, f.order, f.starts, f.nbrs, wanted)
        return pd.DataFrame({"ds": ds, "vid": f.ids, "value": values, "offset": order})

    return _with_fields(v, cells, run, "ds long, vid long, value double, offset long", vertices.count())


def discrete_gradient(vertices: DataFrame, cells: DataFrame, value: str = "value", offset: str | None = None) -> DataFrame:
    """(ds, dim, cell, paired): simplices with the coface they are paired with, or null for critical ones.

    Each vertex's lower star is gathered at it and settled there: the group is bounded by the mesh's degree.
    """
    keyed = ordered(vertices, value, offset)
    dim = (cells.agg(F.max(F.size("verts"))).first()[0] or 2) - 1
    faces = None
    for d in range(1, dim + 1):
        part = incidence.simplices(cells, d).select("ds", "face")
        faces = part if faces is None else faces.unionByName(part)
    corner = faces.select("ds", "face", F.explode("face").alias("v")).join(keyed.select("ds", F.col("vid").alias("v"), "key"), ["ds", "v"])
    full = corner.groupBy("ds", "face").agg(F.max_by("v", "key").alias("top"), F.transform(F.array_sort(F.collect_list(F.struct("key", "v"))), lambda s: s["v"]).alias("rising"), F.transform(F.array_sort(F.collect_list(F.struct("key", "v"))), lambda s: s["key"]["v"]).alias("values"))
    gathered = full.groupBy("ds", F.col("top").alias("vid")).agg(F.collect_list(F.struct("rising", "values")).alias("star"))
    own = keyed.select("ds", "vid", F.col("key.o").alias("o"), F.col("key.v").alias("kv")).join(gathered, ["ds", "vid"], "left")
    # within a star, ranks of its vertices follow from all its simplices' vertices, which come with their keys
    offsets = keyed.select("ds", F.col("vid").alias("v"), F.col("key.o").alias("o"))
    ring = full.select("ds", F.col("top").alias("vid"), F.explode("rising").alias("v")).distinct().join(offsets, ["ds", "v"]).groupBy("ds", "vid").agg(F.map_from_entries(F.collect_list(F.struct("v", "o"))).alias("offsets"))

    def settle(batches):
        for pdf in batches:
            out = []
            for ds, vid, star, off in zip(pdf["ds"], pdf["vid"], pdf["star"], pdf["offsets"]):
                star = [] if star is None else star
                keys = {}
                for s in star:
                    for v, x in zip(s["rising"], s["values"]):
                        keys[int(v)] = x
                off = dict(off) if off is not None else {}
                rank = {v: i for i, v in enumerate(sorted(keys, key=lambda v: (keys[v], off[v])))} or {int(vid): 0}
                by_dim = [[(int(vid),)]] + [[] for _ in range(3)]
                for s in star:
                    by_dim[len(s["rising"]) - 1].append(tuple(sorted(int(v) for v in s["rising"])))
                pair, critical = kernels.lower_star_gradient(rank, by_dim)
                out += [(ds, len(a) - 1, list(a), list(b)) for a, b in pair.items()] + [(ds, len(c) - 1, list(c), None) for c in critical]
            yield pd.DataFrame(out, columns=["ds", "dim", "cell", "paired"])

    return own.join(ring, ["ds", "vid"], "left").select("ds", "vid", "star", "offsets").mapInPandas(settle, "ds long, dim int, cell array<bigint>, paired array<bigint>")


def steepest(vertices: DataFrame, neighbours: DataFrame, descending: bool = True, value: str = "value", offset: str | None = None) -> DataFrame:
    """(ds, v, nxt): each vertex's lowest (highest) neighbour if that is lower (higher), else null."""
    return _steps(vertices, neighbours, value, offset).select("ds", "v", F.col("down" if descending else "up").alias("nxt"))


def _steps(vertices: DataFrame, neighbours: DataFrame, value: str, offset: str | None) -> DataFrame:
    """(ds, v, down, up): the steps of steepest descent and ascent, null where there is none."""
    down, up = F.when(F.col("lo.kb") < F.col("ka"), F.col("lo.b")), F.when(F.col("hi.kb") > F.col("ka"), F.col("hi.b"))
    return _around(vertices, neighbours, value, offset).select("ds", F.col("a").alias("v"), down.alias("down"), up.alias("up"))


def _global(df: DataFrame, columns: list[str], stride: int) -> DataFrame:
    return df.withColumns({c: F.col("ds") * stride + F.col(c) for c in columns})


def segmentation(vertices: DataFrame, neighbours: DataFrame, value: str = "value", offset: str | None = None) -> DataFrame:
    """(ds, vid, DescendingManifold, AscendingManifold, MorseSmaleManifold) of vertices: where steepest descent and ascent end, by pointer doubling.

    The Morse-Smale id numbers the pairs that occur, in the order of the least vertex with each.
    """
    stride = (vertices.agg(F.max("vid")).first()[0] or 0) + 1
    steps = settled(_global(_steps(vertices, neighbours, value, offset), ["v", "down", "up"], stride).select("v", "down", "up"), "steps")
    ends = lambda way, to: graph.roots(steps.select("v", F.col(way).alias("nxt"))).select("v", F.col("root").alias(to)).hint("merge")
    both = vertices.select("ds", "vid", (F.col("ds") * stride + F.col("vid")).alias("v")).join(ends("down", "lo"), "v", "left").join(ends("up", "hi"), "v", "left")
    both = both.select("ds", "vid", F.coalesce(F.col("lo") % stride, F.col("vid")).alias("AscendingManifold"), F.coalesce(F.col("hi") % stride, F.col("vid")).alias("DescendingManifold"))
    pairs = both.groupBy("ds", "AscendingManifold", "DescendingManifold").agg(F.min("vid").alias("first"))
    ids = pairs.withColumn("MorseSmaleManifold", F.row_number().over(Window.partitionBy("ds").orderBy("first")) - 1).drop("first")
    return both.join(ids.hint("merge"), ["ds", "AscendingManifold", "DescendingManifold"]).select("ds", "vid", "DescendingManifold", "AscendingManifold", "MorseSmaleManifold")


def separatrices(gradient: DataFrame, critical: DataFrame | None = None) -> DataFrame:
    """(ds, saddle, side, step, vid): the two descending paths from each critical edge along vertex-edge pairs down to minima."""
    pairs = gradient.where("dim = 0 and paired is not null").select("ds", F.col("cell")[0].alias("v"), F.when(F.col("paired")[0] == F.col("cell")[0], F.col("paired")[1]).otherwise(F.col("paired")[0]).alias("nxt"))
    saddles = settled(gradient.where("dim = 1 and paired is null").select("ds", F.col("cell").alias("saddle"), F.posexplode("cell").alias("side", "vid")), "saddles")
    stride = (gradient.where("dim = 0").agg(F.max(F.col("cell")[0])).first()[0] or 0) + 1
    key = lambda c: F.col("ds") * stride + F.col(c)
    ways = graph.walked(pairs.select(key("v").alias("v"), key("nxt").alias("nxt")), saddles.select(key("vid").alias("start")).distinct())
    met = saddles.withColumn("start", key("vid")).drop("vid").join(ways, "start")
    return met.select("ds", "saddle", "side", F.col("step").cast("int").alias("step"), F.expr(f"pmod(at, {stride})").alias("vid"))


def integral_lines(vertices: DataFrame, neighbours: DataFrame, seeds: DataFrame, backward: bool = True, value: str = "value", offset: str | None = None) -> DataFrame:
    """(ds, seed, step, vid, DistanceFromSeed): from each distinct seed along the steepest edge, |df| / length, to an extremum.

    All lines are walked at once, by jumps of doubled length; backward goes down. vertices need x, y, z.
    """
    met = _with_keys(neighbours, ordered(vertices, value, offset, "x", "y", "z"), "x", "y", "z")
    length = F.sqrt(F.expr("(x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2)"))
    met = met.where(F.col("kb") < F.col("ka") if backward else F.col("kb") > F.col("ka")).withColumn("w", length)
    slope = F.try_divide(F.abs(F.col("kb.v") - F.col("ka.v")), F.col("w"))
    tie = F.struct((-slope).alias("s"), F.col("kb"), F.col("b"), F.col("w")) if backward else F.struct(slope.alias("s"), F.col("kb"), F.col("b"), F.col("w"))
    best = met.groupBy("ds", F.col("a").alias("v")).agg((F.min(tie) if backward else F.max(tie)).alias("n"))
    stride = (vertices.agg(F.max("vid")).first()[0] or 0) + 1
    key = lambda c: F.col("ds") * stride + F.col(c)
    # a vertex without a step is a pointer's end as well
    steps = vertices.select(key("vid").alias("v")).hint("merge").join(best.select(key("v").alias("v"), (F.col("ds") * stride + F.col("n.b")).alias("nxt"), F.col("n.w").alias("w")), "v", "left")
    ways = graph.walked(settled(steps, "steepest"), seeds.select(key("vid").alias("start")).distinct(), "w")
    back = lambda c: F.expr(f"pmod({c}, {stride})")
    return ways.select(F.expr(f"(start - pmod(start, {stride})) div {stride}").alias("ds"), back("start").alias("seed"), F.col("step").cast("int").alias("step"), back("at").alias("vid"), F.col("length").alias("DistanceFromSeed"))


def manifold_check(cells: DataFrame, dim: int = 0) -> DataFrame:
    """(ds, face, components): the components of each face's link; 1 inside a manifold. A link of single vertices counts its vertices."""
    links = incidence.link(cells, dim)

    def count(batches):
        for pdf in batches:
            n = []
            for link in pdf["links"]:
                members, edges = set(), []
                for s in link:
                    members.update(int(v) for v in s)
                    edges += [(int(s[0]), int(v)) for v in s[1:]]
                n.append(kernels.link_components(members, edges))
            yield pd.DataFrame({"ds": pdf["ds"], "face": pdf["face"], "components": np.array(n, np.int32)})

    return links.mapInPandas(count, "ds long, face array<bigint>, components int")


def mandatory_minima(vertices: DataFrame, cells: DataFrame, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """(ds, vid, lo, hi): mandatory minima of fields known within bounds.

    A minimum of the upper bound, taken lowest first, is mandatory if the component of the lower bound's sublevel set at its value that holds it has
    not been claimed by another; lo is that component's least lower value, hi the minimum's upper value.
    """
    v = vertices.select("ds", "vid", cleaned(lower).alias("value"), cleaned(upper).alias("top"), F.col("vid").alias("offset"))
    e = _edges_apart(cells)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["ds", "vid", "lo", "hi"]
        if not len(left):
            return pd.DataFrame({n: [] for n in names})
        f = Field(left, right)
        top = left.sort_values("vid")["top"].to_numpy(float)
        order = kernels.dense_order(top, f.ids)
        n = len(f.ids)
        minima = sorted((i for i in range(n) if all(order[u] > order[i] for u in f.nbrs[f.starts[i] : f.starts[i + 1]])), key=lambda i: order[i])
        by_low, at = np.argsort(f.order), 0
        uf, claimed, least = kernels.UnionFind(n), set(), f.values.copy()
        inside, out = np.zeros(n, bool), []
        for m in minima:
            while at < n and f.values[by_low[at]] <= top[m]:
                x = int(by_low[at])
                inside[x] = True
                for u in f.nbrs[f.starts[x] : f.starts[x + 1]].tolist():
                    if inside[u]:
                        a, b = uf.find(x), uf.find(u)
                        if a != b:
                            taken = a in claimed or b in claimed
                            r = uf.union(a, b)
                            least[r] = min(least[a], least[b])
                            if taken:
                                claimed.add(r)
                at += 1
            r = uf.find(m)
            if inside[m] and r not in claimed:
                claimed.add(r)
                out.append((int(left["ds"].iloc[0]), f.ids[m], least[r], top[m]))
        return pd.DataFrame(out, columns=names)

    return v.groupBy("ds").cogroup(e.groupBy("e_ds")).applyInPandas(run, "ds long, vid long, lo double, hi double")


def mandatory_critical_points(vertices: DataFrame, cells: DataFrame, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """(ds, kind, vid, lo, hi): mandatory minima and, of the negated bounds, maxima."""
    minima = mandatory_minima(vertices, cells, lower, upper).withColumn("kind", F.lit("minimum"))
    turned = vertices.withColumns({"_lo": -F.col(upper), "_hi": -F.col(lower)})
    maxima = mandatory_minima(turned, cells, "_lo", "_hi").select("ds", "vid", (-F.col("hi")).alias("lo"), (-F.col("lo")).alias("hi"), F.lit("maximum").alias("kind"))
    return minima.unionByName(maxima).select("ds", "kind", "vid", "lo", "hi")


def contour_around_point(vertices: DataFrame, cells: DataFrame, points: DataFrame, value: str = "value") -> DataFrame:
    """(ds, pid, cid): for points (ds, pid, vid, isovalue), the connected cells of the ds that straddle the isovalue and hold the one nearest the point.

    vertices need x, y, z. Cells straddle if they have values on both sides. Points without a ds are points of every ds that has their vertex.
    """
    v = vertices.select("ds", "vid", F.col(value).cast("double").alias("f"), "x", "y", "z")
    corner = cells.select("ds", "cid", F.explode("verts").alias("vid")).join(v, ["ds", "vid"])
    span = corner.groupBy("ds", "cid").agg(F.min("f").alias("lo"), F.max("f").alias("hi"), *(F.avg(c).alias(f"c{c}") for c in "xyz"))
    on = ["ds", "vid"] if "ds" in points.columns else ["vid"]
    wanted = points.select(*on, "pid", F.col("isovalue").cast("double").alias("iso")).join(v.select("ds", "vid", "x", "y", "z"), on)
    from ..functions.order import dense_index

    levels = dense_index(wanted.select("ds", "iso").distinct(), ["ds", "iso"], "level")
    crossing = span.join(levels.withColumnRenamed("ds", "l_ds"), (F.col("ds") == F.col("l_ds")) & (F.col("lo") <= F.col("iso")) & (F.col("hi") > F.col("iso"))).drop("l_ds")
    of = crossing.select("ds", "level", "cid")
    meet = of.join(cells.select("ds", "cid", F.explode("verts").alias("vid")), ["ds", "cid"]).groupBy("level", "vid").agg(F.min("cid").alias("a"), F.collect_list("cid").alias("all"))
    # a level belongs to one ds: components within levels are components within both
    label = graph.components_within(meet.select(F.col("level").alias("ds"), "a", F.explode("all").alias("b")), of.select(F.col("level").alias("ds"), F.col("cid").alias("node")))
    label = label.select(F.col("ds").alias("level"), F.col("node").alias("cid"), "component")
    marked = crossing.join(label, ["level", "cid"]).select("ds", "level", "cid", "component", "cx", "cy", "cz")
    near = F.struct(F.expr("(x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)").alias("d"), F.col("component"))
    asked = wanted.join(levels, ["ds", "iso"])
    chosen = asked.join(marked.drop("ds"), "level").groupBy("pid", "level").agg(F.min(near).alias("n")).select("pid", "level", F.col("n.component").alias("component"))
    return chosen.join(marked, ["level", "component"]).select("ds", "pid", "cid")
