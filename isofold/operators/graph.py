"""Connectivity, pointer chasing and shortest paths by bounded loops of joins; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import dropped, settled


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that each reaches over edges (a, b). With nodes, lone ones are there too.

    A round links every node to its smallest neighbour, follows the links once more and contracts the edges: the longest chains shrink
    to a fraction each time, and minima are combined before the shuffle, so hubs do no harm.
    """
    edges = settled(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    label = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = settled(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m")), "step")
        jump = settled(step.join(step.select(F.col("v").alias("m"), F.col("m").alias("t")), "m").select("v", F.col("t").alias("m")), "jump")
        fewer = edges.join(jump.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a").join(jump.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b")
        fewer = settled(fewer.where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "edges")
        if label is None:
            now = jump.select(F.col("v").alias("node"), F.col("m").alias("component"))
        else:
            now = label.join(jump, label["component"] == jump["v"], "left").select("node", F.coalesce("m", "component").alias("component"))
        label, edges = settled(now, "label"), fewer
        dropped(step)
    label = label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if nodes is None:
        return label
    own = nodes.select(F.col(nodes.columns[0]).cast("long").alias("node")).distinct()
    return own.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def components_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ds, node, component): components of each ds by itself, over edges (ds, a, b) and nodes (ds, node); ids count anew in every ds and aren't negative."""
    stride = (nodes.agg(F.max("node")).first()[0] or 0) + 1
    key = lambda c: F.col("ds") * stride + F.col(c)
    found = components(edges.select(key("a").alias("a"), key("b").alias("b")), nodes.select(key("node").alias("node")))
    return found.select(F.expr(f"(node - pmod(node, {stride})) div {stride}").alias("ds"), F.expr(f"pmod(node, {stride})").alias("node"), F.expr(f"pmod(component, {stride})").alias("component"))


def cell_components(cells: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and cells of a mesh with RegionId, VertexNumber and CellNumber of their connected component, in each ds by itself if both have one.

    Edges run from a cell's least vertex to its others: a star for each cell, not its pairs.
    """
    if "ds" in cells.columns and "ds" in vertices.columns:
        edges = cells.select("ds", F.array_min("verts").alias("a"), F.explode("verts").alias("b"))
        label = settled(components_within(edges, vertices.select("ds", F.col("vid").alias("node"))), "regions")
        sizes = label.groupBy("ds", "component").agg(F.count("*").alias("VertexNumber"))
        own = cells.select("ds", "cid", F.array_min("verts").alias("node")).join(label, ["ds", "node"]).select("ds", "cid", "component")
        counts = own.groupBy("ds", "component").agg(F.count("*").alias("CellNumber"))
        numbers = sizes.join(counts, ["ds", "component"], "left").select("ds", "component", "VertexNumber", F.coalesce("CellNumber", F.lit(0)).alias("CellNumber"))
        of_vertex = label.join(numbers, ["ds", "component"]).select("ds", F.col("node").alias("vid"), F.col("component").alias("RegionId"), "VertexNumber", "CellNumber")
        of_cell = own.join(numbers, ["ds", "component"]).select("ds", "cid", F.col("component").alias("RegionId"), "VertexNumber", "CellNumber")
        return vertices.join(of_vertex, ["ds", "vid"]), cells.join(of_cell, ["ds", "cid"])
    edges = cells.select(F.array_min("verts").alias("a"), F.explode("verts").alias("b"))
    label = settled(components(edges, vertices.select("vid")), "regions")
    sizes = label.groupBy("component").agg(F.count("*").alias("VertexNumber"))
    own = cells.select("cid", F.array_min("verts").alias("node")).join(label, "node").select("cid", "component")
    counts = own.groupBy("component").agg(F.count("*").alias("CellNumber"))
    numbers = sizes.join(counts, "component", "left").select("component", "VertexNumber", F.coalesce("CellNumber", F.lit(0)).alias("CellNumber"))
    of_vertex = label.join(numbers, "component").select(F.col("node").alias("vid"), F.col("component").alias("RegionId"), "VertexNumber", "CellNumber")
    of_cell = own.join(numbers, "component").select("cid", F.col("component").alias("RegionId"), "VertexNumber", "CellNumber")
    return vertices.join(of_vertex, "vid"), cells.join(of_cell, "cid")


def roots(pointers: DataFrame, weight: str | None = None) -> DataFrame:
    """(v, root, steps, length) of pointers (v, nxt): where following them ends, by doubling. A root points to itself or to null.

    length sums the weight column, or counts steps. Rounds are the logarithm of the longest path. Files of pointers are several times smaller than their rows
    in memory, and Spark broadcasts by files' sizes: joins are told to merge.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = pointers.select(F.col("v"), F.coalesce("nxt", "v").alias("p"), F.when(F.coalesce("nxt", "v") == F.col("v"), 0.0).otherwise(w).alias("length"), F.when(F.coalesce("nxt", "v") == F.col("v"), 0).otherwise(1).cast("long").alias("steps"))
    now = settled(own, "pointers")
    while True:
        far = now.select(F.col("v").alias("p"), F.col("p").alias("q"), F.col("length").alias("l2"), F.col("steps").alias("s2"))
        nxt = settled(now.join(far.hint("merge"), "p").select("v", F.col("q").alias("p"), (F.col("length") + F.col("l2")).alias("length"), (F.col("steps") + F.col("s2")).alias("steps")), "pointers")
        moved = nxt.agg(F.sum("steps")).first()[0] != now.agg(F.sum("steps")).first()[0]
        dropped(now)
        now = nxt
        if not moved:
            return now.select("v", F.col("p").alias("root"), "steps", "length")


def walked(pointers: DataFrame, starts: DataFrame, weight: str | None = None) -> DataFrame:
    """(start, step, at, length): every node on the way from starts (start, distinct) along pointers (v, nxt) to where it ends, the start as step 0.

    A node at step k is reached by the jumps of 2^i steps that k is made of: rounds are the logarithm of the longest way.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    jump = settled(pointers.where("nxt is not null and nxt <> v").select(F.col("v").alias("from"), F.col("nxt").alias("to"), w.alias("w")), "jump")
    # what is only pointed to is an end
    lone = jump.select(F.col("to").alias("v")).distinct().join(pointers.select("v").hint("merge"), "v", "left_anti").select("v", F.lit(None).cast("long").alias("nxt"))
    ends = roots(pointers.select("v", "nxt").unionByName(lone)).select(F.col("v").alias("start"), "steps")
    way = settled(starts.select("start").join(ends.hint("merge"), "start", "left").select("start", F.explode(F.expr("sequence(0L, coalesce(steps, 0L))")).alias("step"), F.col("start").alias("at"), F.lit(0.0).alias("length")), "way")
    longest = way.agg(F.max("step")).first()[0] or 0
    for k in range(int(longest).bit_length()):
        takes = F.col("step").bitwiseAND(F.lit(1 << k)) != 0
        way = way.join(jump.hint("merge"), takes & (F.col("at") == F.col("from")), "left").select("start", "step", F.coalesce("to", "at").alias("at"), (F.col("length") + F.coalesce("w", F.lit(0.0))).alias("length"))
        if k % 4 == 3:
            way = settled(way, "way")
        far = jump.select(F.col("from").alias("to"), F.col("to").alias("end"), F.col("w").alias("w2"))
        jump = settled(jump.join(far.hint("merge"), "to").select("from", F.col("end").alias("to"), (F.col("w") + F.col("w2")).alias("w")), "jump")
    return way


def _offers(front: DataFrame, edges: DataFrame, bound: float | None) -> DataFrame:
    """(v, n): the least that the front offers to each vertex over an edge."""
    offers = front.join(edges, front["v"] == edges["a"]).select(F.col("b").alias("v"), F.struct((F.col("k.d") + F.col("w")).alias("d"), F.col("k.i").alias("i"), F.col("k.s").alias("s")).alias("k"))
    if bound is not None:
        offers = offers.where(F.col("k.d") <= bound)
    return offers.groupBy("v").agg(F.min("k").alias("n"))


def _layers(edges: DataFrame, front: DataFrame, bound: float | None) -> list[DataFrame]:
    """The fronts (v, k), each vertex in one, over edges (a, b, w) of one weight above 0: a round has only the edges to what no front has reached."""
    fronts = [front]
    rest, was = edges, None
    while not front.isEmpty():
        # what leads to the front goes: sizes fall with what is left to reach
        fewer = settled(rest.join(front.select(F.col("v").alias("b")), "b", "left_anti").select("a", "b", "w"), "edges")
        if was is not None:
            dropped(was)
        rest = was = fewer
        front = settled(_offers(front, rest, bound).select("v", F.col("n").alias("k")), "front")
        fronts.append(front)
    return fronts


def _relaxed(edges: DataFrame, front: DataFrame, bound: float | None) -> tuple[DataFrame | None, list[DataFrame]]:
    """(known, fronts), whose least k of each v is final, over edges (a, b, w) of any weights."""
    known, fronts = None, [front]
    while not front.isEmpty():
        offers = _offers(front, edges, bound)
        best = fronts[0]
        for t in fronts[1:]:
            best = best.unionByName(t)
        best = best.groupBy("v").agg(F.min("k").alias("k"))
        if known is not None:
            best = known.unionByName(best).groupBy("v").agg(F.min("k").alias("k"))
        better = settled(offers.join(best, "v", "left").where("k is null or n < k").select("v", F.col("n").alias("k")), "front")
        if len(fronts) >= 16:
            was, known = known, settled(best, "known")
            dropped(*fronts, *([was] if was is not None else []))
            fronts = []
        fronts.append(better)
        front = better
    return known, fronts


def distance_field(edges: DataFrame, sources: DataFrame, vertices: DataFrame, weight: str | None = "w", bound: float | None = None) -> DataFrame:
    """(vid, distance, source, source_index): graph distance to the nearest of sources (vid, index), ties to the smallest index.

    edges: (a, b, w) in both directions or one, w not negative. Relaxation from the frontier only: a round joins what changed in the last, until nothing does;
    vertices farther than `bound`, if any, stay null. What is known is the rounds' own offers, put together every 16 rounds. Where all edges weigh the same,
    a vertex is final once reached, and the edges that lead to it are left out of the rounds that follow.
    """
    both = edges.select("a", "b", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    both = settled(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.min("w").alias("w")), "edges")
    front = settled(sources.groupBy(F.col("vid").alias("v")).agg(F.min(F.struct(F.lit(0.0).alias("d"), F.col("index").cast("long").alias("i"), F.col("vid").cast("long").alias("s"))).alias("k")), "front")
    least, most = both.agg(F.min("w"), F.max("w")).first()
    if least is not None and least == most and least > 0:
        known, fronts = None, _layers(both, front, bound)
    else:
        known, fronts = _relaxed(both, front, bound)
    best = fronts[0]
    for t in fronts[1:]:
        best = best.unionByName(t)
    best = (best if known is None else best.unionByName(known)).groupBy("v").agg(F.min("k").alias("k"))
    out = vertices.select("vid").join(best.select(F.col("v").alias("vid"), "k"), "vid", "left")
    return out.select("vid", F.col("k.d").alias("distance"), F.col("k.s").alias("source"), F.col("k.i").alias("source_index"))


def merge_points(points: DataFrame, threshold: float, candidates: DataFrame | None = None) -> DataFrame:
    """(vid, merged_to, VertexMergeCount, MinMergeDistance, MaxMergeDistance) for points (vid, x, y, z) strictly closer than the threshold.

    Points meet those of the 27 cubes around theirs, never all. A point follows its lowest close point, and that its own, to the end;
    the distances are between a kept point and those merged into it, -1 if none. candidates (vid) limits what may merge, e.g. to a boundary. If points have a ds,
    those of one ds merge, and the result, like candidates, has it as well.
    """
    if "ds" in points.columns:
        stride = (points.agg(F.max("vid")).first()[0] or 0) + 1
        named = lambda t: t.withColumn("vid", F.col("ds") * stride + F.col("vid"))
        out = _merged(named(points), threshold, named(candidates) if candidates is not None else None, ["ds"])
        return out.select(F.expr(f"(vid - pmod(vid, {stride})) div {stride}").alias("ds"), *(F.expr(f"pmod({c}, {stride})").alias(c) for c in ("vid", "merged_to")), *out.columns[2:])
    return _merged(points, threshold, candidates, [])


def _merged(points: DataFrame, threshold: float, candidates: DataFrame | None, of: list[str]) -> DataFrame:
    own = points.select(*of, "vid", "x", "y", "z")
    if candidates is not None:
        own = own.join(candidates.select("vid"), "vid", "left_semi")
    cube = {c: F.floor(F.col(c) / threshold).alias(f"c{c}") for c in "xyz"}
    a = own.select(*of, "vid", "x", "y", "z", *cube.values())
    near = F.array(*(F.array(F.lit(i), F.lit(j), F.lit(k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    b = a.withColumn("o", F.explode(near)).select(*of, F.col("vid").alias("low"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), *((F.col(f"c{c}") + F.col("o")[i]).alias(f"c{c}") for i, c in enumerate("xyz")))
    close = a.join(b, [*of, "cx", "cy", "cz"]).where("low < vid").where(F.expr("(x - x2) * (x - x2) + (y - y2) * (y - y2) + (z - z2) * (z - z2)") < threshold * threshold)
    lowest = close.groupBy(F.col("vid").alias("v")).agg(F.min("low").alias("nxt"))
    ends = roots(points.select(F.col("vid").alias("v")).join(lowest, "v", "left")).select(F.col("v").alias("vid"), F.col("root").alias("merged_to"))
    p, q = points.select("vid", "x", "y", "z"), points.select(F.col("vid").alias("merged_to"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    gap = ends.where("vid <> merged_to").join(p, "vid").join(q, "merged_to").withColumn("d", F.sqrt(F.expr("(x - x2) * (x - x2) + (y - y2) * (y - y2) + (z - z2) * (z - z2)")))
    stats = gap.groupBy("merged_to").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).withColumnRenamed("merged_to", "of")
    return ends.join(stats, F.col("vid") == F.col("of"), "left").select("vid", "merged_to", F.coalesce("n", F.lit(0)).alias("VertexMergeCount"), F.coalesce("lo", F.lit(-1.0)).alias("MinMergeDistance"), F.coalesce("hi", F.lit(-1.0)).alias("MaxMergeDistance"))


def merged_cells(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Cells over the kept points: repeated vertices go, and with them cells that keep too few (2 of a line, 3 of a polygon, 4 or 8 of a solid)."""
    to = merged.select(F.col("vid").alias("_v"), "merged_to")
    new = cells.select("cid", F.size("verts").alias("_n"), F.posexplode("verts").alias("_p", "_v")).join(to, "_v").groupBy("cid", "_n").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_p", "merged_to"))), lambda s: s["merged_to"])).alias("verts"))
    size = F.size("verts")
    ok = F.when(F.col("_n") == 2, size == 2).when(F.col("_n") == 3, size > 2).otherwise(size.isin(4, 8))
    return cells.drop("verts").join(new.where(ok).drop("_n"), "cid")
