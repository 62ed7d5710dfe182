"""Separatrices of a discrete gradient (ds, dim, cell, paired): ascending lines, saddle connectors, and walls.

Between simplices of the highest dimensions a V-path has one way to go, since a face has two cofaces at most: lines are pointers, walked by doubled jumps. Between edges
and triangles of a volume paths branch and meet again: they are followed from all saddles at once, a step a round, and where several meet their numbers are added.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import dense_index
from ..functions.storage import dropped, settled
from . import graph, kernels, topology

#: Numbers of paths stop here: they can grow as a power of the paths' length.
MOST_PATHS = 1 << 40


def _faces(cell: str | Column) -> Column:
    """The faces of a simplex, each without one of its vertices."""
    c = F.col(cell) if isinstance(cell, str) else cell
    return F.transform(c, lambda v: F.filter(c, lambda w: w != v))


def ascending_lines(gradient: DataFrame, cells: DataFrame) -> DataFrame:
    """(ds, saddle, side, step, cid): from each critical face of the highest cells up over its cofaces, by pairs of face and cell, to a critical cell or the boundary.

    Saddles are critical edges of a surface, critical triangles of a volume; sides are numbered by their first cell, as step 0. cells: (ds, cid, verts) of one dimension.
    """
    d = (cells.agg(F.max(F.size("verts"))).first()[0] or 2) - 1
    tops = cells.where(F.size("verts") == d + 1).select("ds", "cid", F.array_sort("verts").alias("top"))
    cofaces = settled(tops.select("ds", "cid", F.explode(_faces("top")).alias("face")), "cofaces")
    own = gradient.where(F.col("dim") == d - 1)
    pairs = own.where("paired is not null").select("ds", F.col("cell").alias("face"), F.array_sort("paired").alias("top")).join(tops, ["ds", "top"]).select("ds", "face", F.col("cid").alias("v"))
    over = pairs.join(cofaces.withColumnRenamed("cid", "nxt"), ["ds", "face"]).where("nxt <> v").select("ds", "v", "nxt")
    saddles = own.where("paired is null").select("ds", F.col("cell").alias("saddle")).join(cofaces.withColumnRenamed("face", "saddle"), ["ds", "saddle"])
    saddles = settled(saddles.groupBy("ds", "saddle").agg(F.array_sort(F.collect_list("cid")).alias("c")).select("ds", "saddle", F.posexplode("c").alias("side", "cid")), "saddles")
    stride = (cells.agg(F.max("cid")).first()[0] or 0) + 1
    key = lambda c: F.col("ds") * stride + F.col(c)
    ways = graph.walked(over.select(key("v").alias("v"), key("nxt").alias("nxt")), saddles.select(key("cid").alias("start")).distinct())
    met = saddles.withColumn("start", key("cid")).drop("cid").join(ways, "start")
    return met.select("ds", "saddle", "side", F.col("step").cast("int").alias("step"), F.expr(f"pmod(at, {stride})").alias("cid"))


def _followed(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(ds, saddle, x, paths, odd): how many paths lead from each saddle to each x, of starts (ds, saddle, x) and steps (ds, x, y) without a circle, and whether that is odd.

    A round takes what arrived in the last one a step further and adds up what meets; it ends with the longest path.
    """
    front = settled(starts.groupBy("ds", "saddle", "x").agg(F.count("*").alias("paths"), (F.count("*") % 2).alias("odd")), "front")
    steps = settled(steps.select("ds", "x", "y"), "steps")
    seen = None
    rounds: list[DataFrame] = []
    while not front.isEmpty():
        nxt = front.join(steps, ["ds", "x"]).groupBy("ds", "saddle", F.col("y").alias("x")).agg(F.least(F.sum("paths"), F.lit(MOST_PATHS)).alias("paths"), (F.sum("odd") % 2).alias("odd"))
        nxt = settled(nxt, "front")
        rounds.append(front)
        if len(rounds) == 16:  # their files go: nothing reads them from here on
            seen, rounds = _summed(seen, rounds), []
        front = nxt
    return _summed(seen, rounds) if rounds or seen is None else seen


def _summed(seen: DataFrame | None, rounds: list[DataFrame]) -> DataFrame:
    parts = ([seen] if seen is not None else []) + rounds
    if not parts:
        raise ValueError("no saddle was given")
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    out = settled(all_.groupBy("ds", "saddle", "x").agg(F.least(F.sum("paths"), F.lit(MOST_PATHS)).alias("paths"), (F.sum("odd") % 2).alias("odd")), "seen")
    dropped(*parts)
    return out


def _middle(gradient: DataFrame) -> DataFrame:
    """(ds, edge, triangle): the pairs of an edge and a triangle."""
    return gradient.where("dim = 1 and paired is not null").select("ds", F.col("cell").alias("edge"), F.array_sort("paired").alias("triangle"))


def descending_reach(gradient: DataFrame) -> DataFrame:
    """(ds, saddle, edge, paths, odd): the edges that descending V-paths from each critical triangle reach, critical ones among them, how many paths (2^40 at most) do, and 1 if their number is odd."""
    pairs = settled(_middle(gradient), "pairs")
    down = pairs.select("ds", F.col("edge").alias("x"), "edge", F.explode(_faces("triangle")).alias("y")).where("y <> edge")
    tops = gradient.where("dim = 2 and paired is null").select("ds", F.col("cell").alias("saddle"))
    found = _followed(tops.select("ds", "saddle", F.explode(_faces("saddle")).alias("x")), down) if not tops.isEmpty() else tops.select("ds", "saddle", F.col("saddle").alias("x"), F.lit(0).cast("long").alias("paths"), F.lit(0).cast("long").alias("odd")).limit(0)
    return found.withColumnRenamed("x", "edge")


def saddle_connectors(gradient: DataFrame) -> DataFrame:
    """(ds, saddle, edge, paths, odd): critical triangles and the critical edges to which V-paths lead down from them; two paths cancel each other in Z2."""
    critical = gradient.where("dim = 1 and paired is null").select("ds", F.col("cell").alias("edge"))
    return descending_reach(gradient).join(critical, ["ds", "edge"]).select("ds", "saddle", "edge", "paths", "odd")


def descending_walls(gradient: DataFrame) -> DataFrame:
    """(ds, saddle, triangle): the triangles of each critical triangle's descending 2-manifold, itself among them."""
    paired = descending_reach(gradient).join(_middle(gradient), ["ds", "edge"]).select("ds", "saddle", "triangle")
    return paired.unionByName(gradient.where("dim = 2 and paired is null").select("ds", F.col("cell").alias("saddle"), F.col("cell").alias("triangle"))).distinct()


def ascending_walls(gradient: DataFrame, cells: DataFrame) -> DataFrame:
    """(ds, saddle, edge): the edges whose dual faces make up each critical edge's ascending 2-manifold in a volume, itself among them.

    From an edge paths go up over its triangles, each to the edge that the triangle is paired with. cells: (ds, cid, verts).
    """
    tops = cells.where(F.size("verts") > 2).select("ds", F.array_sort("verts").alias("c"))
    largest = (cells.agg(F.max(F.size("verts"))).first()[0] or 3) - 1
    triangles = tops.select("ds", F.explode(_faces("c")).alias("triangle")).distinct() if largest > 2 else tops.withColumnRenamed("c", "triangle")
    cofaces = triangles.select("ds", "triangle", F.explode(_faces("triangle")).alias("x"))
    pairs = _middle(gradient)
    up = settled(cofaces.join(pairs.withColumnRenamed("edge", "y"), ["ds", "triangle"]).where("x <> y").select("ds", "x", "y"), "up")
    saddles = gradient.where("dim = 1 and paired is null").select("ds", F.col("cell").alias("saddle"), F.col("cell").alias("x"))
    if saddles.isEmpty():
        return saddles.withColumnRenamed("x", "edge")
    return _followed(saddles, up).select("ds", "saddle", F.col("x").alias("edge"))


def _reduced(pdf: pd.DataFrame) -> pd.DataFrame:
    """(ds, col, row): each column's last row once columns, in order, have had those before them with the same last row added to them."""
    columns: dict[tuple, set] = defaultdict(set)
    for c, r in zip(pdf["col"], pdf["row"]):
        columns[tuple(c)].add(tuple(r))
    owner: dict[tuple, set] = {}
    out = []
    for c in sorted(columns):
        own = columns[c]
        while own and max(own) in owner:
            own = own ^ owner[max(own)]
        if own:
            owner[max(own)] = own
            out.append((int(pdf["ds"].iloc[0]), list(c), list(max(own))))
    return pd.DataFrame(out, columns=["ds", "col", "row"])


def saddle_saddle_pairs(vertices: DataFrame, cells: DataFrame, value: str = "value", offset: str | None = None, gradient: DataFrame | None = None, kernel_rows: int = 100_000) -> DataFrame:
    """The pairs of a critical edge and a critical triangle that persistence matches in a volume, as rows of a persistence diagram of type 1.

    The boundaries of critical triangles are the critical edges to which an odd number of V-paths leads. This matrix over Z2 has the field's pairs and no regular cell.
    It is reduced by rounds of joins: of columns with one last row the first is added to the others, whose last rows so go down, until no two agree. What has no more
    than kernel_rows entries is reduced in a task for each ds. A pair whose simplices enter with one vertex isn't listed.
    """
    if gradient is None:
        # written first: values worked out again, as means of doubles, may differ in their last digit, and ranks then order vertices otherwise than the gradient
        vertices = settled(vertices.select(*dict.fromkeys(["ds", "vid", value, offset or "vid"])), "vertices")
        gradient = settled(topology.discrete_gradient(vertices, cells, value, offset), "gradient")
    ranks = dense_index(topology.ordered(vertices, value, offset), ["ds", "key"], "r")
    ranks = settled(ranks.select("ds", "vid", "value", F.col("r").cast("long").alias("r")), "ranks")
    found = saddle_connectors(gradient).where("odd = 1").select("ds", "saddle", "edge")

    def by_rank(df: DataFrame, c: str, to: str) -> DataFrame:
        # a simplex's vertices from the last to enter on: arrays of ranks compare as simplices do
        own = df.select("ds", c).distinct().select("ds", c, F.explode(c).alias("vid")).join(ranks.select("ds", "vid", "r"), ["ds", "vid"])
        return df.join(own.groupBy("ds", c).agg(F.sort_array(F.collect_list("r"), asc=False).alias(to)), ["ds", c]).drop(c)

    entries = settled(by_rank(by_rank(found, "saddle", "col"), "edge", "row").select("ds", "col", "row"), "matrix")
    while entries.limit(kernel_rows + 1).count() > kernel_rows:
        last = settled(entries.groupBy("ds", "col").agg(F.max("row").alias("row")), "last")
        first = last.groupBy("ds", "row").agg(F.min("col").alias("first"), F.count("*").alias("n")).where("n > 1")
        clash = settled(last.join(first, ["ds", "row"]).where("col <> first").select("ds", "col", "first"), "clash")
        if clash.isEmpty():
            break
        more = clash.join(entries.withColumnRenamed("col", "first"), ["ds", "first"]).select("ds", "col", "row")
        was, entries = entries, settled(entries.unionByName(more).groupBy("ds", "col", "row").count().where("count % 2 = 1").select("ds", "col", "row"), "matrix")
        dropped(was, last, clash)
    if entries.limit(kernel_rows + 1).count() > kernel_rows:
        pairs = entries.groupBy("ds", "col").agg(F.max("row").alias("row"))
    else:
        pairs = entries.groupBy("ds").applyInPandas(_reduced, "ds long, col array<bigint>, row array<bigint>")
    out = pairs.select("ds", F.col("row")[0].alias("b"), F.col("col")[0].alias("d")).where("b <> d")
    for c, side in (("b", "birth"), ("d", "death")):
        out = out.join(ranks.select("ds", F.col("r").alias(c), F.col("vid").alias(f"{side}_vid"), F.col("value").alias(side)), ["ds", c])
    kinds = [F.lit(k).alias(n) for n, k in (("pair_type", 1), ("birth_type", kernels.SADDLE1), ("death_type", kernels.SADDLE2))]
    return out.select("ds", "birth_vid", "death_vid", *kinds, "birth", "death", (F.col("death") - F.col("birth")).alias("persistence"))
