"""Tracking over time: by overlap of labelled points, and by matching persistence diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import diagrams as dg
from . import graph


def overlap_nodes(points: DataFrame) -> DataFrame:
    """(level, t, label, Size, cx, cy, cz): the labelled sets of points (level, t, x, y, z, label)."""
    return points.groupBy("level", "t", "label").agg(F.count("*").alias("Size"), *(F.avg(c).alias(f"c{c}") for c in "xyz"))


def overlap_edges(points: DataFrame) -> DataFrame:
    """(level, t, label, next_label, Overlap): identical coordinates in successive steps."""
    steps = points.select("level", "t").distinct().withColumn("t2", F.lead("t").over(Window.partitionBy("level").orderBy("t")))
    a = points.select("level", "t", "x", "y", "z", "label").join(steps, ["level", "t"])
    b = points.select("level", F.col("t").alias("t2"), "x", "y", "z", F.col("label").alias("next_label"))
    return a.join(b, ["level", "t2", "x", "y", "z"]).groupBy("level", "t", "t2", "label", "next_label").agg(F.count("*").alias("Overlap"))


def nesting_edges(points: DataFrame) -> DataFrame:
    """(t, level, label, next_label, Overlap): identical coordinates in successive levels of a step."""
    levels = points.select("level").distinct().withColumn("level2", F.lead("level").over(Window.orderBy("level")))
    a = points.select("level", "t", "x", "y", "z", "label").join(levels, "level")
    b = points.select(F.col("level").alias("level2"), "t", "x", "y", "z", F.col("label").alias("next_label"))
    return a.join(b, ["level2", "t", "x", "y", "z"]).groupBy("t", "level", "level2", "label", "next_label").agg(F.count("*").alias("Overlap"))


def track_overlap(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with BranchId, edges with BranchId): a branch goes on where a node and its successor are each other's largest.

    The largest predecessor and successor are the neighbours of most points, the smaller label on ties; branches are the chains of such edges.
    """
    nodes, edges = overlap_nodes(points), overlap_edges(points)
    size = nodes.select("level", "t", "label", "Size")
    met = edges.join(size.withColumnRenamed("Size", "s1"), ["level", "t", "label"]).join(size.select("level", F.col("t").alias("t2"), F.col("label").alias("next_label"), F.col("Size").alias("s2")), ["level", "t2", "next_label"])
    forward = Window.partitionBy("level", "t", "label").orderBy(F.desc("s2"), "next_label")
    back = Window.partitionBy("level", "t2", "next_label").orderBy(F.desc("s1"), "label")
    met = met.withColumns({"f": F.row_number().over(forward), "b": F.row_number().over(back)})
    keyed = nodes.select("level", "t", "label", F.row_number().over(Window.partitionBy("level", "t").orderBy("label")).alias("n"))
    from ..functions.order import dense_index

    keyed = dense_index(keyed.drop("n"), ["level", "t", "label"], "v")
    chain = met.where("f = 1 and b = 1").join(keyed.withColumnRenamed("v", "p"), ["level", "t", "label"]).join(keyed.select("level", F.col("t").alias("t2"), F.col("label").alias("next_label"), F.col("v").alias("w")), ["level", "t2", "next_label"])
    ends = graph.roots(keyed.select("v").join(chain.select(F.col("w").alias("v"), F.col("p").alias("nxt")), "v", "left"))
    branch = keyed.join(ends.select("v", F.col("root").alias("BranchId")), "v").drop("v")
    out_nodes = nodes.join(branch, ["level", "t", "label"])
    later = branch.select("level", F.col("t").alias("t2"), F.col("label").alias("next_label"), F.col("BranchId").alias("b2"))
    out_edges = met.join(branch, ["level", "t", "label"]).join(later, ["level", "t2", "next_label"])
    main = (F.col("f") == 1) & (F.col("b") == 1)
    return out_nodes, out_edges.select("level", "t", "t2", "label", "next_label", "Overlap", F.when(main | (F.col("b") != 1), F.col("BranchId")).otherwise(F.col("b2")).alias("BranchId"))


def track_diagrams(pairs: DataFrame, p: float = 2.0) -> DataFrame:
    """(t, birth, death, pair_type, track): chains of matched pairs of successive diagrams (ds is time)."""
    from ..functions.order import dense_index

    d = dense_index(pairs.select("ds", "birth", "death", "pair_type", "birth_vid", "death_vid"), ["ds", "pair_type", "birth", "death", "birth_vid", "death_vid"], "v")
    steps = pairs.select(F.col("ds").alias("i")).distinct().withColumn("j", F.lead("i").over(Window.orderBy("i"))).where("j is not null")
    met = dg.matchings(d, steps, p).where("birth1 is not null and birth2 is not null")
    # equal points of a diagram are told apart by their turn among the equal
    turn = Window.partitionBy("ds", "pair_type", "birth", "death").orderBy("v")
    named = d.withColumn("k", F.row_number().over(turn))
    first = Window.partitionBy("i", "pair_type", "birth1", "death1").orderBy("birth2", "death2")
    second = Window.partitionBy("j", "pair_type", "birth2", "death2").orderBy("birth1", "death1")
    met = met.withColumns({"k1": F.row_number().over(first), "k2": F.row_number().over(second)})
    a = named.select(F.col("ds").alias("i"), "pair_type", F.col("birth").alias("birth1"), F.col("death").alias("death1"), F.col("k").alias("k1"), F.col("v").alias("p"))
    b = named.select(F.col("ds").alias("j"), "pair_type", F.col("birth").alias("birth2"), F.col("death").alias("death2"), F.col("k").alias("k2"), F.col("v").alias("w"))
    links = met.join(a, ["i", "pair_type", "birth1", "death1", "k1"]).join(b, ["j", "pair_type", "birth2", "death2", "k2"]).select(F.col("w").alias("v"), F.col("p").alias("nxt"))
    ends = graph.roots(d.select("v").join(links, "v", "left"))
    return d.join(ends.select("v", F.col("root").alias("track")), "v").select(F.col("ds").alias("t"), "birth", "death", "pair_type", "birth_vid", "death_vid", "track")


def track_fields(vertices: DataFrame, cells: DataFrame, every: int = 1, p: float = 2.0, threshold: float = 0.0) -> DataFrame:
    """As track_diagrams(), from fields whose ds is time: every so many steps, pairs with a share of the largest persistence."""
    from . import topology

    sampled = vertices.where(F.col("ds") % every == 0)
    return track_diagrams(dg.constrained(topology.persistence_diagram(sampled, cells), "relative", threshold=threshold), p)
