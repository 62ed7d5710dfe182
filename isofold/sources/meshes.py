"""Mesh files: OFF, OBJ and VRML text, and a compressed topological format on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import dense_index


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (ds, vid, x, y, z, VertScalarField_i), cells (ds, cid, verts, CellScalarField_i)) of an OFF file.

    Lines are numbered over their ranges and parsed by columns; further numbers on a line are fields. Cells have 2 to 4 vertices.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("at")).where("value <> '' and value not like '#%'")
    lines = dense_index(lines, ["at"], "n").select("n", F.split("value", r"\s+").alias("w"))
    head = {r["n"]: r["w"] for r in lines.where("n < 2").collect()}
    if not head or head[0][0] != "OFF":
        raise ValueError("not an OFF file")
    counts, first = (head[0][1:], 1) if len(head[0]) >= 4 else (head[1], 2)
    n, m = int(counts[0]), int(counts[1])
    v = lines.where((F.col("n") >= first) & (F.col("n") < first + n))
    c = lines.where((F.col("n") >= first + n) & (F.col("n") < first + n + m))
    if v.count() != n or c.count() != m:
        raise ValueError(f"the file says {n} points and {m} cells and has fewer lines")
    bad = c.where(~F.coalesce(F.col("w")[0].try_cast("int").between(2, 4), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"a cell of {bad[0]['w'][0]} vertices")
    extra_v = max(0, (v.where(F.col("n") == first).select(F.size("w")).first() or [3])[0] - 3)
    top = c.where(F.col("n") == first + n).select(F.size("w") - 1 - F.col("w")[0].try_cast("int")).first()
    extra_c = max(0, top[0]) if top else 0
    vertices = v.select(F.lit(0).cast("long").alias("ds"), (F.col("n") - first).alias("vid"), *(F.col("w")[k].cast("double").alias(a) for k, a in enumerate("xyz")), *(F.col("w")[3 + k].cast("double").alias(f"VertScalarField_{k}") for k in range(extra_v)))
    size = F.col("w")[0].try_cast("int")
    cells = c.select(F.lit(0).cast("long").alias("ds"), (F.col("n") - first - n).alias("cid"), F.slice("w", F.lit(2), size).cast("array<bigint>").alias("verts"), *(F.element_at("w", size + 2 + k).cast("double").alias(f"CellScalarField_{k}") for k in range(extra_c)))
    return vertices, cells


def _text(parts: list[DataFrame], path: str) -> None:
    """Lines (a, b, line) in the order of (a, b) as one text file."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.repartitionByRange(1, "a", "b").sortWithinPartitions("a", "b").select("line").write.mode("overwrite").text(path)


def write_off(vertices: DataFrame, cells: DataFrame, path: str, vertex_fields: list[str] | None = None, cell_fields: list[str] | None = None) -> None:
    """One OFF file. Vertex ids must be dense from 0."""
    spark = vertices.sparkSession
    n, m = vertices.count(), cells.count()
    head = spark.createDataFrame([(0, 0, "OFF"), (0, 1, f"{n} {m} 0")], "a int, b long, line string")
    v = vertices.select(F.lit(1).alias("a"), F.col("vid").cast("long").alias("b"), F.concat_ws(" ", "x", "y", "z", *(vertex_fields or [])).alias("line"))
    c = cells.select(F.lit(2).alias("a"), F.col("cid").cast("long").alias("b"), F.concat_ws(" ", F.size("verts"), F.array_join(F.col("verts").cast("array<string>"), " "), *(cell_fields or [])).alias("line"))
    _text([head, v, c], path)


def write_obj(vertices: DataFrame, cells: DataFrame, path: str) -> None:
    """One OBJ file: v lines, then l and f lines, numbered from 1."""
    v = vertices.select(F.lit(1).alias("a"), F.col("vid").cast("long").alias("b"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    ids = F.array_join(F.transform("verts", lambda x: (x + 1).cast("string")), " ")
    c = cells.select(F.lit(2).alias("a"), F.col("cid").cast("long").alias("b"), F.concat_ws(" ", F.when(F.size("verts") == 2, "l").otherwise("f"), ids).alias("line"))
    _text([v, c], path)


def write_vrml(vertices: DataFrame, cells: DataFrame, path: str) -> None:
    """One VRML 2 indexed face set, without textures."""
    spark = vertices.sparkSession
    wrap = [(0, 0, "#VRML V2.0 utf8"), (0, 1, "Shape { geometry IndexedFaceSet { coord Coordinate { point ["), (2, 0, "] } coordIndex ["), (4, 0, "] } }")]
    head = spark.createDataFrame(wrap, "a int, b long, line string")
    v = vertices.select(F.lit(1).alias("a"), F.col("vid").cast("long").alias("b"), F.concat(F.concat_ws(" ", "x", "y", "z"), F.lit(",")).alias("line"))
    c = cells.select(F.lit(3).alias("a"), F.col("cid").cast("long").alias("b"), F.concat(F.array_join(F.col("verts").cast("array<string>"), ", "), F.lit(", -1,")).alias("line"))
    _text([head, v, c], path)


# ---------------------------------------------------------------- topological compression
def compressed(vertices: DataFrame, cells: DataFrame, tolerance: float = 10.0, max_error: float = 10.0, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(quantised (ds, vid, segment), segments (ds, segment, level) and constraints in one): a field kept to a tolerance in percent of its range.

    Pairs with more persistence than the tolerance, and the global extremes, keep their values; others fall to the middle of a segment no wider than twice
    the error allowed.
    """
    from ..operators import topology

    v = vertices.select("ds", "vid", F.col(value).cast("double").alias("value"))
    span = v.groupBy("ds").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    pairs = topology.persistence_diagram(vertices, cells, value).join(span, "ds").where(F.col("persistence") > (F.col("hi") - F.col("lo")) * tolerance / 100)
    kept = pairs.select("ds", F.explode(F.array("birth_vid", "death_vid")).alias("vid")).distinct().join(v, ["ds", "vid"])
    width = F.greatest((F.col("hi") - F.col("lo")) * max_error / 50, F.lit(1e-300))
    quantised = v.join(span, "ds").select("ds", "vid", F.floor((F.col("value") - F.col("lo")) / width).alias("segment"), (F.col("lo") + (F.floor((F.col("value") - F.col("lo")) / width) + 0.5) * width).alias("level"))
    segments = quantised.groupBy("ds", "segment").agg(F.first("level").alias("level"))
    table = segments.select("ds", F.lit("segment").alias("kind"), F.col("segment").alias("id"), F.col("level").alias("value")).unionByName(kept.select("ds", F.lit("constraint").alias("kind"), F.col("vid").alias("id"), "value"))
    return quantised.select("ds", "vid", "segment"), table


def write_compressed(vertices: DataFrame, cells: DataFrame, path: str, tolerance: float = 10.0, max_error: float = 10.0, value: str = "value") -> None:
    """Parquet with Zstandard: run-length and dictionary encoding make long equal segments small."""
    field, table = compressed(vertices, cells, tolerance, max_error, value)
    field.repartitionByRange("ds", "vid").sortWithinPartitions("ds", "vid").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/field")
    table.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/topology")


def read_compressed(spark: SparkSession, path: str) -> DataFrame:
    """(ds, vid, Decompressed, offset)."""
    field, table = spark.read.parquet(f"{path}/field"), spark.read.parquet(f"{path}/topology")
    levels = table.where("kind = 'segment'").select("ds", F.col("id").alias("segment"), F.col("value").alias("level"))
    exact = table.where("kind = 'constraint'").select("ds", F.col("id").alias("vid"), F.col("value").alias("exact"))
    return field.join(levels, ["ds", "segment"]).join(exact, ["ds", "vid"], "left").select("ds", "vid", F.coalesce("exact", "level").alias("Decompressed"), F.col("vid").alias("offset"))
