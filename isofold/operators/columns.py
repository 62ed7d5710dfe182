"""Selection, conversion and composition of columns and blocks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import dense_index
from ..functions.templating import listed, numbers

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

#: Names of the types an array can be cast to.
TARGETS = {"char": "tinyint", "unsigned char": "smallint", "short": "smallint", "unsigned short": "int", "int": "int", "unsigned int": "bigint", "long": "bigint", "unsigned long": "decimal(20,0)", "id": "bigint", "float": "float", "double": "double"}
#: Ranges of the integer types.
RANGES = {"char": (-128, 127), "unsigned char": (0, 255), "short": (-(2**15), 2**15 - 1), "unsigned short": (0, 2**16 - 1), "int": (-(2**31), 2**31 - 1), "unsigned int": (0, 2**32 - 1), "long": (-(2**63), 2**63 - 1), "id": (-(2**63), 2**63 - 1), "unsigned long": (0, 2**64 - 1)}


def _group(ds: str | None) -> Window:
    return Window.partitionBy(ds) if ds else Window.partitionBy()


def extremes(df: DataFrame, columns: Sequence[str], ds: str | None = None) -> DataFrame:
    """df with lo_<c> and hi_<c>: an aggregate of a row for each ds, joined back, so that no task needs all rows."""
    stats = [f(c).alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))]
    if ds:
        return df.join(df.groupBy(F.col(ds).alias("_ds")).agg(*stats), F.col(ds).eqNullSafe(F.col("_ds")), "left").drop("_ds")
    return df.crossJoin(F.broadcast(df.agg(*stats)))  # one row


def select_columns(df: DataFrame, names: Sequence[str] | None = None, regex: str = ".*", range_id: tuple[int, int] | None = None, keep: Sequence[str] = (), rename: str | None = None, numeric_only: bool = False) -> DataFrame:
    """The named columns (all, if None) whose place is within range_id and whose whole name matches the regex, besides those to keep.

    rename is for a single selected column. A malformed regex raises re.error.
    """
    pattern = re.compile(regex)
    offered = [f for f in df.schema.fields if f.name not in keep and (not numeric_only or isinstance(f.dataType, NUMERIC))]
    lo, hi = range_id or (0, len(offered) - 1)
    chosen = [f.name for i, f in enumerate(offered) if lo <= i <= hi and (names is None or f.name in names) and pattern.fullmatch(f.name)]
    out = df.select(*keep, *chosen)
    if rename is not None:
        if len(chosen) != 1:
            raise ValueError("only a single selected column can be renamed")
        out = out.withColumnRenamed(chosen[0], rename)
    return out


def parse_arrays(text: str) -> dict[str, list]:
    """Lines `name,v1,v2,...` as columns; numeric if every value is a number."""
    out: dict[str, list] = {}
    for line in filter(str.strip, text.splitlines()):
        name, *rest = listed(line)
        out[name] = numbers(",".join(rest)) or rest
    return out


def add_arrays(df: DataFrame, text: str, id_col: str = "vid") -> DataFrame:
    """Adds columns given as text, value i to the row with id i; each needs as many values as df has rows."""
    arrays = parse_arrays(text)
    n = df.count()
    for name, values in arrays.items():
        if len(values) != n:
            raise ValueError(f"{name} has {len(values)} values for {n} rows")
    spark = df.sparkSession
    rows = spark.createDataFrame(list(zip(range(n), *arrays.values())), [id_col, *arrays])
    return df.drop(*arrays).join(rows.withColumn(id_col, F.col(id_col).cast(df.schema[id_col].dataType)), id_col, "left")


def copy_arrays(df: DataFrame, source: DataFrame, names: Sequence[str], id_col: str = "vid") -> DataFrame:
    return df.drop(*names).join(source.select(id_col, *names), id_col, "left")


def remove_arrays(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def edit_array(df: DataFrame, name: str, to: str | None = None, rename: str | None = None) -> DataFrame:
    """Casts a column to a target type, which must hold its values, and renames it."""
    out = df.withColumn(name, F.col(name).cast(TARGETS[to])) if to else df
    return out.withColumnRenamed(name, rename) if rename else out


def convert(df: DataFrame, name: str, to: str, normalize: bool = False, ds: str | None = None) -> DataFrame:
    """A column as another type, cut toward zero; with normalize, integer targets are stretched to the type's range."""
    c = F.col(name).cast("double")
    if normalize and to in RANGES:
        lo, hi = RANGES[to]
        df = extremes(df, [name], ds)
        share = F.try_divide(c - F.col(f"lo_{name}"), F.col(f"hi_{name}") - F.col(f"lo_{name}"))
        value = share * float(hi - lo) + float(lo)
        return df.withColumn(name, _truncated(value).cast(TARGETS[to])).drop(f"lo_{name}", f"hi_{name}")
    return df.withColumn(name, (_truncated(c) if to in RANGES else c).cast(TARGETS[to]))


def _truncated(c: Column) -> Column:
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))


#: What the normaliser adds, ten to minus the digits of a float.
FLOAT_STEP = 1e-6


def normalize(df: DataFrame, name: str, ds: str | None = None) -> DataFrame:
    """(v - min) / (max - min) + 1e-6; null where all values are equal."""
    df = extremes(df, [name], ds)
    return df.withColumn(name, F.try_divide(F.col(name) - F.col(f"lo_{name}"), F.col(f"hi_{name}") - F.col(f"lo_{name}")) + FLOAT_STEP).drop(f"lo_{name}", f"hi_{name}")


def as_table(df: DataFrame, geometry: Sequence[str] = ("x", "y", "z", "verts")) -> DataFrame:
    """A data set's attributes without its geometry."""
    return df.drop(*geometry)


def embed_from_table(vertices: DataFrame, table: DataFrame, x: str, y: str, z: str | None = None, id_col: str = "vid") -> DataFrame:
    """Coordinates from table columns, row i to vertex i; z is 0 without a column for it. Both sides need the same ids."""
    n, m = vertices.count(), table.count()
    if n != m:
        raise ValueError(f"{n} points and {m} rows")
    coords = table.select(id_col, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(z).cast("double") if z else F.lit(0.0)).alias("z"))
    return vertices.drop("x", "y", "z").join(coords, id_col)


def project_from_fields(vertices: DataFrame, u: str, v: str) -> DataFrame:
    return vertices.withColumns({"x": F.col(u).cast("double"), "y": F.col(v).cast("double"), "z": F.lit(0.0)})


def texture_map(df: DataFrame, u: str, v: str, repeat: bool = False, only_u: bool = False, only_v: bool = False, ds: str | None = None, name: str = "uv") -> DataFrame:
    """An array column of two texture coordinates, each field stretched to 0 to 1 unless it may repeat."""
    df = extremes(df, [u, v], ds) if not repeat else df
    c = [F.col(x).cast("double") if repeat else F.try_divide(F.col(x) - F.col(f"lo_{x}"), F.col(f"hi_{x}") - F.col(f"lo_{x}")) for x in (u, v)]
    out = df.withColumn(name, F.array(F.lit(0.0) if only_v else c[0], F.lit(0.0) if only_u else c[1]))
    return out.drop(*(f"{p}_{x}" for x in (u, v) for p in ("lo", "hi")))


def identifiers(df: DataFrame, by: Sequence[str], name: str = "VertexIdentifiers") -> DataFrame:
    """A dense global id, the place of each row in the order of `by`, numbered over ranges."""
    return dense_index(df, list(by), name)


def identify_by_scalar(df: DataFrame, scalar: str, tie: str, descending: bool = True, start: int = 0, ds: str | None = None, name: str = "CellScalarFieldName") -> DataFrame:
    """Each row's rank by a scalar, ties by id; of all rows it is numbered over ranges, within each ds by a window."""
    key = F.desc(scalar) if descending else F.asc(scalar)
    if ds is None:
        return dense_index(df, [key, F.asc(tie)], name, start)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(ds).orderBy(key, F.asc(tie))) - 1 + start)


def randomize_identifiers(df: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """A seeded permutation of a column's distinct values, numbered from 0."""
    ids = dense_index(df.select(name).distinct(), [F.xxhash64(name, F.lit(seed)), F.col(name)], "_new")
    return df.join(ids, name).withColumn(name, F.col("_new")).drop("_new")


# ---------------------------------------------------------------- blocks
def extract_blocks(df: DataFrame, ids: Sequence[int], ds: str = "ds") -> DataFrame:
    return df.where(F.col(ds).isin([int(i) for i in ids]))


def extract_geometry(vertices: DataFrame, cells: DataFrame, field: str, values: Sequence, policy: str = "all", ds: str = "ds") -> tuple[DataFrame, DataFrame]:
    """Vertices whose field is in values, and cells all, any or some (sub: cut to what is left) of whose vertices stay."""
    kept = vertices.where(F.col(field).isin([v for v in values]))
    alive = kept.select(ds, "vid").withColumn("_alive", F.lit(True))
    pos = cells.select("*", F.posexplode("verts").alias("_pos", "_v"))
    flagged = pos.join(alive, (pos[ds] == alive[ds]) & (pos["_v"] == alive["vid"]), "left").drop(alive[ds]).drop(alive["vid"])
    parts = flagged.groupBy(ds, "cid").agg(F.count("_alive").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_alive"), F.struct("_pos", "_v")))).alias("_left"))
    out = cells.join(parts, [ds, "cid"])
    if policy == "all":
        out = out.where(F.col("_n") == F.size("verts"))
    elif policy == "any":
        out = out.where("_n > 0")
        touched = out.select(ds, F.explode("verts").alias("vid")).distinct()
        kept = vertices.join(touched, [ds, "vid"], "left_semi").unionByName(kept.join(touched, [ds, "vid"], "left_anti"))
    elif policy == "sub":
        out = out.where("_n > 0").withColumn("verts", F.transform("_left", lambda s: s["_v"]))
    else:
        raise ValueError("policy is all, any or sub")
    return kept, out.drop("_n", "_left")


def for_each(df: DataFrame, by: str) -> DataFrame:
    """Adds (_iteration, _iterations): which of the distinct values of `by` a row has, in order, and how many there are.

    A loop's body is then an operator that keeps `by` as its ds column; nothing iterates.
    """
    turns = df.select(by).distinct()
    n = turns.count()
    return df.join(dense_index(turns, [by], "_iteration"), by).withColumn("_iterations", F.lit(n))


def aggregate_blocks(*blocks: DataFrame, ds: str = "ds") -> DataFrame:
    """One table of all inputs; an input with several blocks is flattened, and blocks are numbered in turn."""
    out, base = None, 0
    for b in blocks:
        if ds in b.columns:
            turns = dense_index(b.select(ds).distinct(), [ds], "_n")
            part = b.join(turns, ds).withColumn(ds, F.col("_n") + base).drop("_n")
            base += turns.count()
        else:
            part, base = b.withColumn(ds, F.lit(base).cast("long")), base + 1
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def grid_layout(vertices: DataFrame, columns: int = 0, rows: int = 0, gap: tuple[float, float] = (10.0, 10.0), axes: tuple[str, str] = ("x", "y"), ds: str = "ds") -> DataFrame:
    """Moves block i to column i % columns and row i div columns of a grid with cells as large as the largest block and gaps in percent."""
    a, b = axes
    boxes = vertices.groupBy(ds).agg(*(f(c).alias(f"{n}_{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))))
    n = boxes.count()
    if not columns:
        columns = -(-n // rows) if rows else int((n - 1) ** 0.5) + 1 if n else 1
        columns = max(1, columns)
    size = boxes.agg(F.max(F.col(f"hi_{a}") - F.col(f"lo_{a}")).alias("w"), F.max(F.col(f"hi_{b}") - F.col(f"lo_{b}")).alias("h"))
    place = dense_index(boxes.select(ds), [ds], "_i").crossJoin(F.broadcast(size))  # one row
    place = place.select(F.col(ds).alias("_ds"), ((F.col("_i") % columns) * F.col("w") * (1 + gap[0] / 100)).alias("_dx"), (F.floor(F.col("_i") / columns) * F.col("h") * (1 + gap[1] / 100)).alias("_dy"))
    return vertices.join(place, F.col(ds) == F.col("_ds")).withColumns({a: F.col(a) + F.col("_dx"), b: F.col(b) + F.col("_dy")}).drop("_ds", "_dx", "_dy")


def interpolate(targets: DataFrame, source_vertices: DataFrame, source_cells: DataFrame, fields: Sequence[str], cell_size: float) -> DataFrame:
    """Source fields at target points (id, x, y) within triangles of the source, by barycentric weights; null outside.

    Points and triangles meet by the square of side cell_size that they share. Triangles have their corners in their own ds; if targets have a ds, a point meets those
    of its ds, else those of all.
    """
    of = ["ds"] if "ds" in source_cells.columns else []
    own = [c for c in of if c in targets.columns]
    v = source_vertices.select(*of, "vid", "x", "y", *fields)
    corners = [v.select(*of, *(F.col(c).alias(f"{c}{k}") for c in v.columns[len(of) :])) for k in range(3)]
    tri = source_cells.where(F.size("verts") == 3).select(*of, "cid", *(F.col("verts")[k].alias(f"vid{k}") for k in range(3)))
    for k in range(3):
        tri = tri.join(corners[k], [*of, f"vid{k}"])
    box = {n: F.expr(f"sequence(cast(floor(least(x_0, x_1, x_2) / {cell_size}) as bigint), cast(floor(greatest(x_0, x_1, x_2) / {cell_size}) as bigint))".replace("x_", n)) for n in ("x", "y")}
    tri = tri.withColumn("bx", F.explode(box["x"])).withColumn("by", F.explode(box["y"]))
    pts = targets.select(*own, F.col("id"), F.col("x").alias("px"), F.col("y").alias("py")).withColumn("bx", F.floor(F.col("px") / cell_size)).withColumn("by", F.floor(F.col("py") / cell_size))
    area = F.expr("(x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)")
    w1 = F.try_divide(F.expr("(px - x0) * (y2 - y0) - (x2 - x0) * (py - y0)"), area)
    w2 = F.try_divide(F.expr("(x1 - x0) * (py - y0) - (px - x0) * (y1 - y0)"), area)
    met = pts.join(tri, [*own, "bx", "by"]).withColumns({"w1": w1, "w2": w2}).where("w1 >= -1e-12 and w2 >= -1e-12 and w1 + w2 <= 1 + 1e-12")
    first = met.groupBy(*own, "id").agg(F.min_by(F.struct(*((F.col(f"{c}0") * (1 - F.col("w1") - F.col("w2")) + F.col(f"{c}1") * F.col("w1") + F.col(f"{c}2") * F.col("w2")).alias(c) for c in fields)), "cid").alias("s"))
    return targets.join(first, [*own, "id"], "left").select(*(targets[c] for c in targets.columns), *(F.col(f"s.{c}").alias(c) for c in fields))
