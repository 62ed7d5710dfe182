"""Incidence of meshes and grids as tables: cells are (ds, cid, verts), vertices (ds, vid, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The simplices of each dimension within a simplex of d + 1 vertices, as places in its vertex list.
_SUBSETS = {(d, k): [tuple(i for i in range(d + 1) if m >> i & 1) for m in range(1, 1 << (d + 1)) if bin(m).count("1") == k + 1] for d in range(1, 4) for k in range(d + 1)}


def _faces(dim: int) -> Column:
    """All faces of a dimension of a cell, each as a sorted array."""
    sorted_ = F.array_sort("verts")

    def of(d: int) -> Column:
        return F.array(*(F.array(*(sorted_[i] for i in subset)) for subset in _SUBSETS[d, dim]))

    out = F.array().cast("array<array<bigint>>")
    for d in (3, 2, 1):
        if d >= dim:
            out = F.when(F.size("verts") == d + 1, of(d)).otherwise(out)
    return out


def cell_faces(cells: DataFrame, dim: int) -> DataFrame:
    """(ds, cid, face): every face of a dimension of every cell."""
    return cells.select("ds", "cid", F.explode(_faces(dim)).alias("face"))


def simplices(cells: DataFrame, dim: int) -> DataFrame:
    """(ds, face, star): the distinct faces of a dimension and how many cells have each."""
    return cell_faces(cells, dim).groupBy("ds", "face").agg(F.count("*").alias("star"))


def edges(cells: DataFrame) -> DataFrame:
    """(ds, a, b) with a < b."""
    return cell_faces(cells, 1).select("ds", F.col("face")[0].alias("a"), F.col("face")[1].alias("b")).distinct()


def neighbours(cells: DataFrame) -> DataFrame:
    """(ds, a, b) in both directions."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges(cells).select("ds", F.inline(both))


def star(cells: DataFrame, dim: int) -> DataFrame:
    """(ds, face, cids): the cells around each face of a dimension."""
    return cell_faces(cells, dim).groupBy("ds", "face").agg(F.array_sort(F.collect_list("cid")).alias("cids"))


def link(cells: DataFrame, dim: int) -> DataFrame:
    """(ds, face, links): for each face, what its cells have besides it."""
    own = cells.select("ds", "cid", "verts", F.explode(_faces(dim)).alias("face"))
    return own.groupBy("ds", "face").agg(F.array_sort(F.collect_set(F.array_sort(F.array_except("verts", "face")))).alias("links"))


def cell_neighbours(cells: DataFrame) -> DataFrame:
    """(ds, a, b) of cells that share a facet, in both directions."""
    top = cells.agg(F.max(F.size("verts"))).first()[0] or 2
    f = cell_faces(cells, top - 2)
    g = f.select("ds", "face", F.col("cid").alias("b"))
    return f.withColumnRenamed("cid", "a").join(g, ["ds", "face"]).where("a <> b").select("ds", "a", "b").distinct()


def boundary(cells: DataFrame, dim: int) -> DataFrame:
    """(ds, face): faces of a dimension that lie on a facet with a single cell."""
    top = cells.agg(F.max(F.size("verts"))).first()[0] or 2
    facets = simplices(cells, top - 2).where("star = 1").select("ds", F.monotonically_increasing_id().alias("cid"), F.col("face").alias("verts"))
    if dim == 0:
        return facets.select("ds", F.explode("verts").alias("v")).distinct().select("ds", F.array("v").alias("face"))
    return facets.select("ds", F.col("verts").alias("face")) if dim == top - 2 else cell_faces(facets, dim).select("ds", "face").distinct()


def counts(vertices: DataFrame, cells: DataFrame) -> DataFrame:
    """(ds, dim, n): numbers of simplices of each dimension."""
    out = vertices.groupBy("ds").agg(F.count("*").alias("n")).select("ds", F.lit(0).alias("dim"), "n")
    for d in (1, 2, 3):
        out = out.unionByName(simplices(cells, d).groupBy("ds").agg(F.count("*").alias("n")).select("ds", F.lit(d).alias("dim"), "n"))
    return out


def request(cells: DataFrame, what: str, face: list[int], ds: int = 0) -> DataFrame:
    """A lookup for one simplex: `simplex`, `facet`, `cofacet`, `star` or `link`, as rows (face)."""
    own, wanted = cells.where(F.col("ds") == ds), F.array(*(F.lit(int(v)).cast("long") for v in sorted(face)))
    dim = len(face) - 1
    if what == "simplex":
        return simplices(own, dim).where(F.col("face") == wanted).select("face")
    if what == "facet":
        return simplices(own, dim - 1).where(F.size(F.array_except("face", wanted)) == 0).select("face")
    if what == "cofacet":
        return simplices(own, dim + 1).where(F.size(F.array_except(wanted, "face")) == 0).select("face")
    around = own.where(F.size(F.array_except(wanted, "verts")) == 0)
    if what == "star":
        return around.select(F.array_sort("verts").alias("face"))
    if what == "link":
        return around.select(F.array_sort(F.array_except("verts", wanted)).alias("face")).distinct()
    raise ValueError(what)


def centres(cells: DataFrame, vertices: DataFrame, dim: int) -> DataFrame:
    """(ds, face, x, y, z): the mean of each face's vertices."""
    f = simplices(cells, dim).select("ds", "face", F.explode("face").alias("vid"))
    return f.join(vertices.select("ds", "vid", "x", "y", "z"), ["ds", "vid"]).groupBy("ds", "face").agg(*(F.avg(c).alias(c) for c in "xyz"))


# ---------------------------------------------------------------- regular grids
@dataclass(frozen=True)
class Grid:
    """A regular grid. Adjacency is arithmetic on ids: nothing is stored or shuffled."""

    nx: int
    ny: int = 1
    nz: int = 1
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    periodic: bool = False

    @property
    def size(self) -> tuple[int, int, int]:
        return self.nx, self.ny, self.nz

    def vertices(self, spark: SparkSession, ds: int = 0) -> DataFrame:
        i, j, k = self.indices("vid")
        coords = [(F.lit(o) + c * s).cast("double").alias(n) for n, c, o, s in zip("xyz", (i, j, k), self.origin, self.spacing)]
        return spark.range(self.nx * self.ny * self.nz).withColumnRenamed("id", "vid").select(F.lit(ds).cast("long").alias("ds"), "vid", *coords)

    def indices(self, vid: str) -> tuple[Column, Column, Column]:
        v = F.col(vid)
        return v % self.nx, F.floor(v / self.nx) % self.ny, F.floor(v / (self.nx * self.ny))

    def offsets(self) -> list[tuple[int, int, int]]:
        """The steps to a vertex's neighbours in the Freudenthal triangulation: all of one sign."""
        dims = [n > 1 for n in self.size]
        steps = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1) if (a or b or c) and all(d or not s for s, d in zip((a, b, c), dims))]
        return steps + [tuple(-s for s in step) for step in steps]

    def neighbours(self, vertices: DataFrame) -> DataFrame:
        """(ds, a, b) in both directions for vertices (ds, vid)."""
        i, j, k = self.indices("vid")
        out = vertices.select("ds", "vid", i.alias("_i"), j.alias("_j"), k.alias("_k"), F.explode(F.array(*(F.array(*map(F.lit, s)) for s in self.offsets()))).alias("_s"))
        moved = [F.col(c) + F.col("_s")[n] for n, c in enumerate(("_i", "_j", "_k"))]
        if self.periodic:
            moved = [F.pmod(m, F.lit(n)) for m, n in zip(moved, self.size)]
        out = out.select("ds", F.col("vid").alias("a"), *(m.alias(n) for m, n in zip(moved, ("_i", "_j", "_k"))))
        inside = " and ".join(f"{c} between 0 and {n - 1}" for c, n in zip(("_i", "_j", "_k"), self.size))
        return out.where(inside).select("ds", "a", (F.col("_i") + self.nx * (F.col("_j") + self.ny * F.col("_k"))).cast("long").alias("b")).where("a <> b").distinct()

    def cells(self, spark: SparkSession, ds: int = 0) -> DataFrame:
        """(ds, cid, verts): the simplices along each cube's diagonal, one for each order of its axes."""
        from itertools import permutations

        axes = [a for a, n in enumerate(self.size) if n > 1]
        chains = []
        for order in permutations(axes):
            at, chain = [0, 0, 0], [(0, 0, 0)]
            for a in order:
                at[a] = 1
                chain.append(tuple(at))
            chains.append(chain)
        spans = [(n if self.periodic else n - 1) if n > 1 else 1 for n in self.size]
        cube = spark.range(spans[0] * spans[1] * spans[2]).select(F.col("id"), (F.col("id") % spans[0]).alias("i"), (F.floor(F.col("id") / spans[0]) % spans[1]).alias("j"), F.floor(F.col("id") / (spans[0] * spans[1])).alias("k"))

        def vid(s: tuple[int, int, int]) -> Column:
            c = [F.col(n) + d for n, d in zip("ijk", s)]
            c = [F.pmod(x, F.lit(n)) for x, n in zip(c, self.size)] if self.periodic else c
            return (c[0] + self.nx * (c[1] + self.ny * c[2])).cast("long")

        simplex = F.array(*(F.array(*(vid(s) for s in chain)) for chain in chains))
        return cube.select("id", F.posexplode(simplex).alias("p", "verts")).select(F.lit(ds).cast("long").alias("ds"), (F.col("id") * len(chains) + F.col("p")).alias("cid"), "verts")


def path_cells(vertices: DataFrame, order: str = "ord") -> DataFrame:
    """(ds, cid, verts): the edges of a path through each ds's vertices in an order."""
    from pyspark.sql import Window

    w = Window.partitionBy("ds").orderBy(order)
    out = vertices.select("ds", F.row_number().over(w).alias("n"), F.array("vid", F.lead("vid").over(w)).alias("verts"))
    return out.where("verts[1] is not null").select("ds", (F.col("n") - 1).cast("long").alias("cid"), "verts")
