"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each pivot has an inverted file of the vectors that have it among
their nearest, with its rank there; from the files of a query's own pivots, and no others, Spearman's footrule between the two orders
follows, where a pivot that a list lacks counts as just past its end. The nearest by footrule are reranked by exact distance. A query reads about
length^2 / pivots entries for each vector indexed; vectors in none of its files are not looked at.

All vectors are indexed. The index is dealt by hash to shards of bounded size, each with its inverted files; queries come in
blocks, and every block meets every shard. Equal vectors are one entry with its smallest ids, as many as an answer can hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

PIVOTS = 1024
#: Pivots in a vector's list, and so the files that it is posted in and that a query reads.
LENGTH = 32
SHARD_ROWS = 16_384
QUERY_ROWS = 4096
#: What is reranked of a shard: this share of it, and this many at least.
SHARE, LEAST = 0.15, 256


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, vec): vectors as doubles in bytes; those null, zero, with null or non-finite components, or of another dimension than `dim` are left out.

    Without `dim`, the dimension that most rows have, the smaller on ties.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    if dim is None:
        top = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = top[0] if top else 0
    own = own.where((F.size("v") == dim) & F.expr("forall(v, x -> x is not null)"))

    def pack(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            rows = np.ascontiguousarray(x[good] + 0.0)  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "vec"])

    return own.mapInArrow(pack, "vec_id long, vec binary")


def _orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest `length` pivots of each row, nearest first, ties to the first pivot."""
    length = min(length, len(pivots))
    out = np.empty((len(x), length), np.int32)
    for lo in range(0, len(x), 2048):
        part = x[lo : lo + 2048]
        d = (part**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * part @ pivots.T
        # all as near as the last are looked at, so that ties go to the first pivot
        cut = np.partition(d, length - 1, axis=1)[:, length - 1 : length]
        d[d > cut] = np.inf
        out[lo : lo + 2048] = np.argsort(d, axis=1, kind="stable")[:, :length]
    return out


class InvertedFiles:
    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.length = orders.shape
        self.n = n
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        self.row, self.rank = (by // self.length).astype(np.int32), (by % self.length).astype(np.int32)
        self.at = np.searchsorted(flat[by], np.arange(pivots + 1))

    def shared(self, order: np.ndarray) -> np.ndarray:
        """For each row twice the same constant less its footrule distance to a query's order, halved: length - the larger rank, summed over pivots in both lists. 0 is untouched."""
        out = np.zeros(self.n, np.int64)
        for a, pivot in enumerate(order.tolist()):
            file = slice(self.at[pivot], self.at[pivot + 1])
            out[self.row[file]] += self.length - np.maximum(self.rank[file], a)
        return out

    def nearest(self, order: np.ndarray, most: int, least: int = 1) -> np.ndarray:
        """Rows with the least footrule distance to a query's order, all as near as the last included.

        Only rows in the query's files, if there are `least` of them; else all rows.
        """
        if most >= self.n:
            return np.arange(self.n)
        shared = self.shared(order)
        cut = np.partition(shared, self.n - most)[self.n - most]
        if cut <= 0 and (shared > 0).sum() >= least:
            cut = 1
        return np.flatnonzero(shared >= cut)


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS, length: int = LENGTH, shard_rows: int = SHARD_ROWS, share: float = SHARE, least: int = LEAST, dim: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by Euclidean distance found for rows whose vec_id divides by `every`.

    Nearest first, ties to the smaller vec_id; all candidates if there are fewer. Pivots, at most `pivots`, are the vectors that come first
    by a hash. Null, zero, non-finite and odd-sized vectors and null ids take no part. The k are different vec_ids, never the query's own:
    rows that repeat a vec_id and its vector count once, and of ids with several vectors the nearest two are compared. An empty
    table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = vectors.sparkSession
    rows = written(usable(vectors, dim).distinct(), "vectors")
    first = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    kept = rows.withColumn("n", first).where(F.col("n") <= k + 1)
    classes = written(kept.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    queries = rows.where(F.col("vec_id") % every == 0)
    chosen = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(pivots).collect()
    centres = spark.sparkContext.broadcast(np.array([np.frombuffer(r[0]) for r in chosen]))
    n, n_queries = classes.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // QUERY_ROWS))
    left = classes.select((F.pmod(F.xxhash64("vec", F.lit(3)), F.lit(shards))).alias("shard"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), "vec", "ids")
    right = queries.select(F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), F.pmod(F.xxhash64("vec_id", "vec", F.lit(5)), F.lit(blocks)).alias("block"), "vec_id", "vec")

    def search(own, asked):
        out: list[np.ndarray] = []
        if own.num_rows and asked.num_rows:
            x = np.frombuffer(b"".join(own.column("vec").to_pylist())).reshape(own.num_rows, -1)
            q = np.frombuffer(b"".join(asked.column("vec").to_pylist())).reshape(asked.num_rows, -1)
            lists = own.column("ids").combine_chunks()
            ids, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            names = asked.column("vec_id").to_numpy()
            p = centres.value
            files = InvertedFiles(_orders(x, p, length), len(p))
            for name, v, order in zip(names.tolist(), q, _orders(q, p, length)):
                near = files.nearest(order, max(least, int(share * len(x))), least)
                d = np.sqrt(((x[near] - v) ** 2).sum(1))
                # one more than k, as the query's own class may give nothing else; more where classes share ids
                most = k + 1
                while True:
                    cut = d <= np.partition(d, most - 1)[most - 1] if len(near) > most else np.ones(len(near), dtype=bool)
                    own_at = near[cut]
                    found = np.concatenate([ids[a:b] for a, b in zip(at[own_at], at[own_at + 1])])
                    far = np.repeat(d[cut], at[own_at + 1] - at[own_at])
                    best = np.lexsort((found, far))
                    best = best[found[best] != name]
                    best = best[np.sort(np.unique(found[best], return_index=True)[1])][:k]
                    if len(best) == k or most >= len(near):
                        break
                    most *= 2
                out.append((np.full(len(best), name), found[best], far[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
