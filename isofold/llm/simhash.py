"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64 bits. Two that differ in at most r bits agree to r // 2 bits in one of
their halves of 32, so a forest of two vantage-point trees, one over each half, is searched with radius
r // 2, and every pair that meets is verified on all 64 bits. A tree splits its fingerprints by
Hamming distance to a vantage point at the median; by the triangle inequality a partner within the
radius of a fingerprint outside the ball lies inside or just beyond the boundary, so the outer
ones within the radius of the boundary are copied to the inner shard, and a branch is pruned where
the bound excludes it. The upper tree is fitted on a bounded sample and routes all fingerprints to
shards; each shard builds its own tree below. A shard returns a spanning star for each group
that it found, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import WHITE, give_back, lowered, slices, text_buffer, text_key, word_bounds, written

SHINGLE_SEED = 42


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SHINGLE_SEED)], np.uint64)
    return np.array([digest(b" ".join(words[i : i + size]), SHINGLE_SEED) for i in range(len(words) - size + 1)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _slice_fingerprints(buf: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the rows of one slice."""
    buf = lowered(buf)
    starts, ends, first = word_bounds(buf, offsets)
    counts = np.diff(first)
    if not len(starts):
        return np.zeros(len(counts), np.uint64)
    lengths = ends - starts
    # words of the slice with one space after each: every shingle is then one span
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    joined = np.full(begin[-1], 0x20, np.uint8)
    inside = np.ones(begin[-1], dtype=bool)
    inside[begin[1:] - 1] = False
    joined[inside] = buf[~WHITE[buf]]
    n = np.where(counts > size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(counts)), n)
    word = first[row] + np.arange(at[-1]) - at[row]
    lo, hi = begin[word], begin[word + np.minimum(size, counts[row])] - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SHINGLE_SEED) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(n)
    ones = np.empty((len(full), 64), np.int64)
    bits = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        # a byte's eight bits at eight bits each in one 64-bit word would overflow past 255: spread over two of 16 bits
        for half in range(2):
            spread = _SPREAD[half][bits[:, byte]]
            step, total = 4096, np.zeros((len(full), 4), np.int64)
            if n.max() < 65536:
                sums = np.add.reduceat(spread, at[full])
                total = (sums[:, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(16))) & np.uint64(0xFFFF)
            else:
                for k, r in enumerate(full):
                    for a in range(at[r], at[r + 1], step):
                        s = spread[a : min(a + step, at[r + 1])].sum(dtype=np.uint64)
                        total[k] += ((s >> (np.arange(4, dtype=np.uint64) * np.uint64(16))) & np.uint64(0xFFFF)).astype(np.int64)
            ones[:, 8 * byte + 4 * half : 8 * byte + 4 * half + 4] = total
    out[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


#: Bits 0-3 and 4-7 of a byte, each in a lane of 16 bits.
_SPREAD = [np.array([sum(((b >> (4 * half + i)) & 1) << (16 * i) for i in range(4)) for b in range(256)], np.uint64) for half in range(2)]


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """(key, fp long): the 64-bit SimHash of each whole text; null, empty and blank texts get 0. One pass, no shuffle. `also`: further columns."""
    also = also or {}
    own = docs.select(F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("doc_id"), *(c.alias(n) for n, c in also.items()))
    names = [*own.columns[1:], "fp"]

    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            out = np.zeros(batch.num_rows, np.uint64)
            for lo, hi in slices(offsets):
                out[lo:hi] = _slice_fingerprints(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out.view(np.int64))], names)
            give_back()

    return own.mapInArrow(run, own.drop("text").schema.add("fp", "long"))


# ---------------------------------------------------------------- trees
class VantageTree:
    """Nodes in arrays: vantage point and radius of the ball; children below zero are shards (~shard)."""

    def __init__(self, sample: np.ndarray, radius: int, most: int, seed: int, other: np.ndarray | None = None, wide: int = 0):
        """sample: 32-bit halves of fingerprints; a node with at most `most` of them is a shard.

        Where many have halves so alike that no vantage point parts them, a tree over their `other` halves, searched with radius `wide`, does.
        """
        self.radius, rng = radius, np.random.default_rng(seed)
        points, cuts, inner, outer = [], [], [], []
        self.shards, self.nested = 0, {}
        todo = [(np.arange(len(sample)), -1, False)]
        while todo:
            rows, parent, is_outer = todo.pop()
            part = sample[rows]
            best = self.split(part, radius, rng) if len(part) > most else None
            if best is None:
                node, below = ~self.shards, 1
                if len(part) > most and other is not None:
                    nested = VantageTree(other[rows], wide, most, seed + 1)
                    if nested.shards > 1:
                        self.nested[self.shards], below = nested, nested.shards
                self.shards += below
            else:
                node = len(points)
                vantage, cut, d = best
                points.append(vantage), cuts.append(cut), inner.append(0), outer.append(0)
                todo.append((rows[d > cut], node, True))
                todo.append((rows[d <= cut + radius], node, False))
            if parent >= 0:
                (outer if is_outer else inner)[parent] = node
        self.points, self.cuts = np.array(points, np.uint32), np.array(cuts, np.int64)
        self.inner, self.outer = np.array(inner, np.int64), np.array(outer, np.int64)

    @staticmethod
    def split(part: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 8):
        """The vantage point of a few that leaves the smallest larger side; None if none makes it smaller by a tenth."""
        best, least = None, 0.9 * len(part)
        for k in range(tries):
            vantage = part[rng.integers(len(part))] ^ np.uint32(0 if k % 2 else rng.integers(2**32, dtype=np.uint64))
            d = np.bitwise_count(part ^ vantage).astype(np.int64)
            for cut in {int(np.median(d)), int(np.median(d)) - radius}:
                larger = max((d <= cut + radius).sum(), (d > cut).sum())
                if larger < least:
                    best, least = (vantage, cut, d), larger
        return best

    def route(self, values: np.ndarray, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index, shard) of every shard that each value belongs to, boundary copies included. others: the other halves, where the tree has any."""
        found_i, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.points):
            found_i, found_s = [np.arange(len(values))], [np.zeros(len(values), np.int64)]
        index, node = (np.arange(len(values)), np.zeros(len(values), np.int64)) if len(self.points) else (found_s[0][:0], found_s[0][:0])
        while len(index):
            d = np.bitwise_count(values[index] ^ self.points[node]).astype(np.int64)
            near, far = d <= self.cuts[node] + self.radius, d > self.cuts[node]
            index = np.concatenate((index[near], index[far]))
            node = np.concatenate((self.inner[node[near]], self.outer[node[far]]))
            leaf = node < 0
            found_i.append(index[leaf]), found_s.append(~node[leaf])
            index, node = index[~leaf], node[~leaf]
        index, shard = np.concatenate(found_i), np.concatenate(found_s)
        for first, nested in self.nested.items():
            mine = shard == first
            below, deeper = nested.route(others[index[mine]])
            index, shard = np.concatenate((index[~mine], index[mine][below])), np.concatenate((shard[~mine], first + deeper))
        return index, shard


def halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (fp & np.uint64(0xFFFFFFFF)).astype(np.uint32), (fp >> np.uint64(32)).astype(np.uint32)


def linked_stars(fp: np.ndarray, ids: np.ndarray, half: int, bits: int, leaf: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) for one shard: each member of a group of linked fingerprints with the group's smallest id."""
    n = len(fp)
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    own, other = halves(fp)[half], halves(fp)[1 - half]
    index, shard = VantageTree(own, bits // 2, leaf, 7, other, bits).route(own, other)
    order = np.argsort(shard, kind="stable")
    index, cuts = index[order], np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(index, cuts):
        if len(part) <= 1024:
            close = np.bitwise_count(fp[part][:, None] ^ fp[part][None, :]) <= bits
            part = part[close.sum(1) > 1]
        rest = part
        # each search takes what it reaches out of the rest: a dense group costs a pass, not its pairs
        while len(rest) > 1:
            at, rest = rest[:1], rest[1:]
            while len(at) and len(rest):
                near = np.zeros(len(rest), dtype=bool)
                for x in at:
                    hit = (np.bitwise_count(fp[rest] ^ fp[x]) <= bits) & ~near
                    for y in rest[hit]:
                        parent[root(int(y))] = root(int(x))
                    near |= hit
                at, rest = rest[near], rest[~near]
    roots = np.array([root(i) for i in range(n)])
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, roots, ids)
    a, keep = least[roots], least[roots] != ids
    return a[keep], ids[keep]


def near_links(classes: DataFrame, bits: int = 3, shard_rows: int = 1024, sample_per_shard: int = 32, most_shards: int = 1 << 17) -> DataFrame:
    """Edges (a, b) between reps of distinct fingerprints (fp, rep) that join all that differ in at most `bits` bits.

    The tree's sample, sample_per_shard fingerprints for a shard, is a thirty-second of the rows and at most
    most_shards * sample_per_shard of them (32 MB); it decides only where the shards' borders run.
    """
    if not 0 <= bits <= 15:
        raise ValueError("bits must be 0 to 15")
    spark: SparkSession = classes.sparkSession
    n = classes.count()
    shards = max(1, min(most_shards, n // shard_rows))
    share = min(1.0, shards * sample_per_shard / max(1, n))
    picked = classes.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))) if shards > 1 else classes.limit(0)
    sample = picked.select("fp").limit(2 * most_shards * sample_per_shard).toArrow().column("fp").to_numpy().astype(np.int64).view(np.uint64)
    low, high = halves(sample)
    trees = [VantageTree(x, bits // 2, 2 * sample_per_shard, 11 + k, y, bits) for k, (x, y) in enumerate(((low, high), (high, low)))]
    shared = spark.sparkContext.broadcast(trees)
    first = trees[0].shards

    def route(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values = halves(fp)
            for half, tree in enumerate(shared.value):
                index, shard = tree.route(values[half], values[1 - half])
                yield pa.RecordBatch.from_arrays([pa.array(shard + half * first), pa.array(fp[index].view(np.int64)), batch.column(1).take(pa.array(index))], ["shard", "fp", "rep"])

    def search(key, table):
        fp, ids = table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy()
        a, b = linked_stars(fp, ids, int(key[0].as_py() >= first), bits)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    routed = classes.select("fp", "rep").mapInArrow(route, "shard long, fp long, rep long")
    return routed.groupBy("shard").applyInArrow(search, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, bits: int = 3, also: dict[str, Column] | None = None, **options) -> DataFrame:
    """(doc_id, fp long, component_id): documents whose fingerprints are linked, directly or through others.

    component_id is the smallest doc_id reachable. Equal fingerprints are one class from the start, so
    copies cost one row. A row whose doc_id is null links nothing; it gets its fingerprint's component if
    another document has that fingerprint, else null. Rows that repeat a doc_id are each returned, judged by their own
    text: an id doesn't link the texts that stand under it. An empty table gives an empty result; columns beside doc_id and text are ignored.
    """
    fps = written(fingerprints(docs, shingle, also=also), "simhash")
    named = grouped(fps.where("doc_id is not null"), bits, **options).select("fp", F.col("rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id", *(also or ()))


def grouped(fps: DataFrame, bits: int = 3, **options) -> DataFrame:
    """(fp, group, rep): the distinct fingerprints of (doc_id, fp), each with its group of linked ones and the smallest doc_id in the group."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(near_links(classes.select("fp", F.col("fp").alias("rep")), bits, **options))
    linked = written(classes.join(found, classes["fp"] == found["node"]).select("fp", F.col("component").alias("group"), "rep"), "linked")
    least = linked.groupBy(F.col("group").alias("of")).agg(F.min("rep").alias("least"))
    linked = linked.join(least, F.col("group") == F.col("of")).select("fp", "group", "least")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"), F.coalesce("least", "rep").alias("rep"))


def copies(docs: DataFrame, shingle: int = 3, bits: int = 3, **options) -> tuple[DataFrame, DataFrame]:
    """(gone, repeated), both (doc_id, text_key): rows that aren't their group's one, and those that are but stand there more than once.

    Rows are documents, whatever their ids: a group keeps the row with the smallest doc_id, null ids last, and of several under that id
    the one whose text_key sorts first.
    """
    fps = written(fingerprints(docs, shingle, also={"text_key": text_key(F.col("text"))}), "simhash")
    group = written(grouped(fps, bits, **options).select("fp", "group"), "group")
    rank = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")
    first = fps.groupBy("fp").agg(F.min(rank).alias("first")).join(group, "fp").groupBy("group").agg(F.min("first").alias("first"))
    judged = fps.join(group.join(first, "group").select("fp", "first"), "fp")
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    judged = written(judged.groupBy("doc_id", "text_key", chosen.alias("chosen")).agg(F.count("*").alias("n")), "judged")
    return judged.where("not chosen").select("doc_id", "text_key"), judged.where("chosen and n > 1").select("doc_id", "text_key")


def op2_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_groups(docs, shingle=3, bits=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
