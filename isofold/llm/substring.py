"""Exact removal of repeated passages by super-k-mer partitioning.

A window is `window` consecutive words; its minimiser is the least hash among its runs of `mer` words. Consecutive
windows with one minimiser travel as one packed string to the bucket of that minimiser, so equal windows meet in
one bucket, and sorting a bucket's windows finds all but the earliest of each sequence. Bytes are compared before
anything is removed. Two measures keep buckets even: equal packed strings of a map batch are settled there, and
only the earliest travels; runs of words that are frequent in the corpus rank last as minimisers, so that windows
which only touch a frequent passage go elsewhere, and those inside it are equal strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, SpanHash, give_back, slices, text_buffer, word_bounds, written

#: Text that one map step settles at once.
STEP_BYTES = 16_000_000
_TOP = np.uint64(1 << 63)


class _Words:
    """Words of one slice, joined by one space: word w of the slice is joined[begin[w] : begin[w + 1] - 1]."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = word_bounds(buf, offsets)
        self.begin = np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))
        self.joined = np.full(self.begin[-1], 0x20, np.uint8)
        inside = np.ones(self.begin[-1], dtype=bool)
        inside[self.begin[1:] - 1] = False
        self.joined[inside] = buf[~WHITE[buf]]
        self.hashes = SpanHash(self.joined)(self.begin[:-1], self.begin[1:] - 1) if len(self.starts) else np.zeros(0, np.uint64)


def _mers(words: _Words, mer: int) -> np.ndarray:
    """The hash of the run of `mer` words from each word on; runs over a document's end are there too, but no window has them."""
    n = len(words.hashes)
    at = np.arange(max(0, n - mer + 1))
    return SpanHash(words.hashes)(at, at + mer) >> np.uint64(1) if len(at) else np.zeros(0, np.uint64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def _super_kmers(words: _Words, window: int, mer: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word within the slice, number of windows, minimiser) of each super-k-mer of a slice."""
    none = np.zeros(0, np.int64)
    counts = np.diff(words.first) - window + 1
    rows = np.flatnonzero(counts > 0)
    if not len(rows):
        return none, none, none, np.zeros(0, np.uint64)
    rank = _mers(words, mer)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, rank), len(frequent) - 1)
        rank = np.where(frequent[at] == rank, rank | _TOP, rank)
    least = _sliding_min(rank, window - mer + 1)
    n = counts[rows]
    ends = np.cumsum(n)
    row = np.repeat(rows, n)
    start = np.arange(ends[-1]) - np.repeat(ends - n, n) + words.first[row]
    own = least[start]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], np.diff(np.append(first, len(own))), own[first]


def _packed(*parts: np.ndarray | bytes, level: int = 1) -> bytes:
    parts = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), level)


def _unpacked(data: bytes, parts: int) -> list[bytes]:
    raw = zstandard.decompress(data)
    at = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int64, parts)))) + 8 * parts
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def _steps(offsets: np.ndarray, most: int = 0):
    """Slices, in steps of about `most` bytes, or STEP_BYTES."""
    most = most or STEP_BYTES
    step, size = [], 0
    for lo, hi in slices(offsets):
        step.append((lo, hi))
        size += int(offsets[hi] - offsets[lo])
        if size >= most:
            yield step
            step, size = [], 0
    if step:
        yield step


def corpus_profile(docs: DataFrame, mer: int, window: int, share: float = 1 / 1000) -> tuple[int, np.ndarray]:
    """(words in all texts, the frequent runs of `mer` words, sorted).

    A run is frequent if it occurs for more than `share` of the corpus's super-k-mers. One with that share
    has it in some step, so steps report only what is frequent in them: 4 / share hashes at most reach the driver for each
    typical document's run of windows, whatever the corpus's size.
    """
    span = (window - mer + 2) / 2

    def count(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            for step in _steps(offsets):
                found, total = [], 0
                for lo, hi in step:
                    words = _Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    found.append(_mers(words, mer))
                    total += len(words.hashes)
                mers = np.concatenate(found)
                least = max(8, int(share / 4 * total / span))
                bins = (mers & np.uint64((1 << 20) - 1)).astype(np.int64)
                often = np.bincount(bins, minlength=1 << 20)[bins] >= least
                value, n = np.unique(mers[often], return_counts=True)
                value, n = value[n >= least], n[n >= least]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(value, 0).view(np.int64)), pa.array(np.append(n, 0).astype(np.int64)), pa.array(np.append(np.zeros(len(n), np.int64), total))], ["mer", "n", "words"])
                del found, mers, bins, often
            give_back()

    table = written(docs.select("text").mapInArrow(count, "mer long, n long, words long"), "mers")
    total = table.agg(F.sum("words")).first()[0] or 0
    often = table.where("n > 0").groupBy("mer").agg(F.sum("n").alias("n")).where(F.col("n") >= max(16, share / 2 * total / span)).select("mer")
    return total, np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words, joined where they touch."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    # ends as seen so far within a document; documents are set far apart for the running maximum
    _, rank = np.unique(doc, return_inverse=True)
    far = rank.astype(np.int64) << 33
    reach = np.maximum.accumulate(hi + far)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = lo[1:] + far[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1] - far[first]


def repeated_spans(docs: DataFrame, window: int = 20, mer: int = 4, bucket_words: int = 1_000_000) -> DataFrame:
    """(doc_id, lo, hi): spans of words, counted from 0 with hi excluded, that windows occurring earlier cover."""
    if not 1 <= mer <= window:
        raise ValueError("mer must be 1 to window")
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    total, often = corpus_profile(docs, mer, window)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, total // bucket_words)
    frequent = spark.sparkContext.broadcast(often)

    def cut(batches):
        turn = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, offsets = text_buffer(batch.column(1))
            for step in _steps(offsets):
                first: dict[bytes, tuple[int, int, int, int]] = {}
                lost = []
                for lo, hi in step:
                    words = _Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    row, start, n, least = _super_kmers(words, window, mer, frequent.value)
                    raw = words.joined.tobytes()
                    spans = zip(words.begin[start].tolist(), (words.begin[start + n + window - 1] - 1).tolist())
                    where = (start - words.first[row]).tolist()
                    target = (least % np.uint64(buckets)).astype(np.int64).tolist()
                    for (a, b), doc, at, k, bucket in zip(spans, ids[lo + row].tolist(), where, n.tolist(), target):
                        text = raw[a:b]
                        own, seen = (doc, at, k, bucket), first.get(text)
                        if seen is None:
                            first[text] = own
                        elif own[:2] < seen[:2]:
                            first[text] = own
                            lost.append(seen)
                        elif own[:2] > seen[:2]:
                            lost.append(own)
                if not first:
                    continue
                texts = list(first)
                table = np.array(list(first.values()), np.int64).reshape(-1, 4)
                order = np.argsort(table[:, 3], kind="stable")
                table = table[order]
                edges = np.append(np.flatnonzero(np.diff(table[:, 3], prepend=-1)), len(table))
                keys, blocks = [], []
                for a, b in zip(edges[:-1], edges[1:]):
                    keys.append(table[a, 3])
                    # ids as steps from one to the next: documents come in order
                    numbers = (np.diff(table[a:b, 0], prepend=0), table[a:b, 1].astype(np.int32), table[a:b, 2].astype(np.int32))
                    blocks.append(_packed(np.zeros(0, np.int64), *numbers, b"\n".join(texts[i] for i in order[a:b]), level=3))
                if lost:
                    gone = np.array(lost, np.int64)
                    spans = _merged(gone[:, 0], gone[:, 1], gone[:, 1] + gone[:, 2] + window - 1)
                    keys.append(turn % buckets)
                    blocks.append(_packed(np.ones(1, np.int64), np.diff(spans[0], prepend=0), spans[1].astype(np.int32), spans[2].astype(np.int32), b""))
                turn += 1
                del first, texts, table
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "block"])
                del blocks
                give_back()

    def settle(key, table):
        doc, lo, hi = [], [], []
        group = []
        for block in table.column("block"):
            kind, *numbers, text = _unpacked(block.as_py(), 5)
            numbers = [np.cumsum(np.frombuffer(numbers[0], np.int64)), *(np.frombuffer(x, np.int32).astype(np.int64) for x in numbers[1:])]
            if kind:
                doc.append(numbers[0]), lo.append(numbers[1]), hi.append(numbers[2])
            else:
                group.append((*numbers, text))
        if group:
            found = _repeats(group, window)
            doc.append(found[0]), lo.append(found[1]), hi.append(found[1] + window)
        spans = _merged(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, lo, hi)))
        give_back()
        return pa.table([pa.array(x, pa.int64()) for x in spans], ["doc_id", "lo", "hi"])

    sent = docs.mapInArrow(cut, "bucket long, block binary")
    # a task has a few buckets whatever the corpus's size
    tasks = max(partitions, buckets // 4)
    return sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(settle, "doc_id long, lo long, hi long")


def _repeats(group: list[tuple], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of a bucket whose sequence also starts earlier."""
    hashes, docs, starts, begins, ends, raws, base = [], [], [], [], [], [], 0
    for doc, start, n, text in group:
        # super-k-mers are separated by a line feed, which no packed string holds
        buf = np.frombuffer(text, np.uint8)
        cut = np.flatnonzero(buf == 0x0A)
        offsets = np.concatenate(([0], cut + 1, [len(buf)]))
        for a, b in slices(offsets):
            part = buf[offsets[a] : offsets[b]]
            lo, hi, first = word_bounds(part, offsets[a : b + 1] - offsets[a])
            words = SpanHash(part)(lo, hi)
            m = n[a:b]
            k = np.repeat(np.arange(b - a), m)
            shift = np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m)
            w = first[k] + shift
            hashes.append(SpanHash(words)(w, w + window))
            docs.append(doc[a:b][k]), starts.append(start[a:b][k] + shift)
            begins.append(base + offsets[a] + lo[w]), ends.append(base + offsets[a] + hi[w + window - 1])
        raws.append(text)
        base += len(text)
    raw = b"".join(raws)
    hashes, docs, starts, begins, ends = (np.concatenate(x) for x in (hashes, docs, starts, begins, ends))
    order = np.lexsort((starts, docs, hashes))
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return docs[:0], starts[:0]
    head = np.zeros(len(order), np.int64)
    head[1:] = np.where(same, 0, np.arange(1, len(order)))
    head = np.maximum.accumulate(head)
    at = np.flatnonzero(np.append(False, same))
    own, top = order[at], order[head[at]]
    equal = np.fromiter((raw[a:b] == raw[c:d] for a, b, c, d in zip(begins[own].tolist(), ends[own].tolist(), begins[top].tolist(), ends[top].tolist())), bool, len(at))
    gone = equal & ((docs[own] != docs[top]) | (starts[own] != starts[top]))
    if not equal.all():  # one hash, several sequences: settled by their bytes
        keep = ~np.isin(head[at], head[at][~equal])
        gone &= keep
        extra = []
        for h in np.unique(head[at][~equal]):
            least: dict[bytes, tuple[int, int]] = {}
            for i in order[head == h]:
                where = (int(docs[i]), int(starts[i]))
                if least.setdefault(raw[begins[i] : ends[i]], where) != where:
                    extra.append(i)
        own = np.concatenate((own[gone], np.array(extra, np.int64)))
        return docs[own], starts[own]
    return docs[own[gone]], starts[own[gone]]


def _cleaned(docs: DataFrame, window: int, mer: int, bucket_words: int, schema: str, make) -> DataFrame:
    spans = repeated_spans(docs, window, mer, bucket_words)
    gathered = spans.groupBy(F.col("doc_id").alias("span_doc")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else squeeze(t) for t in texts.to_pylist()], pa.binary())], ["doc_id", "text"])
            give_back()

    # texts travel to their spans compressed
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, "doc_id long, text binary")
    joined = own.join(gathered, own["doc_id"] == gathered["span_doc"], "left").select("doc_id", "text", "spans")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [b"" if t is None else unpack(t) for t in batch.column(1).to_pylist()]
            buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
            spans = batch.column(2)
            listed = np.diff(spans.offsets.to_numpy()) if len(spans) else np.zeros(0, np.int64)
            listed[~spans.is_valid().to_numpy(zero_copy_only=False)] = 0
            flat = spans.flatten()
            low, high = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.concatenate(([0], np.cumsum(listed)))
            for lo, hi in slices(offsets):
                words = _Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row = np.repeat(np.arange(hi - lo), listed[lo:hi])
                size = np.diff(words.first)
                marks = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(marks, words.first[row] + np.minimum(low[at[lo] : at[hi]], size[row]), 1)
                np.add.at(marks, words.first[row] + np.minimum(high[at[lo] : at[hi]], size[row]), -1)
                gone = np.cumsum(marks[:-1]) > 0
                removed = np.concatenate(([0], np.cumsum(gone)))
                raw = words.joined[np.repeat(~gone, np.diff(words.begin))].tobytes()
                kept = np.concatenate(([0], np.cumsum(np.where(gone, 0, np.diff(words.begin)))))[words.first]
                texts = [raw[a : max(a, b - 1)] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist())]
                yield make(batch.column(0).slice(lo, hi - lo), size, np.diff(removed[words.first]), texts)
            give_back()

    return joined.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = 20, mer: int = 4, bucket_words: int = 1_000_000) -> DataFrame:
    """(doc_id, text, n_words, n_removed): kept words joined by one space.

    A word goes if a window that covers it also starts earlier, by (doc_id, start), anywhere in the input. Null,
    empty and blank texts have no words; documents of fewer than `window` words keep all. Rows with a null doc_id lose
    nothing and make none lose. Rows that repeat a doc_id are one document: a window is never a
    repeat of that at its own place, and removals go by place. An empty table gives an empty result; other columns are ignored.
    """

    def make(ids, n_words, n_removed, texts):
        return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words), pa.array(n_removed)], ["doc_id", "text", "n_words", "n_removed"])

    return _cleaned(docs, window, mer, bucket_words, "doc_id long, text string, n_words long, n_removed long", make)


def op3_substring_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As without_repeats(), with the kept text's digest in its place."""

    def make(ids, n_words, n_removed, texts):
        digests = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
        return pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_removed), digests], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _cleaned(docs, 20, 4, 1_000_000, "doc_id long, n_words long, n_removed long, kept_sha256 string", make)


SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, s, array_to_string(w[s:s + 19], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
e AS (SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY g ORDER BY r, s) AS k FROM g) WHERE k > 1),
x AS (SELECT DISTINCT r, unnest(range(s, s + 20)) AS p FROM e),
n AS (SELECT r, count(*) AS n_removed FROM x GROUP BY r),
k AS (SELECT t.r, string_agg(t.x, ' ' ORDER BY t.p) AS kept FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) t LEFT JOIN x ON x.r = t.r AND x.p = t.p WHERE x.p IS NULL GROUP BY t.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
