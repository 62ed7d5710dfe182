"""Alignment of two tokenizers' tokens over the same bytes, and how often the corpus links their ids.

Tokens are intervals of bytes. Those of B are a static index, sorted starts and ends; bisection finds for each A token the B tokens that it overlaps, and where
the B tokens of one A token end before those of the next begin, no token spans the gap: a group ends. Neither tokenizer has a token that goes on over a
single space before a word, so a text falls into chunks there, and a chunk that occurs often is encoded and aligned once.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, slices, text_buffer, written

SLICE_BYTES = 2_000_000
TOKENIZERS = "/opt/tokenizers"
#: Ids of B take so many bits of a pair, A's those above.
B_BITS = 32
#: A chunk ends before a space that has another character before it and no white space behind it. Letters beyond Latin and all signs beyond ASCII don't end one: some are white space.
_CUT = re.compile("(?<=[^ ]) (?=[!-~À-߿䀀-\U0010ffff])")
#: What is kept in a task: so many chunks of so many characters on average.
CHUNK_CHARS, CHUNKS = 40, 200_000


# ---------------------------------------------------------------- vocabularies
def byte_level_table() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones of Latin-1 stand for themselves, the others for those from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the tokenizers library, special tokens being plain text.

    If its ids are its merges' ranks and it splits by the usual pattern, tiktoken encodes the same vocabulary: the same ids, several times as fast.
    """

    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def __init__(self, path: str, quick: bool = True):
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        table, special = byte_level_table(), {t["id"]: t["content"] for t in told["added_tokens"]}
        plain = {i: bytes(table[c] for c in t) for t, i in told["model"]["vocab"].items() if i not in special}
        n = max([*plain, *special]) + 1
        self.bytes = [plain.get(i, special.get(i, "").encode()) for i in range(n)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        ranked = all(told["model"]["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(plain) == 256 + len(merges)
        split = told["pre_tokenizer"]
        usual = split["type"] == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and told["normalizer"] is None
        if quick and ranked and usual:
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks={b: i for i, b in plain.items()}, special_tokens={})
            self.encode = lambda texts: [own.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            own.no_truncation(), own.no_padding()
            self.encode = lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a sentencepiece model, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [own.id_to_piece(i) for i in range(len(own))]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        #: Whether no piece has a space behind another character.
        self.chunked = not any(re.search("[^▁]▁", p) for p in pieces)
        self.encode = lambda texts: own.encode(texts, num_threads=1)


@functools.lru_cache(2)
def _pair(a_file: str, b_file: str) -> Aligner:
    return Aligner(ByteLevel(a_file), Pieces(b_file))


# ---------------------------------------------------------------- intervals
def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token) of two tilings of the same bytes, given by where their tokens end; groups count from 0."""
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_starts, b_starts = (np.concatenate(([0], e[:-1])) for e in (a_ends, b_ends))
    # stabbing queries on the sorted ends: of each A token its first B token and the one behind its last
    first = np.searchsorted(b_ends, a_starts, "right")
    behind = np.searchsorted(b_starts, a_ends, "left")
    of_a = np.concatenate(([0], np.cumsum(first[1:] >= behind[:-1])))
    # a B token lies in the group of any A token that it overlaps
    return of_a, of_a[np.searchsorted(a_ends, b_starts, "right")]


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, and so on."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - count - begin, count)


def _same(texts: list[str], ia: list[list[int]], ib: list[list[int]], a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether the tokens' bytes, joined, are each text's own with a space before it."""
    own = [b" " + t.encode() for t in texts]
    found = [[b"".join(map(table.__getitem__, x)) for x in ids] for ids, table in ((ia, a), (ib, b))]
    return np.fromiter((x == y == z for x, y, z in zip(own, *found)), bool, len(own))


def _told(flat_a: np.ndarray, flat_b: np.ndarray, ga: np.ndarray, gb: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """Groups as text, a1,a2|b1;a3|b2,b3, of every chunk of so many tokens: digits and signs in a row of bytes for each token."""
    n = len(flat_a) + len(flat_b)
    if not n:
        return [b""] * len(tokens)
    # a group's A tokens, then its B tokens, group by group
    at_a = np.arange(len(flat_a)) + (np.cumsum(in_b) - in_b)[ga]
    at_b = np.arange(len(flat_b)) + np.cumsum(in_a)[gb]
    ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = flat_a, flat_b
    ends = np.cumsum(in_a + in_b)
    sign[ends - in_b - 1], sign[ends - 1] = ord("|"), ord(";")
    width = len(str(int(ids.max())))
    size = np.ones(n, np.int64)
    for k in range(1, width):
        size += ids >= 10**k
    text = np.zeros((n, width + 1), np.uint8)
    for k in range(width):
        # the digit of place k from the left
        text[:, k] = 48 + ids // 10 ** np.maximum(size - 1 - k, 0) % 10
    text[np.arange(n), size] = sign
    raw = text[np.arange(width + 1) <= size[:, None]].tobytes()
    last = np.concatenate(([0], np.cumsum(size + 1)))[np.concatenate(([0], np.cumsum(tokens)))].tolist()
    return [raw[x : max(x, y - 1)] for x, y in zip(last[:-1], last[1:])]


class Chunks:
    """Chunks encoded and aligned: numbers of each, its digest text, and its linked pairs of ids with how often each is linked."""

    def __init__(self, a: ByteLevel, b: Pieces, texts: list[str]):
        ia, ib = a.encode([" " + t for t in texts]), b.encode(texts)
        self.fits = _same(texts, ia, ib, a.bytes, b.bytes)
        if not self.fits.all():
            # chunks that don't fit have no tokens, nor has any text with one
            ia, ib = ([x if f else [] for x, f in zip(ids, self.fits)] for ids in (ia, ib))
        na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ia, ib))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ia, na), (ib, nb)))
        long_a, long_b = (np.fromiter(map(len, t.bytes), np.int64, len(t.bytes)) for t in (a, b))
        ga, gb = groups(np.cumsum(long_a[flat_a]), np.cumsum(long_b[flat_b]))
        n_groups = int(ga[-1]) + 1 if len(ga) else 0
        pa_, pb_ = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
        chunk_of_a = np.repeat(np.arange(len(texts)), na)
        first = np.concatenate(([True], ga[1:] != ga[:-1])) if len(ga) else np.zeros(0, bool)
        chunk = chunk_of_a[first]  # of each group
        self.na, self.nb = na, nb
        self.groups = np.bincount(chunk, minlength=len(texts))
        self.links = np.bincount(chunk, weights=(pa_ * pb_).astype(float), minlength=len(texts)).astype(np.int64) if n_groups else np.zeros(len(texts), np.int64)
        self.told = _told(flat_a, flat_b, ga, gb, pa_, pb_, na + nb)
        self.first, self.pair, self.times = self._pairs(len(texts), chunk, flat_a, flat_b, pa_, pb_)

    @staticmethod
    def _pairs(n, chunk, flat_a, flat_b, pa_, pb_, most: int = 4_000_000):
        """(first, pair, times): chunk c has the pairs first[c] to first[c + 1], each so often."""
        at_a, at_b = np.cumsum(pa_) - pa_, np.cumsum(pb_) - pb_
        small = pa_ * pb_ <= most
        g = np.flatnonzero(small)
        # every A token of a group meets every B token of it
        a_of = _spread(at_a[g], pa_[g])
        group = np.repeat(g, pa_[g])
        b_of = _spread(at_b[group], pb_[group])
        pair = (np.repeat(flat_a[a_of], pb_[group]) << B_BITS) | flat_b[b_of]
        owner = np.repeat(chunk[group], pb_[group])
        times = np.ones(len(pair), np.int64)
        for i in np.flatnonzero(~small).tolist():  # a group of very many tokens: distinct ids only
            ua, ca = np.unique(flat_a[at_a[i] : at_a[i] + pa_[i]], return_counts=True)
            ub, cb = np.unique(flat_b[at_b[i] : at_b[i] + pb_[i]], return_counts=True)
            pair = np.concatenate((pair, ((ua[:, None] << B_BITS) | ub).ravel()))
            times = np.concatenate((times, (ca[:, None] * cb).ravel()))
            owner = np.concatenate((owner, np.full(len(ua) * len(ub), chunk[i])))
        owner, pair, times = _summed(owner, pair, times)
        return np.searchsorted(owner, np.arange(n + 1)), pair, times


def _summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])))) if len(owner) else np.zeros(0, np.int64)
    return owner[new], pair[new], np.add.reduceat(times, new) if len(new) else times


class Aligner:
    """Aligns texts chunk by chunk, and keeps what it learnt of chunks, up to CHUNKS of them and so many characters."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.store = 0, Chunks(self.a, self.b, [])

    def _learn(self, chunks: dict[str, None]) -> None:
        if len(self.known) > CHUNKS or self.chars > CHUNKS * CHUNK_CHARS:
            self._forget()
        fresh = [c for c in chunks if c not in self.known]
        if fresh:
            self.store = _together(self.store, Chunks(self.a, self.b, fresh))
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.chars += sum(map(len, fresh))

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """([n_a, n_b, n_groups, n_links], digests, first, pairs, times): text i has the pairs first[i] to first[i + 1], each linked so many times."""
        cut = [(_CUT.split(t) if self.b.chunked else [t]) if t else [] for t in texts]
        self._learn(dict.fromkeys(chain.from_iterable(cut)))
        s, n = self.store, np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        text = np.repeat(np.arange(len(cut)), n)
        fits = n > 0
        fits[text[~s.fits[at]]] = False
        begin = np.concatenate(([0], np.cumsum(n)))
        numbers = []
        for x in (s.na, s.nb, s.groups, s.links):
            total = np.concatenate(([0], np.cumsum(x[at])))
            numbers.append(np.where(fits, total[begin[1:]] - total[begin[:-1]], 0))
        told = [hashlib.sha256(b";".join(map(s.told.__getitem__, at[begin[i] : begin[i + 1]].tolist()))).hexdigest() if f else "" for i, f in enumerate(fits.tolist())]
        # how often a text has a chunk, then the chunk's pairs
        code, often = np.unique((text * (len(s.na) + 1) + at)[fits[text]], return_counts=True)
        owner, chunk = code // (len(s.na) + 1), code % (len(s.na) + 1)
        size = s.first[chunk + 1] - s.first[chunk]
        where = _spread(s.first[chunk], size)
        owner, pair, times = _summed(np.repeat(owner, size), s.pair[where], s.times[where] * np.repeat(often, size))
        return numbers, told, np.searchsorted(owner, np.arange(len(cut) + 1)), pair, times


def _together(one: Chunks, two: Chunks) -> Chunks:
    for k in ("fits", "na", "nb", "groups", "links", "pair", "times"):
        setattr(two, k, np.concatenate((getattr(one, k), getattr(two, k))))
    two.told = one.told + two.told
    two.first = np.concatenate((one.first[:-1], two.first + one.first[-1]))
    return two


# ---------------------------------------------------------------- tables
def _encoded(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _pair(a_file, b_file)
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, SLICE_BYTES):
                numbers, told, first, pair, times = align(batch.column(1).slice(lo, hi - lo).to_pylist())
                links = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], ["pair", "times"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, numbers), pa.array(told, pa.string()), links], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
                give_back()

    return run


def token_groups(docs: DataFrame, a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """(doc_id, group, begin, end, a_ids, b_ids): the groups of every text in order, with byte ranges in the text with a space before it. Texts without tokens have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _pair(a_file, b_file)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = (" " + text).encode() if text else b""
                (ia,), (ib,) = (align.a.encode([" " + text]), align.b.encode([text])) if text else ([[]], [[]])
                if not own or b"".join(align.a.bytes[i] for i in ia) != own or b"".join(align.b.bytes[i] for i in ib) != own:
                    continue
                ends = [np.cumsum([len(t.bytes[i]) for i in ids]) for t, ids in ((align.a, ia), (align.b, ib))]
                ga, gb = groups(*ends)
                n = int(ga[-1]) + 1
                cut_a, cut_b = np.searchsorted(ga, np.arange(n + 1)), np.searchsorted(gb, np.arange(n + 1))
                end = ends[0][cut_a[1:] - 1]
                lists = [pa.ListArray.from_arrays(pa.array(c.astype(np.int32)), pa.array(ids, pa.int32())) for c, ids in ((cut_a, ia), (cut_b, ib))]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(np.arange(n)), pa.array(np.concatenate(([0], end[:-1]))), pa.array(end), *lists], ["doc_id", "group", "begin", "end", "a_ids", "b_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, group long, begin long, end long, a_ids array<int>, b_ids array<int>")


def aligned(docs: DataFrame, a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model", broadcast_rows: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(texts (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), pairs (a_id, b_id, docs, best)), with a row for each row of docs and each linked pair of ids.

    Tokens of A and B over space+text cut it where both end; all tokens of a group are linked. docs is in how many rows a pair is linked, best whether no other of its
    A id is in more. Null and empty texts, and those whose tokens aren't the text's own bytes, have no tokens: zeros and ''. Rows that repeat an id count each, ids may be
    null; an empty table gives empty ones. Other columns are ignored. Files are read where tasks run, by paths that all of them have.

    Texts are encoded once, and their pairs kept in the shared folder. Of all pairs the `broadcast_rows` most frequent at most are joined by broadcast (as numbers
    add up to their total, no more have over 1/broadcast_rows of it), the others by a shuffle in which none has more than that share.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: bigint, times: bigint>>"
    done = written(own.mapInArrow(_encoded(a_file, b_file), schema).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = done.select("row", F.explode("links").alias("x")).select("row", "x.pair", "x.times")
    counts = written(links.groupBy("pair").agg(F.count("*").alias("docs")), "counts")
    # a row for each A id that occurs: the vocabulary's size at most
    most = counts.groupBy(F.shiftright("pair", B_BITS).alias("a_id")).agg(F.max("docs").alias("most"))
    pairs = counts.withColumn("a_id", F.shiftright("pair", B_BITS)).join(F.broadcast(most), "a_id")
    pairs = written(pairs.select("pair", "a_id", F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b_id"), "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")
    n_pairs, total = pairs.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    of = pairs.select("pair", "docs", "best")
    if n_pairs <= broadcast_rows:
        met = links.join(F.broadcast(of), "pair")
    else:
        top = F.col("docs") * broadcast_rows > total
        often = F.broadcast(of.where(top))
        met = links.join(often, "pair").unionByName(links.join(often, "pair", "left_anti").join(of.where(~top), "pair").select("pair", "row", "times", "docs", "best"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    out = done.drop("links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), pairs.drop("pair")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))[0]
