"""Document likelihood over a lattice of subwords.

The pieces come from an existing vocabulary file, whose scores rank them and give the first weights; the words of
the corpus re-estimate those in one pass of expectation-maximisation. A word's probability is the sum over all its
segmentations, by the forward recursion in log space, and so a document's marginal is the product over its words (a
piece never holds a word's border): that is `lattice_score`. For `score` a word that occurs in training is also an arc of the lattice by itself: its count, less
a discount D, over all tokens; what the discounts set free goes to the segmentations, so all sums to one.

Texts are taken in steps of some MB. A step lists its words once, with its documents' counts of them, packed, beside. The steps' words are
summed to the corpus's vocabulary, where each word is worked out once; the results are joined to the steps' lists and
meet their step's documents. A frequent word has one row for each step, an end is counted with its document, and nothing gathers more than a step.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, give_back, lowered, slices, text_buffer, word_bounds, written
from .substring import _packed, _steps, _unpacked

#: A mark before each word, as the vocabulary has it.
MARK = "▁".encode()
_TABLE_BITS = 21
#: Text of a step, and words of a row of its list.
LIST_BYTES, LISTED = 8_000_000, 20_000


# ---------------------------------------------------------------- vocabulary
@dataclass
class Pieces:
    """Byte strings with log-probabilities, and a table that finds a piece by hash. Index len(texts) is a document's end."""

    texts: list[bytes]
    logp: np.ndarray
    hashes: np.ndarray
    slots: np.ndarray
    #: The lengths that pieces have.
    steps: list[int] = field(init=False)

    def __post_init__(self):
        self.steps = sorted({len(t) for t in self.texts})

    @classmethod
    def of(cls, texts: list[bytes], logp: np.ndarray) -> Pieces:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        hashes = SpanHash(raw)(at[:-1], at[1:])
        slots = np.full(1 << _TABLE_BITS, -1, np.int32)
        for i, h in enumerate(hashes.tolist()):
            k = h & ((1 << _TABLE_BITS) - 1)
            while slots[k] >= 0:
                k = (k + 1) & ((1 << _TABLE_BITS) - 1)
            slots[k] = i
        return cls(texts, logp, hashes, slots)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        mask = (1 << _TABLE_BITS) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        out = self.slots[at]
        miss = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        while len(miss):
            at[miss] = (at[miss] + 1) & mask
            out[miss] = self.slots[at[miss]]
            miss = miss[(out[miss] >= 0) & (self.hashes[out[miss]] != h[miss])]
        return out


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece file that may stand in a word, weighted by their rank among its scores; and all 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i).encode()
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or MARK in text[1:]:
            continue
        ranked.append((-model.get_score(i), text))
    ranked.sort()
    known = {t for _, t in ranked}
    texts = [t for _, t in ranked] + [bytes([b]) for b in range(256) if bytes([b]) not in known]
    weight = np.concatenate((1 / (np.arange(len(ranked)) + 10.0), np.full(len(texts) - len(ranked), 1 / (len(ranked) + 10.0))))
    end = weight.sum() / 500
    return Pieces.of(texts, np.log(np.append(weight, end) / (weight.sum() + end)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- lattice
class _Lattice:
    """All pieces within a set of words of about equal length."""

    def __init__(self, buf: np.ndarray, hashes: SpanHash, starts: np.ndarray, ends: np.ndarray, pieces: Pieces):
        self.n, self.length = len(starts), ends - starts
        self.most, self.logp = int(self.length.max()), pieces.logp
        self.arcs: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for j in range(1, self.most + 1):
            row = np.flatnonzero(self.length >= j)
            self.arcs[j] = []
            for step in pieces.steps:
                if step > j:
                    break
                lo = starts[row] + j - step
                piece = pieces.find(hashes(lo, lo + step))
                hit = piece >= 0
                if hit.any():
                    self.arcs[j].append((step, row[hit], piece[hit]))
        self.alpha = np.full((self.most + 1, self.n), -np.inf)
        self.alpha[0] = 0
        for j in range(1, self.most + 1):
            for step, row, piece in self.arcs[j]:
                self.alpha[j, row] = np.logaddexp(self.alpha[j, row], self.alpha[j - step, row] + self.logp[piece])
        self.total = self.alpha[self.length, np.arange(self.n)]

    def expected(self, counts: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected number of times that each piece is used in words with these counts."""
        beta = np.full((self.most + 1, self.n), -np.inf)
        beta[self.length, np.arange(self.n)] = 0
        for j in range(self.most, 0, -1):
            for step, row, piece in self.arcs[j]:
                part = self.logp[piece] + beta[j, row]
                np.add.at(out, piece, counts[row] * np.exp(self.alpha[j - step, row] + part - self.total[row]))
                beta[j - step, row] = np.logaddexp(beta[j - step, row], part)


class _LongWord:
    """The lattice of one long word, a stretch of it at a time: numbers for each byte are kept, arcs aren't.

    Probabilities are plain numbers that are scaled up together whenever they become small.
    """

    STRETCH, SMALL, SCALE = 1 << 15, 1e-100, 1e100

    def __init__(self, word: bytes, pieces: Pieces):
        self.raw, self.pieces, self.p = np.frombuffer(MARK + word, np.uint8), pieces, np.exp(pieces.logp)
        self.reach = pieces.steps[-1] if pieces.steps else 1

    def arcs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, step, piece) of the arcs that end within lo + 1 to hi, by end."""
        base = max(0, lo + 1 - self.reach)
        hashes = SpanHash(self.raw[base:hi])
        ends, steps, found = [], [], []
        for step in self.pieces.steps:
            end = np.arange(max(lo + 1, step), hi + 1)
            piece = self.pieces.find(hashes(end - step - base, end - base))
            hit = np.flatnonzero(piece >= 0)
            ends.append(end[hit]), steps.append(np.full(len(hit), step)), found.append(piece[hit])
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        return end[order], np.concatenate(steps)[order], np.concatenate(found)[order]

    def _swept(self, stretches, forward: bool, keep: np.ndarray | None) -> float:
        """The log of the sum over all segmentations; `keep` gets the log of the part before each place (after it, if not forward)."""
        n = len(self.raw)
        window, shift = {0 if forward else n: 1.0}, 0.0
        last = 0 if forward else n
        if keep is not None:
            keep[last] = 0.0
        for lo, hi in stretches:
            end, step, piece = self.arcs(lo, hi) if forward else self.arcs(lo, min(n, hi + self.reach))
            if forward:
                to, from_ = end, end - step
            else:
                mine = (end - step >= lo) & (end - step < hi)
                to, from_, piece = (end - step)[mine], end[mine], piece[mine]
                order = np.argsort(-to, kind="stable")
                to, from_, piece = to[order], from_[order], piece[order]
            stop = np.flatnonzero(np.diff(to, append=-1))
            source, share, k = from_.tolist(), self.p[piece].tolist(), 0
            for place, until in zip(to[stop].tolist(), (stop + 1).tolist()):
                total = 0.0
                for i in range(k, until):
                    total += window.get(source[i], 0.0) * share[i]
                k = until
                if total and total < self.SMALL:
                    window = {a: v * self.SCALE for a, v in window.items() if abs(a - place) <= self.reach}
                    total *= self.SCALE
                    shift -= math.log(self.SCALE)
                window[place] = total
                if len(window) > 4 * self.reach + 64:
                    window = {a: v for a, v in window.items() if abs(a - place) <= self.reach}
                if keep is not None:
                    keep[place] = math.log(total) + shift if total else -math.inf
        got = window.get(n if forward else 0, 0.0)
        return math.log(got) + shift if got else -math.inf

    def _stretches(self) -> list[tuple[int, int]]:
        return [(lo, min(len(self.raw), lo + self.STRETCH)) for lo in range(0, len(self.raw), self.STRETCH)]

    def total(self) -> float:
        return self._swept(self._stretches(), True, None)

    def expected(self, count: float, out: np.ndarray) -> None:
        n = len(self.raw)
        before, after = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        total = self._swept(self._stretches(), True, before)
        if total == -math.inf:
            return
        self._swept(self._stretches()[::-1], False, after)
        for lo, hi in self._stretches():
            end, step, piece = self.arcs(lo, hi)
            np.add.at(out, piece, count * np.exp(before[end - step] + self.pieces.logp[piece] + after[end] - total))


#: Words of more bytes are taken one by one.
LONG_WORD = 128


def _lattices(words: list[bytes], pieces: Pieces, rows: int = 20_000):
    """(indices, lattice) for words of up to LONG_WORD bytes, by length; none for the empty word, which stands for a document's end."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[(size[order] > 0) & (size[order] <= LONG_WORD)]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        # a set's matrix has its longest word's length
        hi = min(len(order), lo + max(1, rows * 16 // (int(size[order[lo]]) + 3)))
        while hi > lo + 1 and size[order[hi - 1]] > 2 * size[order[lo]] + 8:
            hi = lo + max(1, (hi - lo) // 2)
        part = order[lo:hi]
        buf = np.frombuffer(b"".join(MARK + words[i] for i in part), np.uint8)
        ends = np.cumsum(size[part] + len(MARK))
        yield part, _Lattice(buf, SpanHash(buf), ends - size[part] - len(MARK), ends, pieces)
        lo = hi


def word_logps(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """The natural log of the marginal probability of each word; of the end of a document for the empty word."""
    out = np.full(len(words), pieces.logp[-1])
    for part, lattice in _lattices(words, pieces):
        out[part] = lattice.total
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            out[i] = _LongWord(w, pieces).total()
    return out


def expected_counts(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """How often each piece is expected in a segmentation of one of each of these words, and last the documents' end."""
    out = np.zeros(len(pieces.texts) + 1)
    for part, lattice in _lattices(words, pieces):
        lattice.expected(np.ones(len(part)), out[:-1])
    for w in words:
        if len(w) > LONG_WORD:
            _LongWord(w, pieces).expected(1.0, out[:-1])
    return out


# ---------------------------------------------------------------- corpus
def _listed(docs: DataFrame, mod: int, fold: int) -> DataFrame:
    """(step, first, words, train, learned, pairs): of each step its different words with their counts in training documents, LISTED of them to a row, and in its
    first row the number of those documents, and, packed, which words the step's documents have how often, and their ids."""

    def count(batches):
        from pyspark import TaskContext

        step_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            learn = np.array([i is not None and zlib.crc32(str(i).encode()) % mod != fold for i in ids.to_pylist()], bool)
            key = ids.fill_null(0).to_numpy()
            present = ids.is_valid().to_numpy(zero_copy_only=False)
            buf, offsets = text_buffer(batch.column(1))
            for step in _steps(offsets, LIST_BYTES):
                base, end = step[0][0], step[-1][1]
                texts: dict[int, bytes] = {}
                pair_word, pair_doc, pair_n = [], [], []
                for lo, hi in step:
                    part = lowered(buf[offsets[lo] : offsets[hi]])
                    starts, ends, first = word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
                    hashes = SpanHash(part)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
                    doc = np.repeat(np.arange(lo, hi), np.diff(first))
                    value, at, code = np.unique(hashes, return_index=True, return_inverse=True)
                    raw = part.tobytes()
                    for h, a, b in zip(value.tolist(), starts[at].tolist(), ends[at].tolist()):
                        if h not in texts:
                            texts[h] = raw[a:b]
                    pair, n = np.unique(code * np.int64(hi - lo) + (doc - lo), return_counts=True)
                    pair_word.append(value[pair // (hi - lo)]), pair_doc.append((lo + pair % (hi - lo)).astype(np.int32)), pair_n.append(n.astype(np.int32))
                    del part, raw, starts, ends, hashes, doc, value, at, code, pair, n
                word, doc, n = (np.concatenate(x) for x in (pair_word, pair_doc, pair_n))
                del pair_word, pair_doc, pair_n
                names, code = np.unique(word, return_inverse=True)
                del word
                train = np.bincount(code, weights=n * learn[doc], minlength=len(names)).astype(np.int64)
                pairs = _packed(code.astype(np.int32), (doc - base).astype(np.int32), n.astype(np.int32), key[base:end], present[base:end].astype(np.uint8))
                learned = int(learn[base:end].sum())
                del doc, n, code
                for lo in range(0, max(len(names), 1), LISTED):
                    own = [texts[h] for h in names[lo : lo + LISTED].tolist()]
                    whole = pa.array([0, len(own)], pa.int32())
                    lists = [pa.ListArray.from_arrays(whole, pa.array(own, pa.binary())), pa.ListArray.from_arrays(whole, pa.array(train[lo : lo + LISTED]))]
                    head = [pa.array([0 if lo else learned]), pa.array([None if lo else pairs], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array([step_id]), pa.array([lo]), *lists, *head], ["step", "first", "words", "train", "learned", "pairs"])
                step_id += 1
                del texts, pairs
                give_back()

    return docs.mapInArrow(count, "step long, first long, words array<binary>, train array<long>, learned long, pairs binary")


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"


def lattice_scores(docs: DataFrame, vocabulary: str | None = None, mod: int = 7, fold: int = 2, rounds: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score), a row for each row of docs.

    Tokens are words in lower case A-Z, and one end. Learns from rows whose id's crc32 doesn't leave `fold`. base_score is the
    smoothed unigram of whole words. lattice_score is the lattice's log10 marginal over all segmentations into pieces, ends included; score also has the
    training words as arcs, and is what the model says of a text. Null, empty and blank texts
    have the end alone. Rows with a null doc_id are scored, never learned from, and not held out; rows that repeat an id count and are
    scored each for themselves. Without a row to learn from the vocabulary's own weights hold. A word may be as long as a text: its cost is in proportion. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    steps = written(_listed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), mod, fold), "steps")
    ends = steps.agg(F.coalesce(F.sum("learned"), F.lit(0))).first()[0]
    counts = written(steps.select(F.inline(F.arrays_zip("words", "train")).alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n")), "counts")
    sums = counts.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("n"), (F.col("n") > 0).cast("long"), (F.col("n") == 1).cast("long"), (F.col("n") == 2).cast("long")))).first()
    tokens, distinct, once, twice = (x + y for x, y in zip(sums, (ends, ends > 0, ends == 1, ends == 2)))
    discount = (once + 0.5) / (once + 2 * twice + 1)
    pieces = load_pieces(vocabulary or default_vocabulary())
    for _ in range(rounds if tokens else 0):
        pieces = Pieces(pieces.texts, reestimated(counts.where("n > 0").select("word"), pieces, ends > 0), pieces.hashes, pieces.slots)
    shared = spark.sparkContext.broadcast(pieces)

    def values(n: np.ndarray, lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of (the smoothed count, the model's probability, the lattice's) of words with these training counts."""
        whole = lattice
        if tokens:
            own = np.where(n > 0, np.log(np.maximum(n - discount, 1e-300) / tokens), -np.inf)
            whole = np.logaddexp(own, np.log(discount * distinct / tokens) + lattice)
        return np.log10(n + 1), whole / np.log(10), lattice / np.log(10)

    def score(batches):
        for batch in batches:
            lattice = word_logps(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice)], ["word", "n", "lattice"])
            give_back()

    scored = written(counts.select("word", "n").mapInArrow(score, "word binary, n long, lattice double"), "scored")
    end = [float(x[0]) for x in values(np.array([ends]), word_logps([b""], pieces))]
    log_all = float(np.log10(tokens + distinct + 1))

    def finish(found, table):
        code, doc, n, ids, present = (np.frombuffer(x, t) for x, t in zip(_unpacked(table.column("pairs")[0].as_py(), 5), (np.int32, np.int32, np.int32, np.int64, np.uint8)))
        at = found.column("pos").to_numpy()
        total, lattice = np.empty(len(at), np.int64), np.empty(len(at))
        total[at], lattice[at] = found.column("n").to_numpy(), found.column("lattice").to_numpy()
        known, *sums = (np.bincount(doc, weights=n * x[code], minlength=len(ids)) for x in (total > 0, *values(total, lattice)))
        size = np.bincount(doc, weights=n, minlength=len(ids)).astype(np.int64) + 1
        base, whole, lattice = (x + e for x, e in zip(sums, end))
        valid = present > 0
        held = np.array([ok and zlib.crc32(str(i).encode()) % mod == fold for ok, i in zip(valid.tolist(), ids.tolist())], bool)
        columns = [pa.array(ids, mask=~valid), held, size, known.astype(np.int64) + (ends > 0), np.full(len(ids), tokens, np.int64), base - size * log_all, whole, lattice]
        return pa.table(dict(zip((f.split()[0] for f in _SCORES.split(", ")), columns)))

    lists = steps.select(F.col("step").alias("of"), "first", F.posexplode("words").alias("at", "word")).join(scored, "word").select("of", (F.col("first") + F.col("at")).alias("pos"), "n", "lattice")
    return lists.groupBy("of").cogroup(steps.where("pairs is not null").select("step", "pairs").groupBy("step")).applyInArrow(finish, _SCORES)


def reestimated(words: DataFrame, pieces: Pieces, ends: bool, floor: float = 0.1) -> np.ndarray:
    """Log-probabilities of the pieces from their expected counts in the distinct training words; as many numbers as the vocabulary has come back."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def expect(batches):
        out = np.zeros(len(pieces.texts) + 1)
        for batch in batches:
            out += expected_counts(batch.column(0).to_pylist(), shared.value)
            give_back()
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used])], ["piece", "n"])

    found = words.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(len(pieces.texts) + 1, floor)
    counts[found.column("piece").to_numpy()] += found.column("n").to_numpy()
    counts[-1] += ends
    return np.log(counts / counts.sum())


def op10_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
