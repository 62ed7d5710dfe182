"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are read as code points: letters in lower case, all else a space, with a space on either side. The n-grams of
orders 1 to 3 are hashed to a fixed number of cells. Counts by language give a matrix of log-probabilities, cells by
languages, whose size is a parameter; it is broadcast, and whole texts are scored in numpy by gathering its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, slices, text_buffer

UNKNOWN = "und"
#: Learning reads about this many labelled documents, chosen by a hash of doc_id; prediction reads all.
FIT_ROWS = 20_000
CELLS = 1 << 16
ORDERS = (1, 2, 3)
#: Bytes of text scored at once.
SLICE = 500_000


def _tables() -> np.ndarray:
    """For each code point of the first plane: its lower case if it is a letter, else a space."""
    out = np.full(0x10000, 0x20, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else i
    return out


_FOLD: list[np.ndarray] = []


def _folded(points: np.ndarray) -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_tables())
    out = _FOLD[0][np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        values, inverse = np.unique(points[high], return_inverse=True)
        out[high] = np.array([ord(chr(v).lower()[0]) if chr(v).isalpha() else 0x20 for v in values.tolist()], np.uint32)[inverse]
    return out


def _points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of rows with a space before, between and after them, and where each row's leading space stands."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offsets]
    out = np.full(len(points) + len(offsets), 0x20, np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(lead))
    out[np.arange(len(points)) + row + 1] = _folded(points)
    return out, lead + np.arange(len(offsets))


def _cells(points: np.ndarray, order: int, cells: int) -> np.ndarray:
    """The cell of the n-gram that starts at each place; -1 for blank ones. The last order - 1 places have none."""
    n = len(points) - order + 1
    h = np.full(max(n, 0), order * 0x9E3779B1, np.uint64)
    blank = np.ones(max(n, 0), dtype=bool)
    for k in range(order):
        part = points[k : k + n]
        h = (h ^ part) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        blank &= part == 0x20
    out = (h % np.uint64(cells)).astype(np.int64)
    out[blank] = -1
    return out




def ngram_counts(labelled: DataFrame, cells: int = CELLS) -> DataFrame:
    """(label, cell, n) of labelled (text, label); cell -1 has the number of documents."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            buf, offsets = text_buffer(batch.column(0))
            for label in labels:
                docs[label] = docs.get(label, 0) + 1
            for lo, hi in slices(offsets, SLICE):
                points, at = _points(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                names = sorted(set(labels[lo:hi]))
                code = np.repeat([names.index(x) for x in labels[lo:hi]], np.diff(at))
                for order in ORDERS:
                    cell = _cells(points, order, cells)[: len(code)]
                    mark = code[: len(cell)]
                    for i, name in enumerate(names):
                        mine = cell[(mark == i) & (cell >= 0)]
                        total[name] = total.get(name, 0) + np.bincount(mine, minlength=cells)
            give_back()
        for name, n in docs.items():
            counts = total.get(name, np.zeros(cells, np.int64))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(used) + 1), pa.string()), pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(counts[used], n).astype(np.int64))], ["label", "cell", "n"])

    return labelled.mapInArrow(count, "label string, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))


class NaiveBayes:
    def __init__(self, labels: list[str], prior: np.ndarray, table: np.ndarray):
        self.labels, self.prior, self.table = labels, prior, table

    @classmethod
    def fit(cls, labelled: DataFrame, cells: int = CELLS, alpha: float = 0.5) -> NaiveBayes:
        """labelled: (text, label), without nulls. The counts that reach the driver are cells x languages at most."""
        found = ngram_counts(labelled, cells).toArrow()
        names = np.array(found.column("label").to_pylist(), dtype=object)
        cell, n = found.column("cell").to_numpy(), found.column("n").to_numpy()
        labels = sorted(set(names))
        counts, docs = np.zeros((cells, len(labels))), np.zeros(len(labels))
        for i, name in enumerate(labels):
            mine = names == name
            c, k = cell[mine], n[mine]
            counts[c[c >= 0], i] = k[c >= 0]
            docs[i] = k[c < 0].sum()
        table = np.log((counts + alpha) / (counts.sum(0) + alpha * cells)) if labels else counts
        return cls(labels, np.log(docs / docs.sum()) if labels else docs, table.astype(np.float32))

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(label, posterior of it) of each row; texts without a letter, or a model without languages, give `und` and 0."""
        labels, scores = [], []
        for lo, hi in slices(offsets, SLICE):
            points, at = _points(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            letters = np.diff(np.concatenate(([0], np.cumsum(points != 0x20)))[at])
            if not self.labels:
                labels += [UNKNOWN] * (hi - lo)
                scores.append(np.zeros(hi - lo))
                continue
            total = np.tile(self.prior, (hi - lo, 1))
            for order in ORDERS:
                cell = _cells(points, order, len(self.table))
                # an n-gram over a border starts in the row before, with a blank between: its place is not counted
                place = np.arange(len(cell))
                row = np.repeat(np.arange(hi - lo), np.diff(at))[: len(cell)]
                good = np.flatnonzero((cell[: len(row)] >= 0) & (place[: len(row)] + order <= at[row + 1] + 1))
                if not len(good):
                    continue
                row = row[good]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                for i in range(len(self.labels)):
                    total[row[first], i] += np.add.reduceat(self.table[:, i][cell[good]], first, dtype=np.float64)
            best = total.argmax(1)
            odds = np.exp(total - total[np.arange(hi - lo), best][:, None]).sum(1)
            labels += [self.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), letters.tolist())]
            scores.append(np.where(letters > 0, 1 / odds, 0.0))
        return labels, np.concatenate(scores) if scores else np.zeros(0)


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About `rows` of the rows, by a hash of doc_id; all of fewer."""
    n = docs.count()
    return docs if n <= rows else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def held_out(doc_id: Column, mod: int = 4, fold: int = 2) -> Column:
    """Whether the crc32 of the id's text leaves `fold`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == fold, F.lit(False))


def fit_languages(docs: DataFrame, fit_rows: int = FIT_ROWS, cells: int = CELLS) -> NaiveBayes:
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label")).where("doc_id is not null and text is not null and label is not null")
    return NaiveBayes.fit(sampled(known.where(~held_out(F.col("doc_id"))), fit_rows).select("text", "label"), cells)


def identified(docs: DataFrame, model: NaiveBayes, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language and its posterior in columns of the given names; one pass, no shuffle. Columns of docs with those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (label, score)]
    names = [f"c{i}" for i in range(len(keep))]
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.col("text").cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            _, bytes_ = text_buffer(whole.column(len(keep)))
            for lo, hi in slices(bytes_, 4_000_000):
                batch = whole.slice(lo, hi - lo)
                labels, scores = shared.value.predict(*text_buffer(batch.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*names, "label", "posterior"])
            give_back()

    schema = own.select(*names).schema.add("label", "string").add("posterior", "double")
    return own.mapInArrow(run, schema).toDF(*keep, label, score)


def predict_languages(docs: DataFrame, fit_rows: int = FIT_ROWS, cells: int = CELLS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs.

    Learns from text and lang of rows whose fold is not held out; neither lang, source nor doc_id is an input of a
    prediction. Null texts and those without a letter get `und` and 0; so do all if no labelled row may be learned from. Ties go to the
    language that sorts first. Rows with a null doc_id are predicted, never learned from. Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit_languages(own, fit_rows, cells)
    return identified(own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
