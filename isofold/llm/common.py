"""Helpers shared by the operators: vectorised word splitting and hashing, memory, filters.

Word splitting works on the UTF-8 buffer of an Arrow column without making a Python
string per document. Text is taken in slices of a few MB, so that the arrays beside it
stay small however many rows a batch has; a longer single text makes a slice of its own.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import fresh_path  # noqa: F401  used with the helpers below
from ..functions.storage import settled as written  # noqa: F401

SLICE_BYTES = 2_000_000

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# ---------------------------------------------------------------- memory
def give_back() -> None:
    """Returns what a batch used to the system: a worker that lives on would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- Arrow buffers
def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row begins (one more entry than rows); null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes at most; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z become a-z, as bytes; all else stays."""
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words [^\\x20\\x09-\\x0D]+ of rows that stand one after another in buf.

    first has one more entry than rows: row r has the words first[r] to first[r + 1].
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = WHITE[buf]
    before = np.empty(len(buf) + 1, dtype=bool)
    before[0] = before[-1] = True
    before[1:] = white
    begins, edge = ~white, offsets[offsets < len(buf)]
    open_ = begins & before[:-1]
    open_[edge] |= begins[edge]
    after = np.empty(len(buf), dtype=bool)
    after[:-1], after[-1] = white[1:], True
    shut = begins & after
    last = offsets[offsets > 0] - 1
    shut[last] |= begins[last]
    starts = np.flatnonzero(open_)
    return starts, np.flatnonzero(shut) + 1, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashing
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNIT = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("up", ())) < n + 1:
        size = n + 1 if n > 4 * SLICE_BYTES else max(n + 1, 1 << 16)
        up = _powers(int(_BASE), size)
        down = _powers(pow(int(_BASE), -1, 2**64), size)
        if n > 4 * SLICE_BYTES:
            return up, down
        _CACHE["up"], _CACHE["down"] = up, down
    return _CACHE["up"], _CACHE["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good diffusion."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """64-bit hashes of any spans of a buffer: equal bytes get equal hashes, wherever they stand."""

    def __init__(self, units: np.ndarray):
        """units: bytes, or 64-bit words."""
        up, self.down = _power_tables(len(units))
        self.sums = np.zeros(len(units) + 1, dtype=np.uint64)
        values = _UNIT[units] if units.dtype == np.uint8 else units
        np.cumsum(values * up[: len(units)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- columns and filters
def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df as they are, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def without_keys(docs: DataFrame, gone: DataFrame, keys: dict[str, Column], broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without the rows whose `keys`, expressions over docs, are a row of gone, which has columns of these names.

    Nulls are equal. Up to `broadcast_rows` rows of gone are broadcast (keys are ids and digests: 64 MB), more are joined by a shuffle.
    """
    gone = written(gone.select(*keys).distinct(), "gone")
    few = gone.limit(broadcast_rows + 1).count() <= broadcast_rows
    own = {k: unused(docs, f"own_{k}") for k in keys}
    theirs = gone.select(*(F.col(k).alias(unused(docs, f"gone_{k}")) for k in keys))
    marked = docs.select("*", *(c.alias(own[k]) for k, c in keys.items()))
    on = [marked[f"`{own[k]}`"].eqNullSafe(theirs[f"`{c}`"]) for k, c in zip(keys, theirs.columns)]
    left = marked.join(F.broadcast(theirs) if few else theirs, on, "left_anti")
    return left.select(*columns_of(docs))
