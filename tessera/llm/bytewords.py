"""Words of whole texts as numpy arrays over the UTF-8 bytes of an Arrow column.

Texts are handled in slices of a few MB, so memory does not depend on the number
of rows in a batch. One text is never divided: a slice holds at least one whole text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_U = np.uint64
_M1, _M2, _SEED = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, ASCII letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: All but space and 0x09-0x0D.
NONSPACE = np.ones(256, bool)
NONSPACE[32] = NONSPACE[9:14] = False

_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def trimmed(run: Callable) -> Callable:
    """A step of mapInArrow that gives freed memory back to the system when its task ends, as workers outlive tasks."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)

    return whole


def arrow(df: DataFrame, run: Callable, kind: str) -> DataFrame:
    """mapInArrow with batches bounded in bytes, so that rows of long texts don't pile up in one.

    The bound is a setting of the session, and is only set where the session has none of its own.
    """
    conf = df.sparkSession.conf
    if conf.get(_LIMIT, None) is None:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(trimmed(run), kind)


def texts(column: pa.Array) -> list[str | None]:
    """The texts of a column as strings. Spark doesn't check the bytes of a string: those that aren't UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of a slice of texts: byte ranges, the text each lies in, and where each text's words begin."""

    data: np.ndarray  # lower-cased bytes with eight zero bytes behind them
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # per text and one more: index of its first word

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def hashes(self, limit: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first `limit` bytes (eight at most)."""
        lanes = np.ndarray((len(self.data) - 7,), "<u8", self.data.data, strides=(1,))
        length = self.end - self.start
        if limit is not None:
            length = np.minimum(length, limit)
        h = mix(length.astype(np.uint64) + _SEED)
        h = mix(h ^ (lanes[self.start] & _KEEP[np.minimum(length, 8)])) if len(h) else h
        left, done = np.flatnonzero(length > 8), 8
        while len(left):
            more = length[left] - done
            h[left] = mix(h[left] ^ (lanes[self.start[left] + done] & _KEEP[np.minimum(more, 8)]))
            left, done = left[more > 8], done + 8
        return h

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, by their first word; len(h) - n + 1 of them."""
    out = mix(h[: len(h) - n + 1] + _U(n))
    for k in range(1, n):
        out = mix(out * _M1 + h[k : len(h) - n + 1 + k])
    return out


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; offsets begin at 0."""
    n = int(offsets[-1])
    buf = np.zeros(n + 8, np.uint8)
    buf[:n] = LOWER[data[:n]]
    is_word = letters[buf[:n]]
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    at = offsets[:-1]
    at = at[at < n]
    begins[at] = is_word[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    ends[at] = is_word[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(buf, start, end, doc, first)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary()).fill_null(b"")
    n = len(binary)
    if not n:
        return
    _, off, buf = binary.buffers()
    off = np.frombuffer(off, np.int64)[binary.offset : binary.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_slices(column: pa.Array, letters: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, off in slices(column, most):
        yield lo, hi, words(data, off, letters)
