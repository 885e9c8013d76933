"""Vectorised text work on Arrow columns: words, range hashes, chunking.

All helpers see texts as one flat byte buffer plus offsets, so that the work per
byte is done by numpy, not by a Python loop.  Null texts are empty texts.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A task works on so many bytes of text at once; its work arrays take some 60 times as much.
CHUNK_BYTES = 1 << 18
_MASK = (1 << 64) - 1
#: An odd multiplier has an inverse modulo 2**64, which makes hashes of any range two look-ups.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept between calls."""
    if len(_powers[0]) < n:
        size = (n + (1 << 18) - 1 >> 18) << 18
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One random-looking 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class RangeHash:
    """64-bit hashes of any ranges of a sequence of 64-bit values, after one pass over it."""

    def __init__(self, values: np.ndarray):
        self._up, self._down = powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._up[: len(values)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self._sums[ends]
        h -= self._sums[starts]
        h *= self._down[starts]
        return mix(h)


def tidied(run: Callable) -> Callable:
    """A map function over batches that gives its freed memory back when its task ends; a
    worker lives on for later tasks, beside those of other stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def as_binary(column: pa.Array) -> pa.Array:
    """A string or binary column as binary with no nulls."""
    if pa.types.is_null(column.type):
        return pa.array([b""] * len(column), pa.large_binary())
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in sequence and the row offsets into them (one more than rows)."""
    column = as_binary(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a longer text comes alone."""
    if batch.num_rows == 0:
        return
    _, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def table_of(characters: str) -> np.ndarray:
    """A 256-entry table that is true for the given one-byte characters."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What separates words by white space: blank, tab, line feed, vertical tab, form feed, return.
SPACE = table_of(" \t\n\v\f\r")


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separator bytes, and for each row the
    index of its first word (one more entry than rows). A word never crosses rows."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return starts, ends, np.searchsorted(starts, offsets)


def int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
