"""Vectorised word and window hashes over the UTF-8 bytes of Arrow string columns.

Everything here works on a bounded slice of a batch (about SLICE_BYTES of text, or one longer document), so memory
doesn't depend on the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


def inverse_powers(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, 1 << 64), n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Slice:
    """The words of a few whole documents.

    start, end: byte positions of each word in data; doc: the document (row of the slice) of each word; first: for
    each document the index of its first word, with the number of words at the end; code: a 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: bool = True):
        self.data, self.offsets = data, offsets
        n = len(data)
        space = SPACES[data]
        begins = np.empty(n, bool)
        if n:
            begins[0] = True
            begins[1:] = space[:-1]
            begins[offsets[:-1][offsets[:-1] < n]] = True
            begins &= ~space
            ends = np.empty(n, bool)
            ends[-1] = True
            ends[:-1] = space[1:]
            inner = offsets[1:-1]
            ends[inner[inner > 0] - 1] = True
            ends &= ~space
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if hashes:
            sums = np.zeros(n + 1, U)
            np.cumsum((data.astype(U) + U(1)) * powers(BYTE_BASE, n), out=sums[1:])
            raw = (sums[self.end] - sums[self.start]) * inverse_powers(BYTE_BASE, n + 1)[self.start]
            self.code = mix(raw + (self.end - self.start).astype(U))
            self._sums = np.zeros(len(self.code) + 1, U)
            np.cumsum(self.code * powers(WORD_BASE, max(1, len(self.code)))[: len(self.code)], out=self._sums[1:])

    def __len__(self) -> int:
        return len(self.start)

    def spans(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of the words begin..stop-1, by content alone."""
        return mix((self._sums[stop] - self._sums[begin]) * inverse_powers(WORD_BASE, len(self) + 1)[begin] + (stop - begin).astype(U))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words, over document boundaries too; window_starts() tells which lie in one."""
        begin = np.arange(max(0, len(self) - k + 1))
        return self.spans(begin, begin + k)

    def window_starts(self, k: int) -> np.ndarray:
        """Indices of the words at which a run of k words of one document starts."""
        n = max(0, len(self) - k + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n]) if n else np.zeros(0, np.int64)


def slices(column: pa.Array, hashes: bool = True, lower: bool = False) -> Iterator[tuple[int, int, Slice]]:
    """(first row, end row, Slice) over a string column in bounded pieces; null counts as empty. lower: A-Z as a-z."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        part = data[offsets[row] : offsets[stop]]
        yield row, stop, Slice(LOWER[part] if lower else part, offsets[row : stop + 1] - offsets[row], hashes)
        row = stop
