"""Vectorised word hashing on Arrow string columns, for use inside Spark tasks.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D).  The hash
of a word is a polynomial over a seeded random byte table modulo 2**64, finished
with a bit mixer; every byte is touched by a handful of NumPy operations and no
Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C13
_INV_P = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators where only ASCII letters, digits and bytes beyond ASCII make words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_FOLDED = _RANDOM.copy()
_FOLDED[65:91] = _RANDOM[97:123]
_powers: list[np.ndarray] = []

#: Bytes of text that are hashed at a time (a longer text is hashed alone).
CHUNK_BYTES = 1 << 18


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to exponent n at least; those of longer texts than ``CHUNK_BYTES`` are not kept."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, CHUNK_BYTES) + 2
        out = []
        for base in (_P, _INV_P):
            step = np.full(size, base, dtype=U64)
            step[0] = 1
            out.append(np.multiply.accumulate(step))
        if n > CHUNK_BYTES:
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that close sums end far apart."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, row offsets) for runs of rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of a run of texts: ``start``/``end`` byte positions, ``hash``, and per row the slice ``row[i]:row[i+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True, separators: np.ndarray = _SPACE):
        n = len(data)
        word = ~separators[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= ~word[:-1] | edge[1:n]
            last[:-1] &= ~word[1:] | edge[1:n]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.start, offsets)
        up, self._down = _power(n)
        self._sum = np.zeros(n + 1, dtype=U64)
        np.cumsum((_FOLDED if fold else _RANDOM)[data] * up[:n], out=self._sum[1:])
        self.hash = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each start to each end; equal bytes give equal hashes."""
        return mix((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(U64))


_STEP = [U64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(64)]


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every n consecutive hashes."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    total = np.full(len(hashes) - n + 1, n, dtype=U64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * _STEP[k]
    return mix(total)


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct n-word shingles; a shorter text is one shingle, one without words none."""
    every = runs(words.hash, n)
    for a, b in zip(words.row[:-1].tolist(), words.row[1:].tolist()):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield runs(words.hash[a:b], b - a)
        else:
            yield every[:0]
