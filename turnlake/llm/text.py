"""Vectorised passes over Arrow string columns, as flat byte arrays with row offsets.

Hashes are 64-bit polynomial sums over bytes, so any substring's hash follows from one running sum.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: White space is [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are (safe in UTF-8).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE_BYTES + 65536
    return _powers(size) if n <= size else _powers.__wrapped__(n)


class Sums:
    """Running sums of one byte array; ``hash(start, end)`` for arrays of ranges."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.total = np.empty(len(data) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def release() -> None:
    """Give back what a task has freed: workers are reused, and the next stage needs the memory elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most ``limit`` bytes of text each (one row at least)."""
    _, offsets = flat(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the word index at which each row begins."""
    return runs(SPACE[data], offsets)


def runs(gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches without a gap, cut at row boundaries."""
    n = len(gap)
    solid = ~gap
    first, last = solid.copy(), solid.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every \\n-separated line (an empty row has one), and the line index per row."""
    newline = np.flatnonzero(data == 10)
    counts = np.searchsorted(newline, offsets[1:]) - np.searchsorted(newline, offsets[:-1]) + 1
    at = np.concatenate(([0], np.cumsum(counts)))
    starts = np.sort(np.concatenate((offsets[:-1], newline + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], newline)), kind="stable")
    return starts, ends, at


def shingles(word_hash: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of each row, and where each row's begin.

    A row with fewer words has one, of all its words; a row without words has none.
    """
    n = np.diff(at)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(len(n)), counts)
    first = at[:-1][row] + (np.arange(to[-1]) - to[:-1][row])
    have = np.minimum(n[row], size)
    total = np.zeros(to[-1], np.uint64)
    factor = np.uint64(1)
    for k in range(size):
        inside = np.minimum(first + k, len(word_hash) - 1)
        total += np.where(k < have, word_hash[inside] * factor, np.uint64(0)) if len(word_hash) else 0
        factor = np.uint64((int(factor) * _BASE) % (1 << 64))
    return mix(total + have.astype(np.uint64)), to
