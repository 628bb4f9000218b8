"""Two Bloom filters over 64-bit hashes: bits seen once and bits seen twice.

Filters of parts of the data merge by (once | once', twice | twice' | once & once'), so each task fills its
own, chunks travel as positions or bitmaps, whichever is shorter, and tasks that own a chunk merge it.  The
result, the twice-seen filter, has a size bounded by ``MAX_BITS``; beyond it false suspects only add work,
never change a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import mix

PROBES = 3
CHUNK_BITS = 1 << 17
MAX_BITS = 1 << 31
BITS_PER_KEY = 16


def bits_for(keys: int) -> int:
    """Filter size for about so many keys: a power of two, at least one chunk."""
    return min(MAX_BITS, max(CHUNK_BITS, 1 << int(max(1, keys) * BITS_PER_KEY - 1).bit_length()))


def _positions(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = mix(hashes + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for k in range(PROBES):
        yield (hashes + np.uint64(k) * step) & np.uint64(bits - 1)


def _pack(at: np.ndarray) -> bytes:
    """Sorted positions inside a chunk, as 4-byte numbers, or as a bitmap where that is shorter."""
    if 4 * len(at) < CHUNK_BITS // 8:
        return at.astype("<u4").tobytes()
    flags = np.zeros(CHUNK_BITS, bool)
    flags[at.astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if len(data) == CHUNK_BITS // 8:
        return np.frombuffer(data, np.uint8)
    flags = np.zeros(CHUNK_BITS, bool)
    flags[np.frombuffer(data, "<u4").astype(np.int64)] = True
    return np.packbits(flags)


def _emit(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    chunks, rows = [], ([], [])
    edges = np.uint64(CHUNK_BITS)
    for c in np.unique(once // edges):
        parts = []
        for at in (once, twice):
            a, b = np.searchsorted(at, [c * edges, (c + np.uint64(1)) * edges])
            parts.append(_pack(at[a:b] - c * edges))
        chunks.append(int(c))
        for k in (0, 1):
            rows[k].append(parts[k])
        if len(chunks) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), *(pa.array(r, pa.binary()) for r in rows)], ["chunk", "once", "twice"])
            chunks, rows = [], ([], [])
    if chunks:
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), *(pa.array(r, pa.binary()) for r in rows)], ["chunk", "once", "twice"])


def _distinct(ordered: np.ndarray) -> np.ndarray:
    """Sorted values, each once."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


class Twice:
    """The twice-seen filter; ``suspects(hashes)`` is true for all hashes that occur twice, and for few others."""

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.bits = bits
        self.map = np.zeros(bits // 8, np.uint8)
        for c, data in chunks.items():
            self.map[c * CHUNK_BITS // 8 : (c + 1) * CHUNK_BITS // 8] = np.frombuffer(data, np.uint8)

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in _positions(hashes, self.bits):
            at = at.astype(np.int64)
            out &= (self.map[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


def twice_seen(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> Twice:
    """Filter of the hashes that occur at least twice over all rows of ``df``."""
    limit = 4 << 20  # hashes held per task before its filters are emitted

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            # A bit that two different hashes share counts as seen twice: a false suspect at worst.
            at = np.sort(np.concatenate(list(_positions(values, bits))))
            again = np.concatenate(list(_positions(values[counts > 1], bits)))
            shared = at[1:][at[1:] == at[:-1]]
            yield from _emit(_distinct(at), _distinct(np.sort(np.concatenate((again, shared)))))

        for b in batches:
            for h in hashes(b):
                held.append(h)
                n += len(h)
                if n >= limit:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for c, once, twice in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                once, twice = _unpack(once), _unpack(twice)
                if c in held:
                    mine = held[c]
                    mine[1] = mine[1] | twice | (mine[0] & once)
                    mine[0] = mine[0] | once
                else:
                    held[c] = [once, twice]
        for c, (_, twice) in held.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([twice.tobytes()], pa.binary())], ["chunk", "twice"])

    spark = df.sparkSession
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), bits // CHUNK_BITS))
    filled = df.mapInArrow(fill, "chunk long, once binary, twice binary")
    merged = filled.repartition(tasks, "chunk").mapInArrow(merge, "chunk long, twice binary")
    return Twice(bits, {r["chunk"]: bytes(r["twice"]) for r in merged.collect()})  # at most MAX_BITS / 8 bytes
