"""Nearest stored vector by cosine, exactly, without meeting all vectors: pivots and angular triangle bounds.

A few vectors far from one another are the pivots.  Every stored vector belongs to its nearest pivot, and by its angle
to it to a band; a band knows its smallest and largest angle.  For a query at angle a to the pivot nothing in the band
is nearer than max(a - largest, smallest - a).  A query first opens the band with the best bound, nearest pivot first; the
best similarity found there closes all bands whose bound is lower.

Small bands that follow one another share a unit, large ones are a unit of several parts; a part, or cell, holds a bounded
number of vectors.  Queries are packed into blocks in the same way, by their first band.  A block meets every cell that one of its
queries asks for, each (block, cell) in one matrix product, so vectors travel once per block and cell and never per query
and band.

Zero vectors have similarity 0 to all and a band of their own; a zero query opens every band.  ``by`` columns scope
the search: only bands of the query's own scope are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import wide
from ..session import settle

SIM_DIGITS = 12
#: Vectors that pivots are chosen from, pivots, and bands per pivot: bounds of what the driver and each task hold.
SAMPLE, PIVOTS, BANDS = 4096, 128, 64
#: Stored vectors to a pivot, where there are fewer pivots than that.
PER_PIVOT = 512
#: Bands that travel with every task; beyond it each query opens all bands of its scope.
MAX_BANDS = 200_000
#: Queries of a matrix product, and queries whose bounds are looked at together.
SLICE, BOUND_SLICE = 512, 256
_SLACK = 1e-6  # radians: arc cosines near 1 are good to about 1e-8
_ZERO = -1
_BAND = ["scope", "pivot", "band_no"]


def unit(rows: list | pd.Series) -> np.ndarray:
    m = np.asarray(list(rows), dtype=np.float64)
    m = m.reshape(len(m), -1) if m.size else np.zeros((len(m), 1))
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    length[length == 0] = np.inf  # a zero vector scores 0 everywhere
    return m / length[:, None]


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Far apart unit vectors: each next one is the farthest from those before."""
    vectors = vectors[np.abs(vectors).sum(1) > 0]
    if not len(vectors):
        return vectors
    chosen, nearest = [0], vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, vectors @ vectors[far])
    return vectors[chosen]


def _vectors(column: pa.Array) -> np.ndarray:
    return unit(column.to_pylist())


def bound(angles: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest cosine that a band (low to high) may hold for a query at these angles to its pivot."""
    return np.cos(np.maximum(np.maximum(angles - high, low - angles) - _SLACK, 0))


class Index:
    """A stored table cut into bands; ``search`` answers queries."""

    def __init__(self, bank: DataFrame, cell: int, by: Sequence[str] = ()):
        """``bank`` holds (by.., emb_id, vec, and ``rank``: a struct that orders equal similarities, smallest first)."""
        spark = bank.sparkSession
        self.by, self.cell = list(by), cell
        scope = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(b).cast("string")), F.lit("-")) for b in by)) if by else F.lit("")
        self.scope = scope
        order = bank.schema["rank"].dataType.fields
        self.rank = [f"r{i}" for i in range(len(order))]
        self.kinds = ", ".join(f"r{i} {f.dataType.simpleString()}" for i, f in enumerate(order))
        ranks = [F.col(f"rank.{f.name}").alias(f"r{i}") for i, f in enumerate(order)]
        held = settle(bank.select(scope.alias("scope"), "emb_id", "vec", *ranks), "vectors-held")
        some = held.select("vec").orderBy(F.xxhash64("emb_id")).limit(SAMPLE).collect()
        total = held.count()
        self.pivots = choose_pivots(unit([r["vec"] for r in some]), min(PIVOTS, max(1, total // min(cell, PER_PIVOT)))) if some else np.zeros((0, 1))
        pivots = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _vectors(b.column(1))
                zero = np.abs(v).sum(1) == 0
                sims = np.clip(v @ pivots.T, -1, 1) if len(pivots) and len(v) else np.zeros((len(v), 1))
                pivot = np.where(zero, _ZERO, sims.argmax(1)) if len(v) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pivot.astype(np.int32)), pa.array(np.arccos(sims.max(1) if len(v) else np.zeros(0)))], ["emb_id", "pivot", "angle"])

        placed = held.select("emb_id", "vec").mapInArrow(place, f"emb_id {held.schema['emb_id'].dataType.simpleString()}, pivot int, angle double")
        placed = held.join(placed, "emb_id").withColumn("band_no", F.least(F.floor(F.col("angle") / np.pi * BANDS), F.lit(BANDS - 1)).cast("int"))
        placed = settle(placed, "vectors-placed")
        bands = placed.groupBy(*_BAND).agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
        self.bands = settle(packed(bands, cell), "vectors-bands")
        self.number = self.bands.count()
        self.units = self.bands.select("scope", "unit", "parts").distinct()
        stored = placed.join(self.bands.select(*_BAND, "unit", "parts"), _BAND)
        self.stored = stored.select("unit", _dealt("emb_id").alias("part"), "emb_id", "vec", *self.rank)

    def _tables(self) -> dict[str, tuple]:
        """Per scope the bands in order of their units (pivot, band, smallest and largest angle), where each unit begins, and the units."""
        held: dict[str, list] = {}
        for r in self.bands.select("scope", "unit", "pivot", "band_no", "low", "high").collect():  # at most MAX_BANDS rows
            held.setdefault(r["scope"], []).append(tuple(r)[1:])
        out = {}
        for scope, rows in held.items():
            unit_, pivot, band, low, high = (np.array(c) for c in zip(*sorted(rows)))
            names, start = np.unique(unit_, return_index=True)
            out[scope] = (pivot, band, low, high, start, names)
        return out

    def _first(self, queries: DataFrame) -> DataFrame:
        """Queries of a known scope with the band that has the best bound; any one of the scope where bands are too many to look at."""
        if self.number > MAX_BANDS:
            known = queries.join(self.bands.select("scope").distinct(), "scope", "left_semi")
            return known.select("qid", "vec", "scope", F.lit(0).alias("pivot"), F.lit(0).alias("band_no"))
        given = queries.sparkSession.sparkContext.broadcast((self.pivots, self._tables()))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, tables = given.value
            for b in batches:
                angles, alive = _angles(b.column("vec"), pivots)
                row, pivot, band = [], [], []
                for scope, at in _by_value(b.column("scope")):
                    if scope not in tables:
                        continue
                    of, number, low, high, _, _ = tables[scope]
                    for k in range(0, len(at), BOUND_SLICE):
                        part = at[k : k + BOUND_SLICE]
                        to, most = _bounds(angles[part], alive[part], of, low, high)
                        off = np.maximum(np.maximum(to - high, low - to), 0)
                        # The best bound; of those, the band that is least off, then the nearest pivot.
                        off = np.where(most == most.max(1, keepdims=True), off, np.inf)
                        top = np.where(off == off.min(1, keepdims=True), to, np.inf).argmin(1)
                        row.append(part)
                        pivot.append(of[top])
                        band.append(number[top])
                none = [np.zeros(0, np.int64)]
                take = pa.array(np.concatenate(row or none).astype(np.int64))
                made = [pa.array(np.concatenate(x or none).astype(np.int32)) for x in (pivot, band)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("qid", "vec", "scope")), *made], ["qid", "vec", "scope", "pivot", "band_no"])

        kind = queries.schema["vec"].dataType.simpleString()
        return queries.mapInArrow(choose, f"qid string, vec {kind}, scope string, pivot int, band_no int")

    def _more(self, queries: DataFrame) -> DataFrame:
        """(block, unit, asked): the units that may hold a vector as good as a query's ``best``, and how many queries of the block ask."""
        given = queries.sparkSession.sparkContext.broadcast((self.pivots, self._tables()))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, tables = given.value
            for b in batches:
                angles, alive = _angles(b.column("vec"), pivots)
                best, first, block = (b.column(c).to_numpy(zero_copy_only=False) for c in ("best", "unit", "block"))
                found: dict[tuple[int, int], int] = {}
                for scope, at in _by_value(b.column("scope")):
                    of, _, low, high, start, names = tables[scope]
                    at = at[np.argsort(block[at], kind="stable")]
                    for k in range(0, len(at), BOUND_SLICE):
                        part = at[k : k + BOUND_SLICE]
                        _, most = _bounds(angles[part], alive[part], of, low, high)
                        wanted = np.logical_or.reduceat(most >= best[part, None] - 10.0 ** (1 - SIM_DIGITS), start, axis=1)
                        wanted &= names[None, :] != first[part, None]
                        ids, begin = np.unique(block[part], return_index=True)
                        asked = np.add.reduceat(wanted.astype(np.int64), begin, axis=0)
                        for i, j in zip(*np.nonzero(asked)):
                            pair = int(ids[i]), int(names[j])
                            found[pair] = found.get(pair, 0) + int(asked[i, j])
                pairs = list(found)
                columns = [[p[0] for p in pairs], [p[1] for p in pairs], [found[p] for p in pairs]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "unit", "asked"])

        got = queries.select("qid", "vec", "scope", "block", "unit", "best").mapInArrow(choose, "block long, unit long, asked long")
        return got.groupBy("block", "unit").agg(F.sum("asked").alias("asked"))

    def _opened(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """Best stored vector of each (block, unit) and query, by part: (qid, sim, emb_id, and its rank)."""
        cells = pairs.select("block", "unit").join(self.units.select("unit", "parts"), "unit")
        cells = cells.select("block", "unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dealt = asked.select("block", "qid", "vec").join(cells, "block")
        stored = self.stored.join(cells, ["unit", "part"])
        rank, columns = self.rank, ["qid", "sim", "emb_id", *self.rank]

        def match(key: tuple, ask: pd.DataFrame, bank: pd.DataFrame) -> pd.DataFrame:
            if ask.empty or bank.empty:
                return pd.DataFrame({c: [] for c in columns})
            bank = bank.sort_values(rank, kind="stable")
            stored, top, at = unit(bank["vec"]).T, [], []
            for k in range(0, len(ask), SLICE):
                # Rounded so that the winner does not hang on summation order.
                sims = np.round(unit(ask["vec"].iloc[k : k + SLICE]) @ stored, SIM_DIGITS)
                best = sims.argmax(axis=1)
                at.append(best)
                top.append(sims[np.arange(len(best)), best])
            out = bank[["emb_id", *rank]].iloc[np.concatenate(at)].reset_index(drop=True)
            out.insert(0, "qid", ask["qid"].to_numpy())
            out.insert(1, "sim", np.concatenate(top))
            return out

        keys = ("block", "unit", "part")
        kind = self.stored.schema["emb_id"].dataType.simpleString()
        return wide(dealt, *keys).groupBy(*keys).cogroup(wide(stored, *keys).groupBy(*keys)).applyInPandas(match, f"qid string, sim double, emb_id {kind}, {self.kinds}")

    def search(self, queries: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
        """(qid, sim, emb_id) per query with a stored vector in its scope, and one row (opened, possible): cells asked for of all."""
        asked = queries.select(self.scope.alias("scope"), F.col("qid").cast("string").alias("qid"), "vec")
        homed = settle(self._first(asked), "vectors-first")
        homes = packed(homed.groupBy(*_BAND).agg(F.count(F.lit(1)).alias("n")), group).drop("n")
        in_block = homed.join(homes, _BAND).withColumn("block", F.xxhash64("unit", _dealt("qid"))).drop("unit", "parts")
        top = F.min(F.struct((-F.col("sim")).alias("s"), *self.rank, "emb_id")).alias("b")
        best = lambda df: df.groupBy("qid").agg(top).select("qid", (-F.col("b.s")).alias("sim"), "b.emb_id", *(f"b.{r}" for r in self.rank))
        if self.number > MAX_BANDS:
            given = settle(in_block, "vectors-blocks")
            pairs = settle(given.groupBy("scope", "block").agg(F.count(F.lit(1)).alias("asked")).join(self.units, "scope").select("block", "unit", "asked"), "vectors-pairs")
            out = best(self._opened(given, pairs))
        else:
            given = settle(in_block.join(self.bands.select(*_BAND, "unit"), _BAND), "vectors-blocks")
            once = settle(given.groupBy("block", "unit").agg(F.count(F.lit(1)).alias("asked")), "vectors-once")
            found = settle(best(self._opened(given, once)), "vectors-found")
            wanted = settle(self._more(given.join(found.select("qid", F.col("sim").alias("best")), "qid")), "vectors-more")
            out = best(found.unionByName(self._opened(given, wanted.join(once, ["block", "unit"], "left_anti"))))
            pairs = once.unionByName(wanted)
        cells = lambda df, n: df.agg(F.coalesce(F.sum(F.col("asked") * F.col("parts")), F.lit(0)).alias(n))
        all_units = given.groupBy("scope").agg(F.count(F.lit(1)).alias("asked")).join(self.units, "scope")
        both = cells(pairs.join(self.units, "unit"), "opened").unionByName(cells(all_units, "possible"), allowMissingColumns=True)
        return out.select("qid", "sim", "emb_id"), both.agg(F.max("opened").alias("opened"), F.max("possible").alias("possible"))


def packed(bands: DataFrame, size: int) -> DataFrame:
    """(scope, pivot, band_no, n, ..) with the ``unit`` of each band and its ``parts``, of about ``size`` rows, twice that at most for small bands.

    Bands of a scope that follow one another share a unit; a band of more than ``size`` rows is one by itself.
    """
    # At most PIVOTS * BANDS + 1 rows a scope.
    before = F.coalesce(F.sum("n").over(W.partitionBy("scope").orderBy("pivot", "band_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = F.col("n") > size
    unit_ = F.when(large, F.xxhash64("scope", "pivot", "band_no")).otherwise(F.xxhash64("scope", F.floor(F.col("before") / size)))
    return bands.withColumn("before", before).withColumn("unit", unit_).withColumn("parts", F.ceil(F.greatest(F.col("n"), F.lit(1)) / size).cast("int")).drop("before")


def _dealt(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col("parts")).cast("int")


def _by_value(column: pa.Array) -> list[tuple[str, np.ndarray]]:
    """The rows of each value."""
    values, code = np.unique(np.array(column.to_pylist(), dtype=object), return_inverse=True) if len(column) else ([], np.zeros(0))
    return [(v, np.flatnonzero(code == k)) for k, v in enumerate(values)]


def _angles(column: pa.Array, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of vectors to the pivots, and which vectors are not zero."""
    v = _vectors(column)
    known = len(pivots) and len(v)
    return np.arccos(np.clip(v @ pivots.T, -1, 1)) if known else np.zeros((len(v), 1)), v.any(1)


def _bounds(angles: np.ndarray, alive: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per query and band the angle to the band's pivot, and the largest cosine the band may hold."""
    to = angles[:, np.maximum(pivot, 0)]
    return to, np.where((pivot == _ZERO)[None, :] | ~alive[:, None], 0.0, bound(to, low, high))
