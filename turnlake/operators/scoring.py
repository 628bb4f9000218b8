"""Quality scores: word, speaker-aware word, diarization and Jaccard error rates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import spread, tasks, wide
from ..functions.intervals import floor_div, last_writer_cells, union_lengths
from ..functions.ordered import prefix_scan
from ..functions.text import exact_round, norm_words, words_of
from ..session import scratch_path, settle

FRAME_MS = 10
TICK_MS = 100
FRAME_BUCKET = 1500
TILE = 4096
#: Tokens of the pairs that one task aligns, by which their tasks grow.
TASK_TOKENS = 1 << 22
#: Tokens of a text that is one row; cells beside the diagonal at first, and at most.
WHOLE, FIRST_BAND, WIDEST = 64 * TILE, 64, 1 << 16

# --- word edit distance ---------------------------------------------------------
# Each cell of the alignment matrix carries its cost and the deletions on its path.
# Insertions and substitutions follow: I - D = j - i and cost = S + I + D.
# Choice among equal costs: match, substitution, deletion, insertion.


def _dp_row(cost, dels, ref_tok, hyp, left_cost, left_dels, ramp):
    """Next matrix row for a batch; arrays are (pairs, width + 1), column 0 given."""
    diag, up = cost[:, :-1], cost[:, 1:]
    same = hyp == ref_tok[:, None]
    # Neighbouring cells differ by at most one, so a match never needs the minimum.
    free = np.minimum(diag, up)
    free += 1
    np.copyto(free, diag, where=same)
    row = np.empty_like(cost)
    row[:, 0] = left_cost
    row[:, 1:] = free
    row -= ramp
    np.minimum.accumulate(row, axis=1, out=row)
    row += ramp
    own = row[:, 1:]
    by_diag = (own - diag) == 1
    by_diag |= same
    inserted = (own - up) != 1
    inserted &= ~by_diag
    path = np.empty_like(dels)
    path[:, 0] = left_dels
    body = path[:, 1:]
    np.add(dels[:, 1:], 1, out=body)
    np.copyto(body, dels[:, :-1], where=by_diag)
    if inserted.any():
        # An insertion carries the value of the nearest cell to its left that is none.
        source = np.zeros_like(row)
        np.multiply(~inserted, ramp[1:], out=source[:, 1:])
        np.maximum.accumulate(source, axis=1, out=source)
        if len(row) > 1:
            source += (np.arange(len(row), dtype=source.dtype) * row.shape[1])[:, None]
        path = path.reshape(-1).take(source)
    return row, path


_FAR = 1 << 29


def _in_band(ref: np.ndarray, hyp: np.ndarray, m: np.ndarray, n: np.ndarray, half: int) -> np.ndarray:
    """(cost, deletions) of padded pairs, looking only at cells with |j - i| <= half.

    Costs up to ``half`` are exact, and so is the choice of path: every cell of a best path, and every cell
    it may be chosen from, lies inside the band.
    """
    p, rows = ref.shape
    width = 2 * half + 1
    ramp = np.arange(width, dtype=np.int32)
    # Column o of row i is cell j = i + o - half; the hypothesis is padded so that every row is one slice.
    text = np.full((p, half + max(rows, hyp.shape[1]) + width + 1), -3, dtype=np.int32)
    text[:, half : half + hyp.shape[1]] = hyp
    cost = np.tile(np.where(ramp >= half, ramp - half, _FAR).astype(np.int32), (p, 1))
    dels = np.zeros_like(cost)
    out = np.zeros((p, 2), dtype=np.int64)
    each = np.arange(p)
    shifted = (np.arange(p, dtype=np.int64) * width)[:, None]
    for i in range(rows + 1):
        done = np.flatnonzero(m == i)
        if len(done):
            at = n[done] - i + half
            out[done, 0], out[done, 1] = cost[each[done], at], dels[each[done], at]
        if i == rows:
            break
        up, up_dels = np.full_like(cost, _FAR), np.zeros_like(dels)
        up[:, :-1], up_dels[:, :-1] = cost[:, 1:], dels[:, 1:]
        same = text[:, i : i + width] == ref[:, i, None]
        own = np.minimum(cost, up) + 1
        np.copyto(own, cost, where=same)
        edge = half - i - 1  # the column of j = 0, which has deletions only
        if edge >= 0:
            own[:, :edge] = _FAR
            own[:, edge] = i + 1
        own -= ramp
        np.minimum.accumulate(own, axis=1, out=own)
        own += ramp
        by_diag = (own - cost == 1) | same
        inserted = (own - up != 1) & ~by_diag
        path = np.where(by_diag, dels, up_dels + 1)
        if edge >= 0:
            inserted[:, : edge + 1] = False
            path[:, edge] = i + 1
        inserted[:, 0] = False
        if inserted.any():
            # An insertion carries the value of the nearest cell to its left that is none.
            source = np.maximum.accumulate(np.where(inserted, 0, ramp), axis=1)
            path = path.reshape(-1).take(source + shifted)
        cost, dels = own, path
    return out


def _edit_batch(refs: list[np.ndarray], hyps: list[np.ndarray]) -> np.ndarray:
    """(cost, deletions) of whole pairs: bands are doubled until they hold the distance.

    The work is words times errors, not words times words, and memory is one row of the band.
    """
    m, n = np.array([len(r) for r in refs]), np.array([len(h) for h in hyps])
    flat = np.concatenate([*refs, *hyps]) if m.sum() + n.sum() else np.zeros(0, np.int64)
    codes = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    cuts = np.cumsum(np.concatenate((m, n)))[:-1]
    parts = np.split(codes, cuts)
    ref, hyp = np.full((len(m), max(1, m.max())), -1, np.int32), np.full((len(n), max(1, n.max())), -2, np.int32)
    for k in range(len(m)):
        ref[k, : m[k]], hyp[k, : n[k]] = parts[k], parts[len(m) + k]
    out = np.zeros((len(m), 2), dtype=np.int64)
    half = np.maximum(16, np.abs(m - n) + 8)
    todo = np.arange(len(m))
    while len(todo):
        wide_enough = int(half[todo].max())
        rows, columns = max(1, int(m[todo].max())), max(1, int(n[todo].max()))
        found = _in_band(ref[todo, :rows], hyp[todo, :columns], m[todo], n[todo], wide_enough)
        out[todo] = found
        todo = todo[(found[:, 0] > wide_enough) & (np.maximum(m, n)[todo] > wide_enough)]
        half[todo] = np.minimum(2 * wide_enough, np.maximum(m, n)[todo])
    return out


def _edit_pair(ref: list, hyp: list, strip: int = 8192, span: int = 1024) -> tuple[int, int]:
    """(cost, deletions) of one pair; the matrix is made in strips of ``ref`` words, a column of a strip in one integer.

    Neighbouring cells differ by -1, 0 or 1, so a column is two bit sets (Myers, in the form of Hyyro).  The way back from the last
    cell chooses as everywhere here.  Every ``span``-th column is kept; the tiles on the way back are made again.
    """
    m, n = len(ref), len(hyp)

    def places(s: int) -> tuple[dict, int]:
        at: dict = {}
        words = ref[s * strip : (s + 1) * strip]
        for i, word in enumerate(words):
            at[word] = at.get(word, 0) | 1 << i
        return at, len(words)

    def tile(at: dict, size: int, words: list, steps: bytes, above: int, below: int) -> tuple:
        """Columns right of (above, below): cells equal to their diagonal neighbour, cells one more than the cell above, and
        the steps along the last row.  ``steps`` are those along the row above the strip, plus one."""
        every, last = (1 << size) - 1, size - 1
        diagonal, deeper, out = [], [], bytearray()
        for word, step in zip(words, steps):
            found = at.get(word, 0) | (step == 0)
            equal = (((found & above) + above) ^ above | found | below) & every
            right, left = below | every ^ (above | equal), above & equal
            out.append(1 + (right >> last) - (left >> last))
            right = (right << 1 | (step == 2)) & every
            above, below = (left << 1 | (step == 0) | every ^ (right | equal)) & every, right & equal
            diagonal.append(equal)
            deeper.append(above)
        return diagonal, deeper, out, above, below

    marks, rows, made, diagonal, deeper = {}, [], None, [], []
    steps = bytes([2]) * n
    for s in range(-(-m // strip)):
        at, size = places(s)
        above, below, out = (1 << size) - 1, 0, bytearray()
        for k in range(-(-n // span)):
            marks[s, k] = above, below
            diagonal, deeper, more, above, below = tile(at, size, hyp[k * span : (k + 1) * span], steps[k * span : (k + 1) * span], above, below)
            made, out = (s, k), out + more
        rows.append(steps)
        steps = bytes(out)
    i, j, cost, dels = m, n, 0, 0
    strip_at = made and made[0]
    while i and j:
        s, k = (i - 1) // strip, (j - 1) // span
        if made != (s, k):
            if strip_at != s:
                (at, size), strip_at = places(s), s
            diagonal, deeper, *_ = tile(at, size, hyp[k * span : (k + 1) * span], rows[s][k * span : (k + 1) * span], *marks[s, k])
            made = s, k
        top, left = s * strip, k * span
        while i > top and j > left:
            if ref[i - 1] == hyp[j - 1]:
                i, j = i - 1, j - 1
                continue
            cost += 1
            if not diagonal[j - left - 1] >> (i - top - 1) & 1:
                i, j = i - 1, j - 1
            elif deeper[j - left - 1] >> (i - top - 1) & 1:
                i, dels = i - 1, dels + 1
            else:
                j -= 1
    return cost + i + j, dels + i


_EDIT = T.StructType([T.StructField("cost", T.LongType()), T.StructField("dels", T.LongType())])


@F.pandas_udf(_EDIT)
def _edit_udf(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(ref), 2), dtype=np.int64)
    size = np.array([max(len(a), len(b)) for a, b in zip(ref, hyp)], dtype=np.int64)
    for k in np.flatnonzero(size <= WHOLE):
        out[k] = _edit_pair(ref.iloc[k].tolist(), hyp.iloc[k].tolist())
    for k in np.flatnonzero(size > WHOLE):
        out[k] = _edit_batch([ref.iloc[k]], [hyp.iloc[k]])[0]
    return pd.DataFrame({"cost": out[:, 0], "dels": out[:, 1]})


def _counts(cost: Column, dels: Column, m: Column, n: Column) -> list[Column]:
    ins = dels + n - m
    return [
        (cost - ins - dels).cast("bigint").alias("substitutions"),
        ins.cast("bigint").alias("insertions"),
        dels.cast("bigint").alias("deletions"),
        m.cast("bigint").alias("num_words"),
        cost.cast("bigint").alias("num_errors"),
    ]


def _tokens(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def edit_counts(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S, I, D, N per pair of word arrays (``ref_ws``, ``hyp_ws``), of any length, in Arrow batches.

    Texts that are too long for one row come in blocks, see :func:`edit_counts_blocks`.
    """
    sized = pairs.select(
        *keys, F.size("ref_ws").alias("__m"), F.size("hyp_ws").alias("__n"),
        _tokens(F.col("ref_ws")).alias("__r"), _tokens(F.col("hyp_ws")).alias("__h"),
    )
    near = spread(sized, *keys).withColumn("__e", _edit_udf("__r", "__h"))
    return near.select(*keys, *_counts(F.col("__e.cost"), F.col("__e.dels"), F.col("__m"), F.col("__n")))


def edit_counts_blocks(
    ref: DataFrame, hyp: DataFrame, keys: Sequence[str], tile: int = TILE, whole: int = WHOLE, widest: int = WIDEST
) -> DataFrame:
    """S, I, D, N from token blocks (keys.., b, toks) of ``tile`` tokens, the last one shorter.

    Pairs of at most ``whole`` tokens a side are aligned in batches.  The blocks of longer ones stream through a task
    in text order, which keeps one row of a band around the diagonal; a band that the distance leaves is widened, so the
    number of jobs grows with the logarithm of the errors and not with the length.  Pairs that would need a
    band of more than ``widest`` cells to a side run as waves of tiles.  A side without any block is an empty text.
    """
    r = settle(ref.select(*keys, F.col("b").alias("bi"), F.col("toks").alias("rt")), "edit-ref")
    h = settle(hyp.select(*keys, F.col("b").alias("bj"), F.col("toks").alias("ht")), "edit-hyp")
    lens = lambda df, col, name: df.groupBy(*keys).agg(
        F.sum(F.size(col)).alias(f"__len_{name}"), F.count(F.lit(1)).alias(f"__nb_{name}")
    )
    size = lens(r, "rt", "r").join(lens(h, "ht", "h"), list(keys), "full_outer").na.fill(0)
    size = settle(size.withColumn("__longer", F.greatest("__len_r", "__len_h")), "edit-size")
    one = size.filter((F.col("__len_r") == 0) | (F.col("__len_h") == 0))
    out = one.select(
        *keys, F.lit(0).cast("bigint").alias("substitutions"),
        F.col("__len_h").alias("insertions"), F.col("__len_r").alias("deletions"),
        F.col("__len_r").alias("num_words"), F.col("__longer").alias("num_errors"),
    )
    both = size.filter((F.col("__len_r") > 0) & (F.col("__len_h") > 0))
    fits = F.col("__longer") <= whole
    longest, tokens = both.agg(F.max("__longer"), F.sum(F.when(fits, F.col("__len_r") + F.col("__len_h")))).first()
    if longest is None:
        return out
    text = lambda df, at, toks: df.groupBy(*keys).agg(  # noqa: E731  at most ``whole`` tokens a row
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at, toks))), lambda s: s[toks])).alias(toks)
    )
    short = both.filter(fits).select(*keys)
    pairs = text(r.join(short, list(keys), "left_semi"), "bi", "rt").join(text(h.join(short, list(keys), "left_semi"), "bj", "ht"), list(keys))
    laid = pairs.repartition(max(tasks(pairs), (tokens or 0) // TASK_TOKENS), F.xxhash64(*keys))
    near = laid.withColumn("__e", _edit_udf("rt", "ht")).withColumns({"__m": F.size("rt"), "__n": F.size("ht")})
    out = out.unionByName(near.select(*keys, *_counts(F.col("__e.cost"), F.col("__e.dels"), F.col("__m"), F.col("__n"))))
    if longest <= whole:
        return out
    left = both.filter(F.col("__longer") > whole).withColumn("__half", F.abs(F.col("__len_r") - F.col("__len_h")) + FIRST_BAND)
    while True:
        found = settle(_banded(r, h, left.filter(F.col("__half") <= widest), list(keys), tile), "edit-band")
        known = (F.col("cost") <= F.col("__half")) | (F.col("__half") >= F.col("__longer"))
        out = out.unionByName(found.filter(known).select(*keys, *_counts(F.col("cost"), F.col("dels"), F.col("__len_r"), F.col("__len_h"))))
        beyond = left.filter(F.col("__half") > widest)
        left = found.filter(~known).drop("cost", "dels").withColumn("__half", F.least(F.col("__half") * 4, F.col("__longer")))
        left = settle(left.unionByName(beyond), "edit-left")
        counts = left.agg(F.count(F.lit(1)), F.count_if(F.col("__half") <= widest)).first()
        if not counts[0]:
            return out
        if not counts[1]:
            return out.unionByName(_tile_waves(r, h, left, keys, tile))


class _Band:
    """One row of the matrix of a pair, around the diagonal; tokens come in blocks."""

    def __init__(self, half: int):
        self.half, self.width, self.row = half, 2 * half + 1, 0
        self.ramp = np.arange(self.width, dtype=np.int64)
        self.cost = np.where(self.ramp >= half, self.ramp - half, _FAR)
        self.dels = np.zeros_like(self.cost)
        self.text, self.start = np.zeros(half, np.int64), 0  # hypothesis around the row; cells beyond it are never used

    def read(self, tokens: np.ndarray) -> None:
        self.text = np.concatenate((self.text[self.row - self.start :], tokens))
        self.start = self.row

    def advance(self, tokens: np.ndarray) -> None:
        missing = self.row + len(tokens) + self.width - self.start - len(self.text)
        text = np.concatenate((self.text, np.zeros(max(0, missing), np.int64)))
        half, ramp = self.half, self.ramp
        up, up_dels = np.full_like(self.cost, _FAR), np.zeros_like(self.cost)
        for token in tokens:
            cost, dels, i = self.cost, self.dels, self.row
            up[:-1], up_dels[:-1] = cost[1:], dels[1:]
            same = text[i - self.start : i - self.start + self.width] == token
            own = np.minimum(cost, up) + 1
            np.copyto(own, cost, where=same)
            edge = half - i - 1  # the cell of an empty hypothesis, which has deletions only
            if edge >= 0:
                own[:edge] = _FAR
                own[edge] = i + 1
            own -= ramp
            np.minimum.accumulate(own, out=own)
            own += ramp
            by_diag = (own - cost == 1) | same
            inserted = (own - up != 1) & ~by_diag
            path = np.where(by_diag, dels, up_dels + 1)
            if edge >= 0:
                inserted[: edge + 1] = False
                path[edge] = i + 1
            inserted[0] = False
            # An insertion carries the value of the nearest cell to its left that is none.
            path = path[np.maximum.accumulate(np.where(inserted, 0, ramp))]
            self.cost, self.dels, self.row = own, path, i + 1

    def result(self, n: int) -> tuple[int, int]:
        at = n - self.row + self.half
        return int(self.cost[at]), int(self.dels[at])


def _banded(r: DataFrame, h: DataFrame, pairs: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """``pairs`` (keys.., lengths, __half) with cost and deletions inside their bands; blocks stream in text order."""
    shift = F.ceil(F.col("__half") / tile) + 1
    rows = r.join(pairs, keys).select(*pairs.columns, F.col("bi").cast("long").alias("__at"), F.lit(1).alias("__side"), F.col("bi").alias("__b"), F.col("rt").alias("__toks"))
    # A block of the hypothesis comes before the first row that can see it.
    hyps = h.join(pairs, keys).select(*pairs.columns, (F.col("bj") - shift).cast("long").alias("__at"), F.lit(0).alias("__side"), F.col("bj").alias("__b"), F.col("ht").alias("__toks"))
    laid = wide(rows.unionByName(hyps), *keys).sortWithinPartitions(*keys, "__at", "__side", "__b")
    fields = [laid.schema[c] for c in pairs.columns]
    names, width = pairs.columns, len(keys)
    n_at, half_at = pairs.columns.index("__len_h"), pairs.columns.index("__half")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, band = None, None

        def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
            cost, dels = band.result(at[n_at])
            kinds = [batch.schema.field(n).type for n in names]
            return pa.RecordBatch.from_arrays(
                [*(pa.array([v], k) for v, k in zip(at, kinds)), pa.array([cost], pa.int64()), pa.array([dels], pa.int64())], [*names, "cost", "dels"])

        last = None
        for b in batches:
            heads = list(zip(*(b.column(n).to_pylist() for n in names)))
            toks = b.column("__toks")
            for k, side in enumerate(b.column("__side").to_pylist()):
                if at is None or heads[k][:width] != at[:width]:
                    if band is not None:
                        yield finish(b)
                    at, band = heads[k], _Band(heads[k][half_at])
                tokens = toks[k].values.to_numpy(zero_copy_only=False)
                band.advance(tokens) if side else band.read(tokens)
            last = b
        if band is not None:
            yield finish(last)

    return laid.select(*names, "__side", "__toks").mapInArrow(run, T.StructType([*fields, T.StructField("cost", T.LongType()), T.StructField("dels", T.LongType())]))


def _tile_waves(r: DataFrame, h: DataFrame, both: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Counts of pairs that differ nearly everywhere.

    Tiles of one anti-diagonal are independent: they run as one Spark stage over all pairs, and only their edges
    (written to the shared folder) feed the next.
    """
    waves = both.agg(F.max(F.col("__nb_r") + F.col("__nb_h") - 1)).first()[0]
    edges = None
    base = scratch_path(both.sparkSession, "edit-wave")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if f.name in keys)
    schema = (
        f"{key_schema}, bi int, bj int, bottom_c array<int>, bottom_d array<int>, right_c array<int>, right_d array<int>"
    )
    full = both.select(*keys, "__nb_r", "__nb_h", "__len_r", "__len_h")
    for wave in range(waves):
        # Pairs with a tile on this diagonal, then their tiles on it.
        cell = full.filter(F.lit(wave) < F.col("__nb_r") + F.col("__nb_h") - 1).select(
            *keys,
            F.explode(
                F.sequence(
                    F.greatest(F.lit(0), F.lit(wave) - F.col("__nb_h") + 1).cast("int"),
                    F.least(F.lit(wave), F.col("__nb_r") - 1).cast("int"),
                )
            ).alias("bi"),
        )
        cell = cell.withColumn("bj", (F.lit(wave) - F.col("bi")).cast("int"))
        work = cell.join(r, [*keys, "bi"]).join(h, [*keys, "bj"])
        if edges is None:
            work = work.select(
                *keys, "bi", "bj", "rt", "ht",
                *[F.lit(None).cast("array<int>").alias(c) for c in ("top_c", "top_d", "left_c", "left_d")],
            )
        else:
            top = edges.select(
                *keys, (F.col("bi") + 1).alias("bi"), "bj",
                F.col("bottom_c").alias("top_c"), F.col("bottom_d").alias("top_d"),
            )
            left = edges.select(
                *keys, "bi", (F.col("bj") + 1).alias("bj"),
                F.col("right_c").alias("left_c"), F.col("right_d").alias("left_d"),
            )
            work = work.join(top, [*keys, "bi", "bj"], "left").join(left, [*keys, "bi", "bj"], "left").select(
                *keys, "bi", "bj", "rt", "ht", "top_c", "top_d", "left_c", "left_d"
            )
        done = wide(work, *keys, "bi").mapInPandas(_tile_runner(list(keys), tile), schema)
        if waves == 1:
            edges = done
        else:
            done.write.parquet(f"{base}/wave={wave}")
            edges = done.sparkSession.read.schema(schema).parquet(f"{base}/wave={wave}")
    # The last tile of every pair, from whichever diagonal it was on.
    tiles = edges if waves == 1 else edges.sparkSession.read.schema(schema).parquet(base)
    last = tiles.join(full, list(keys)).filter(
        (F.col("bi") == F.col("__nb_r") - 1) & (F.col("bj") == F.col("__nb_h") - 1)
    )
    return last.select(
        *keys, *_counts(F.element_at("right_c", -1), F.element_at("right_d", -1), F.col("__len_r"), F.col("__len_h"))
    )


def _tile_runner(keys: list[str], tile: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(batch.itertuples(index=False))
            edges: list = [None] * len(rows)
            # Tiles of similar shape advance together, row by row.
            order = sorted(range(len(rows)), key=lambda k: (len(rows[k].rt), len(rows[k].ht)))
            while order:
                width = max(len(rows[k].ht) for k in order[:64]) + 1
                take = max(1, min(64, 60_000 // width))
                chunk, order = order[:take], order[take:]
                for k, edge in zip(chunk, _tiles([rows[k] for k in chunk], tile)):
                    edges[k] = edge
            out = pd.DataFrame(edges, columns=["bottom_c", "bottom_d", "right_c", "right_d"])
            yield pd.concat([batch[[*keys, "bi", "bj"]].reset_index(drop=True), out], axis=1)

    return run


def _tiles(rows: list, tile: int) -> list[tuple]:
    """Edges of a few tiles.  Bottom and top include column 0, so they carry the corner.

    Shorter tiles are padded below and to the right, where nothing they use is read.
    """
    p = len(rows)
    hs = np.array([len(r.rt) for r in rows])
    ws = np.array([len(r.ht) for r in rows])
    height, width = int(hs.max()), int(ws.max())
    _, codes = np.unique(np.concatenate([x for r in rows for x in (r.rt, r.ht)]), return_inverse=True)
    ref = np.full((p, height), -1, dtype=np.int32)
    hyp = np.full((p, width), -2, dtype=np.int32)
    ramp = np.arange(width + 1, dtype=np.int32)
    cost, dels = np.zeros((p, width + 1), dtype=np.int32), np.zeros((p, width + 1), dtype=np.int32)
    lc, ld = np.zeros((p, height), dtype=np.int32), np.zeros((p, height), dtype=np.int32)
    at = 0
    for k, r in enumerate(rows):
        h, w = hs[k], ws[k]
        ref[k, :h], hyp[k, :w] = codes[at : at + h], codes[at + h : at + h + w]
        at += h + w
        if r.top_c is None:
            cost[k] = ramp + int(r.bj) * tile
        else:
            cost[k, : w + 1], dels[k, : w + 1] = r.top_c, r.top_d
        if r.left_c is None:
            lc[k, :h] = ld[k, :h] = np.arange(h) + int(r.bi) * tile + 1
        else:
            lc[k, :h], ld[k, :h] = r.left_c, r.left_d
    rc, rd = np.empty((p, height), dtype=np.int32), np.empty((p, height), dtype=np.int32)
    every = np.arange(p)
    bottom: list = [None] * p
    for i in range(height):
        cost, dels = _dp_row(cost, dels, ref[:, i], hyp, lc[:, i], ld[:, i], ramp)
        rc[:, i], rd[:, i] = cost[every, ws], dels[every, ws]
        for k in np.flatnonzero(hs == i + 1):
            bottom[k] = (cost[k, : ws[k] + 1].copy(), dels[k, : ws[k] + 1].copy())
    return [(*bottom[k], rc[k, : hs[k]], rd[k, : hs[k]]) for k in range(p)]


def with_rates(counts: DataFrame) -> DataFrame:
    """WER (4 digits) and percent (2); an empty reference gives 0 or infinity."""
    rate = F.when(
        F.col("num_words") > 0, F.col("num_errors") / F.col("num_words")
    ).otherwise(F.when(F.col("num_errors") == 0, 0.0).otherwise(float("inf")))
    return counts.withColumn("wer", exact_round(rate, 4)).withColumn("wer_pct", exact_round(rate * 100, 2))


def wer(pairs: DataFrame, keys: Sequence[str], ref: str = "ref_text", hyp: str = "hyp_text") -> DataFrame:
    """Word error rate of normalised texts."""
    words = pairs.select(
        *keys, norm_words(F.col(ref)).alias("ref_ws"), norm_words(F.col(hyp)).alias("hyp_ws")
    )
    return with_rates(edit_counts(words, keys))


def wer_simple(pairs: DataFrame, keys: Sequence[str], ref: str = "ref_text", hyp: str = "hyp_text") -> DataFrame:
    """Lower case and split only; null when either text is missing or blank."""
    words = pairs.select(
        *keys,
        words_of(F.lower(F.coalesce(F.col(ref), F.lit("")))).alias("ref_ws"),
        words_of(F.lower(F.coalesce(F.col(hyp), F.lit("")))).alias("hyp_ws"),
        (F.coalesce(F.length(ref), F.lit(0)) * F.coalesce(F.length(hyp), F.lit(0)) > 0).alias("__ok"),
    )
    counts = edit_counts(words, keys)
    flags = words.select(*keys, "__ok")
    return counts.join(flags, list(keys)).select(
        *keys,
        F.when(F.col("__ok") & (F.col("num_words") > 0), F.col("num_errors") / F.col("num_words")).alias("wer"),
    )


def corpus_wer(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Errors over reference words, summed before the division."""
    agg = counts.groupBy(*by).agg(
        F.sum("num_errors").alias("num_errors"), F.sum("num_words").alias("num_words")
    )
    return agg.withColumn("wer", F.when(F.col("num_words") > 0, F.col("num_errors") / F.col("num_words")))


def _speaker_rows(words: DataFrame) -> DataFrame:
    # A word holds no inner space, so its scoring form is one replacement.
    tok = F.regexp_replace(F.lower("word"), r"[^\p{L}\p{N}_]", "")
    body = words.select("episode_id", "speaker", "start_ms", "seg_id", "word_idx", tok.alias("tok"))
    label = words.select("episode_id", "speaker").distinct().select(
        "episode_id", "speaker", F.lit(-1).cast("bigint").alias("start_ms"),
        F.lit(-1).cast("bigint").alias("seg_id"), F.lit(-1).alias("word_idx"),
        F.explode(norm_words(F.concat(F.lit("["), F.col("speaker"), F.lit("]")))).alias("tok"),
    )
    return body.filter(F.col("tok") != "").unionByName(label)


_SPEAKER_ORDER = ("speaker", "start_ms", "seg_id", "word_idx")


def _speaker_bucket() -> Column:
    return F.struct("speaker", floor_div(F.col("start_ms"), 600_000).alias("b"))


def speaker_tokens(words: DataFrame) -> DataFrame:
    """Tokens of the speaker-grouped text: per speaker its label, then its words by time.

    Input (episode_id, speaker, start_ms, seg_id, word_idx, word); output adds ``pos``.
    """
    return prefix_scan(_speaker_rows(words), ["episode_id"], _SPEAKER_ORDER, _speaker_bucket(), sums={"pos": F.lit(1).cast("bigint")})


def token_blocks(tokens: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, tile: int = TILE) -> DataFrame:
    """Blocks of ``tile`` tokens per key, in ``order``: (keys.., b, toks).

    Tokens are gathered by (key, bucket), which bounds a row; buckets, far fewer, are counted up and cut at block borders.
    ``bucket`` must be non-decreasing along ``order``.
    """
    entry = F.struct(*order, F.xxhash64("tok").alias("__t"))
    parts = tokens.withColumn("__bucket", bucket).groupBy(*keys, "__bucket").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["__t"]).alias("toks")
    )
    return _cut_blocks(parts, keys, tile)


def _cut_blocks(parts: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Blocks from (keys.., __bucket, toks), the tokens of each bucket in order."""
    before = F.coalesce(F.sum(F.size("toks")).over(W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("__at", before).withColumn("b", F.explode(F.sequence(floor_div(F.col("__at"), tile), floor_div(F.col("__at") + F.size("toks") - 1, tile))))
    first = F.greatest(F.col("b") * tile - F.col("__at"), F.lit(0))
    piece = F.slice("toks", (first + 1).cast("int"), (F.least((F.col("b") + 1) * tile - F.col("__at"), F.size("toks").cast("bigint")) - first).cast("int"))
    cut = placed.select(*keys, F.col("b").cast("int").alias("b"), F.struct(F.col("__at"), piece.alias("toks")).alias("piece"))
    return cut.groupBy(*keys, "b").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda s: s["toks"])).alias("toks"))


def text_blocks(segments: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Blocks of the joined segment texts of each key; a segment's tokens travel as one array."""
    toks = F.coalesce(_tokens(norm_words(F.col("text"))), F.array().cast("array<bigint>"))
    rows = segments.select(*keys, floor_div(F.col("seg_id"), 64).alias("__bucket"), F.struct("seg_id", toks.alias("toks")).alias("__seg"))
    parts = rows.groupBy(*keys, "__bucket").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("__seg")), lambda s: s["toks"])).alias("toks")
    )
    return _cut_blocks(parts.filter(F.size("toks") > 0), keys, tile)


def document_wer(ref: DataFrame, hyp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """WER of whole documents given as (keys.., seg_id, text) rows, aligned end to end."""
    counts = edit_counts_blocks(text_blocks(ref, keys), text_blocks(hyp, keys), keys)
    return with_rates(counts)


def cpwer(hyp_words: DataFrame, ref_words: DataFrame) -> DataFrame:
    """WER of speaker-grouped texts per episode; labels count as words.

    Lines follow speaker order; speakers are not permuted.
    """
    blocks = lambda words: token_blocks(_speaker_rows(words), ["episode_id"], _SPEAKER_ORDER, _speaker_bucket())
    counts = edit_counts_blocks(blocks(ref_words), blocks(hyp_words), ["episode_id"])
    return with_rates(counts)


# --- diarization ------------------------------------------------------------------


def _in_units(turns: DataFrame, unit: int, order: str | None = None) -> DataFrame:
    cols = ["episode_id", floor_div(F.col("start_ms"), unit).alias("start_ms"),
            floor_div(F.col("end_ms"), unit).alias("end_ms"), "speaker"]
    if order:
        cols.append(F.col(order).alias("ord"))
    return turns.select(*cols)


def der(ref: DataFrame, hyp: DataFrame, duration: DataFrame, order: str = "turn_id") -> DataFrame:
    """Diarization error rate on 10 ms frames, computed on spans instead of frames.

    On overlap the row with the highest ``order`` overwrites the others.  Labels
    are compared as they are.  ``duration`` is (episode_id, duration_ms); frames
    beyond it do not count.
    """
    frames = duration.select("episode_id", floor_div(F.col("duration_ms"), FRAME_MS).alias("total_frames"))
    sides = _in_units(ref, FRAME_MS, order).withColumn("side", F.lit("r")).unionByName(
        _in_units(hyp, FRAME_MS, order).withColumn("side", F.lit("h"))
    )
    inside = sides.join(frames, "episode_id").withColumn("end_ms", F.least("end_ms", "total_frames")).drop(
        "total_frames"
    )
    cells = last_writer_cells(inside, "side", ["r", "h"], bucket_ms=FRAME_BUCKET)
    n = F.col("end_ms") - F.col("start_ms")
    r, h = F.col("who_r"), F.col("who_h")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    sums = cells.groupBy("episode_id").agg(
        total(r.isNotNull()).alias("ref_frames"),
        total(r.isNotNull() & h.isNull()).alias("missed"),
        total(r.isNull() & h.isNotNull()).alias("false_alarm"),
        total(r != h).alias("confusion"),
    )
    out = frames.join(sums, "episode_id", "left").na.fill(0)
    wrong = F.col("missed") + F.col("false_alarm") + F.col("confusion")
    rate = F.when(F.col("ref_frames") > 0, wrong / F.col("ref_frames")).otherwise(0.0)
    return out.withColumn("der", exact_round(rate, 4)).withColumn("der_pct", exact_round(rate * 100, 2))


def jer(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """1 - intersection/union of (100 ms tick, speaker) sets, from lengths of span unions."""
    sizes = tick_sets(ref, hyp)
    episodes = ref.select("episode_id").union(hyp.select("episode_id")).distinct()
    rate = F.when(
        F.coalesce("all_ticks", F.lit(0)) > 0, 1 - F.col("common_ticks") / F.col("all_ticks")
    ).otherwise(0.0)
    return episodes.join(sizes, "episode_id", "left").select("episode_id", exact_round(rate, 4).alias("jer"))


def tick_sets(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Sizes of the tick sets per episode: reference, hypothesis, intersection, union.

    |A and B| = |A| + |B| - |A or B|, each the length of a union of spans.
    """
    sides = _in_units(ref, TICK_MS).withColumn("side", F.lit("r")).unionByName(
        _in_units(hyp, TICK_MS).withColumn("side", F.lit("h"))
    )
    size = union_lengths(sides, ["episode_id", "speaker"], "side", ["r", "h"])
    return size.groupBy("episode_id").agg(
        F.sum("len_r").alias("ref_ticks"), F.sum("len_h").alias("hyp_ticks"),
        F.sum(F.col("len_r") + F.col("len_h") - F.col("len_all")).alias("common_ticks"),
        F.sum("len_all").alias("all_ticks"),
    )


# --- comparison of tools ------------------------------------------------------------


def tool_grid(asr: DataFrame, dia: DataFrame) -> DataFrame:
    """Per clip every ASR tool with every diarizer present there."""
    a = asr.select("clip", F.col("tool").alias("asr")).distinct()
    d = dia.select("clip", F.col("tool").alias("dia")).distinct()
    return a.join(d, "clip")


def pair_refs(hyp: DataFrame, ref: DataFrame, on: Sequence[str] = ("clip",)) -> tuple[DataFrame, DataFrame]:
    """(pairs, hypotheses without reference)."""
    return hyp.join(ref, list(on)), hyp.join(ref, list(on), "left_anti")


def pending(inputs: DataFrame, outputs: DataFrame, on: Sequence[str]) -> DataFrame:
    return inputs.join(outputs, list(on), "left_anti")


def wer_delta(results: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Relative improvement in percent over the baseline scenario of the same clip."""
    base = results.filter(F.col("scenario") == baseline).select("clip", F.col("wer").alias("base_wer"))
    delta = F.when(F.col("base_wer") != 0, (F.col("base_wer") - F.col("wer")) / F.col("base_wer") * 100)
    return results.join(base, "clip", "left").select("clip", "scenario", "wer", delta.alias("delta_pct"))


def decision_matrix(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted tool score from (tool, metric, value), lower values better.

    Values are min-max normalised per metric to 1 (best) .. 0; equal values are 1.
    """
    means = scores.groupBy("tool", "metric").agg(F.avg("value").alias("v"))
    span = means.groupBy("metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("metric"))
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("v")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return (
        means.join(span, "metric").withColumn("w", w).filter(F.col("w").isNotNull())
        .groupBy("tool").agg(F.sum(norm * F.col("w")).alias("score"), F.count(F.lit(1)).alias("metrics"))
    )


def stability(runs: DataFrame, by: Sequence[str] = ("tool", "stage")) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.count("rtf").alias("runs"), F.var_pop("rtf").alias("rtf_var"), F.stddev_pop("rtf").alias("rtf_std")
    )


def eval_report(
    grid: DataFrame, durations: DataFrame, wer_rows: DataFrame, der_rows: DataFrame, jer_rows: DataFrame, runtime: DataFrame
) -> DataFrame:
    """clip x asr x dia with WER %, DER %, JER and the mean real-time factor per tool."""
    rtf = lambda stage, name: runtime.filter(F.col("stage") == stage).groupBy(F.col("tool").alias(name)).agg(
        exact_round(F.avg("rtf"), 4).alias(f"rtf_{name}")
    )
    return (
        grid.join(durations, "clip", "left")
        .join(wer_rows.select("clip", "asr", F.col("wer_pct").alias("wer")), ["clip", "asr"], "left")
        .join(der_rows.select("clip", "dia", F.col("der_pct").alias("der")), ["clip", "dia"], "left")
        .join(jer_rows.select("clip", "dia", "jer"), ["clip", "dia"], "left")
        .join(rtf("asr", "asr"), "asr", "left")
        .join(rtf("diarization", "dia"), "dia", "left")
        .select(
            "clip", "asr", "dia", exact_round(F.col("duration_ms") / 1000, 2).alias("duration"), "wer", "der", "jer",
            F.coalesce("rtf_asr", F.lit(0.0)).alias("rtf_asr"), F.coalesce("rtf_dia", F.lit(0.0)).alias("rtf_dia"),
        )
    )


def eval_summary(report: DataFrame) -> DataFrame:
    """Report columns as text, missing values ``N/A``, in file order."""
    cols = ["clip", "asr", "dia", "duration", "wer", "cpwer", "der", "jer", "rtf_asr", "rtf_dia", "notes"]
    have = report
    for c in ("cpwer", "notes"):
        if c not in have.columns:
            have = have.withColumn(c, F.lit(None if c == "cpwer" else ""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c)
    return have.select(*[text(c) for c in cols])
