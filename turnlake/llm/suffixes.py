"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else are removed.

A full suffix array has one suffix per byte.  Here suffixes start on a grid that equal strings share: in every
window of ``MATCH`` bytes the least hashed ``SEED`` bytes are its anchor, which depends on the window alone, so
equal windows have their anchors at the same offset.  Consecutive windows with one anchor form a run; a run
is cut into cells of windows whose distances to the anchor lie between two grid lines.  All windows of a cell
contain its core.  A cell's suffix starts at the core, goes on to the end of the last window, and then back
from the core to the start of the first one, so suffixes with one core are neighbours in suffix order.

Per level (cells of 128, 16 and 1 windows):
1. two Bloom filters over core hashes leave cells whose core may occur twice; unique text goes no further;
2. each task sorts its suspects' suffixes into runs, front-codes them (common prefix with the predecessor and
   rest) and sends them to key ranges; ranges are cut at short prefixes, so suffixes with one core meet;
3. a loser tree merges the runs of a range; it knows every contender's common prefix with the last winner, so
   known prefixes are never compared again, and neighbours in suffix order come with their exact common length;
4. a common length of at least ``MATCH`` with a neighbour proves that many bytes repeated; cells with windows
   neither proved nor excluded go to the next level, with one copy of every other text around the same core.

Equal suffixes within one task prove each other there, and only one of them is sent: large groups of copies put no
more than one entry per task into a range.  All claims rest on compared bytes, never on hashes.

Null and empty texts, and texts shorter than ``MATCH`` bytes, lose nothing; rows equal in id and text repeat
each other; null ids are allowed; very long texts are scanned in overlapping stretches.  An empty table gives an
empty result.  Columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.session import settle

from . import text as tx
from .store import text_key
from .twins import bits_for, twice_seen

MATCH, SEED = 400, 32
GRID = (128, 16, 1)
SPLIT_BYTES = 16
#: A suffix carries its cell's grid line in LINE bytes after the first HEAD: equal suffixes then have equal offsets
#: to their anchors, and no place in a text can be mistaken for a second one.
HEAD, LINE = 32, 2
RUN_BYTES = 24 << 20
#: Rows of a batch that a step puts out.
ROWS = 4096
#: Bytes of text per cell of the first level that the filters are sized for.
CELL_BYTES = 75

#: Where a cell lies: span start, anchor, its windows, and those still open.
_PLACE = ("base", "anchor", "first", "last", "open_first", "open_last")
NOWHERE = (None,) * (len(_PLACE) + 1)

_POSITION = np.uint64((1 << 23) - 1)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of text per numpy pass: its arrays of eight bytes a byte stay in a core's cache.
SCAN_BYTES = 1 << 17


def anchors(sums: tx.Sums, offsets: np.ndarray, match: int = MATCH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one anchor: row, anchor, first and last window start."""
    n, wide = len(sums.total) - 1, match - seed + 1
    if n < match or n > int(_POSITION):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    rank = sums.total[seed:] - sums.total[: n - seed + 1]
    rank *= sums.down[: len(rank)]
    rank ^= rank >> np.uint64(32)
    rank *= _SPREAD
    rank &= ~_POSITION
    rank |= np.arange(len(rank), dtype=np.uint64)
    # Least rank of every window, from those of twice as many places at each step.
    size = 1
    while 2 * size <= wide:
        rank = np.minimum(rank[:-size], rank[size:])
        size *= 2
    if size < wide:
        rank = np.minimum(rank[: size - wide], rank[wide - size :])
    new = np.ones(len(rank), bool)
    np.not_equal(rank[1:], rank[:-1], out=new[1:])
    new[offsets[:-1][np.diff(offsets) >= match]] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(offsets, first, "right") - 1
    inside = first + match <= offsets[row + 1]  # no window goes on into the next row
    first, row = first[inside], row[inside]
    last = np.minimum(np.append(first[1:] - 1, n), offsets[row + 1] - match)
    return row, (rank[first] & _POSITION).astype(np.int64), first, last


class Cells:
    """Cells of runs on one grid, as arrays over flat data: owner run, windows, span, and core hash."""

    def __init__(self, sums: tx.Sums, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, grid: int, match: int):
        near, far = (anchor - last) // grid, (anchor - first) // grid
        count = far - near + 1
        self.run = np.repeat(np.arange(len(anchor)), count)
        j = near[self.run] + np.arange(len(self.run)) - np.repeat(np.cumsum(count) - count, count)
        p = anchor[self.run]
        nearest, farthest = p - grid * j, p - grid * j - grid + 1
        self.first, self.last = np.maximum(first[self.run], farthest), np.minimum(last[self.run], nearest)
        self.start, self.end = np.maximum(low[self.run], farthest), np.minimum(high[self.run], nearest + match)
        self.core = sums.hash(nearest, farthest + match) ^ tx.mix(j.astype(np.uint64)) if len(j) else np.zeros(0, np.uint64)
        self.anchor, self.nearest, self.line = p, nearest, j


def _stretches(batch: pa.RecordBatch, match: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Rows with flat bytes and offsets; a text longer than a slice comes in overlapping stretches."""
    for part in tx.slices(batch, limit=SCAN_BYTES):
        data, offsets = tx.flat(part.column("text"))
        if len(data) <= 2 * tx.SLICE_BYTES:
            yield part, data, offsets, 0
            continue
        for k in range(part.num_rows):  # one row, by construction of the slices
            for at in range(0, max(1, len(data) - match + 1), tx.SLICE_BYTES):
                piece = data[at : at + tx.SLICE_BYTES + match - 1]
                yield part.slice(k, 1), piece, np.array([0, len(piece)]), at


def _text_cells(batch: pa.RecordBatch, grid: int, match: int, seed: int):
    for part, data, offsets, shift in _stretches(batch, match):
        sums = tx.Sums(data)
        row, anchor, first, last = anchors(sums, offsets, match, seed)
        cells = Cells(sums, anchor, first, last, offsets[row], offsets[row + 1], grid, match)
        yield part, data, cells, row, np.full(len(row), shift) - offsets[row], cells.first, cells.last


def _strip_cells(batch: pa.RecordBatch, grid: int, match: int):
    for part in tx.slices(batch, "strip", SCAN_BYTES):
        data, offsets = tx.flat(part.column("strip"))
        at = offsets[:-1]
        base, anchor, first, last, low, high = (part.column(c).to_numpy() for c in ("base", "anchor", "first", "last", "open_first", "open_last"))
        cells = Cells(tx.Sums(data), anchor - base + at, first - base + at, last - base + at, at, offsets[1:], grid, match)
        low, high = (low - base + at)[cells.run], (high - base + at)[cells.run]
        yield part, data, cells, np.arange(part.num_rows), base - at, np.maximum(cells.first, low), np.minimum(cells.last, high)


def lcp(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are common already."""
    n, step = min(len(a), len(b)), 16
    while known < n:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            size = min(len(x), len(y))
            differ = int.from_bytes(x[:size]) ^ int.from_bytes(y[:size])
            return known + size - (differ.bit_length() + 7) // 8
        known += step
        step *= 4
    return n


def front_code(strings: list[bytes]) -> list[tuple[int, bytes]]:
    """Common prefix with the predecessor, and the rest, of sorted strings."""
    out, before = [], b""
    for s in strings:
        same = lcp(before, s, 0)
        out.append((same, s[same:]))
        before = s
    return out


def merge(runs: list[Iterator[tuple[int, bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merge front-coded sorted runs of (common prefix, rest, item) into (string, common prefix with the last, item).

    A loser tree: every node holds the run that lost there, with its common prefix with the winner of that
    match, which is the last output once the winner has left.  Unequal common prefixes decide without a look
    at the strings; equal ones are compared from there on.
    """
    k = len(runs)
    text: list[bytes | None] = [b""] * k
    item, same = [0] * k, [0] * k

    def pull(r: int) -> None:
        got = next(runs[r], None)
        if got is None:
            text[r], same[r] = None, -1
        else:
            text[r], same[r], item[r] = text[r][: got[0]] + got[1], got[0], got[2]

    def beats(a: int, b: int) -> bool:
        """Whether run a goes first; the loser's common prefix becomes that with the winner."""
        if same[a] != same[b]:
            return same[a] > same[b]
        if text[a] is None:
            return True
        common = lcp(text[a], text[b], same[a])
        x, y = text[a], text[b]
        wins = common == len(x) or (common < len(y) and x[common] < y[common])
        same[b if wins else a] = common
        return wins

    for r in range(k):
        pull(r)
        if same[r] > 0:
            same[r] = 0
    tree = [0] * k
    best = list(range(k))
    level = [None] * k + best
    for node in range(k - 1, 0, -1):
        a, b = level[2 * node], level[2 * node + 1]
        level[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    winner = level[1] if k > 1 else 0
    while k and text[winner] is not None:
        yield text[winner], same[winner], item[winner]
        pull(winner)
        node = (winner + k) // 2
        while node:
            if not beats(winner, tree[node]):
                winner, tree[node] = tree[node], winner
            node //= 2


def _level(source: DataFrame, kinds: tuple[T.DataType, T.DataType], grid: int, splits: list[bytes], bits: int, ranges: int, match: int, seed: int, label: str) -> DataFrame:
    """One round: covered byte ranges (low, high), and strips with windows still open."""
    top = "text" in source.columns

    def cells_of(batch: pa.RecordBatch):
        return _text_cells(batch, grid, match, seed) if top else _strip_cells(batch, grid, match)

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, cells, *_ in cells_of(batch):
            yield cells.core

    seen = source.sparkSession.sparkContext.broadcast(twice_seen(source, hashes, bits))
    id_type, own_type = kinds
    core = match - grid + 1 + LINE
    meta = [T.StructField("id", id_type), T.StructField("own", own_type)]
    numbers = list(_PLACE)
    sent = T.StructType([
        T.StructField("range", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("place", T.IntegerType()),
        T.StructField("same", T.IntegerType()), T.StructField("rest", T.BinaryType()), T.StructField("right", T.IntegerType()),
        *meta, *(T.StructField(n, T.LongType()) for n in numbers),
    ])
    found = T.StructType([*meta, *(T.StructField(n, T.LongType()) for n in ("low", "high", *numbers)), T.StructField("strip", T.BinaryType())])

    marks = [k.to_bytes(LINE) for k in range(match)]

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, size = TaskContext.get().partitionId(), 0, 0
        strings: list[bytes] = []
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []  # ids, owns, and rows: right, _PLACE

        def flush() -> Iterator[pa.RecordBatch]:
            ids, owns = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            numbers = np.concatenate([h[2] for h in held], axis=1)
            order = np.argsort(numbers[0], kind="stable").tolist()
            order.sort(key=strings.__getitem__)  # equal strings by their right parts
            ordered, order = [strings[k] for k in order], np.array(order)
            right = numbers[0][order]
            new = np.ones(len(order), bool)
            new[1:] = np.fromiter(map(ne, ordered[1:], ordered), bool, len(order) - 1) | (right[1:] != right[:-1])
            head = np.flatnonzero(new)
            many = np.diff(np.append(head, len(order))) > 1
            # Equal suffixes are proved here, and one of them goes on without an owner.
            proved = order[many[np.cumsum(new) - 1]]
            proved = proved[owns.is_valid().to_numpy(zero_copy_only=False)[proved]]
            base = numbers[1][proved]
            end = base + np.fromiter((len(strings[k]) for k in proved), np.int64, len(proved)) - LINE
            spread = (np.arange(len(proved)) + task) % ranges
            for at in range(0, len(proved), ROWS):
                part = slice(at, at + ROWS)
                n = len(proved[part])
                columns = [spread[part], np.full(n, -1), np.zeros(n, np.int64), None, None, None,
                           ids.take(pa.array(proved[part])), owns.take(pa.array(proved[part])), base[part], end[part], *[None] * 4]
                yield _batch(columns, sent)
            kept, order = [ordered[k] for k in head], order[head]
            borders = [0, *(bisect_left(kept, split) for split in splits), len(kept)]
            where = np.repeat(np.arange(len(splits) + 1), np.diff(borders))
            coded = [c for a, b in zip(borders, borders[1:]) for c in front_code(kept[a:b])]
            for at in range(0, len(kept), ROWS):
                part = slice(at, at + ROWS)
                use, (same, rest) = order[part], zip(*coded[part])
                who = pa.array(use, pa.int64(), mask=many[part])
                columns = [where[part], np.full(len(use), (task << 20) + count), np.arange(at, at + len(use)), same, rest, numbers[0][use],
                           ids.take(who), owns.take(who), *numbers[1:, use]]
                yield _batch(columns, sent)

        for batch in batches:
            for part, data, cells, row, shift, low, high in cells_of(batch):
                use = np.flatnonzero(seen.value.suspects(cells.core))
                if not len(use):
                    continue
                raw = data.tobytes()
                back = raw[::-1]
                a, c, b, d = cells.start[use], cells.nearest[use], cells.end[use], shift[cells.run[use]]
                n = len(raw)
                for start, at, to, line in zip(a.tolist(), c.tolist(), b.tolist(), cells.line[use].tolist()):
                    strings.append(raw[at : at + HEAD] + marks[line] + raw[at + HEAD : to] + back[n - at : n - start])
                owner = pa.array(row[cells.run[use]], pa.int64(), mask=low[use] > high[use])
                places = (a, cells.anchor[use], cells.first[use], cells.last[use], low[use], high[use])
                held.append((part.column("id").take(owner), part.column("own").take(owner), np.stack([b - c, *(v + d for v in places)])))
                size += int((b - a).sum())
                if size >= RUN_BYTES:
                    yield from flush()
                    strings, held, size, count = [], [], 0, count + 1
        if strings:
            yield from flush()

    def merge_range(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = pa.Table.from_batches(parts)
        ids, owns = (entries.column(c).combine_chunks() for c in ("id", "own"))
        numbers = [entries.column(c).to_numpy() for c in ("right", *_PLACE)]
        owned = owns.is_valid().to_numpy(zero_copy_only=False)
        columns = [owned.tolist(), *(c.tolist() for c in numbers)]
        run = entries.column("run").to_numpy()
        edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
        same = entries.column("same").to_numpy().tolist()
        rest = [r for part in parts for r in _strings(part.column("rest"))]
        runs = [zip(same[a:b], rest[a:b], range(a, b)) for a, b in zip(edges, edges[1:])]
        covers: list[tuple[int, int, int]] = []  # item, low, high
        strips: list[tuple[int, int, bytes]] = []  # item, last open window, strip

        def emit() -> Iterator[pa.RecordBatch]:
            if covers:
                item, low, high = zip(*covers)
                at = pa.array(item, pa.int64())
                yield _batch([ids.take(at), owns.take(at), low, high, *NOWHERE], found)
            if strips:
                item, open_last, strip = zip(*strips)
                at, open_last = np.array(item), np.array(open_last)
                base, anchor, first, last, open_first = (c[at] for c in numbers[1:6])
                text_only = open_last < 0
                who, shift = pa.array(at, pa.int64(), mask=text_only), np.where(text_only, base, 0)
                places = (base - shift, anchor - shift, first - shift, last - shift, np.where(text_only, 0, open_first), open_last)
                yield _batch([ids.take(who), owns.take(who), None, None, *places, strip], found)
            covers.clear()
            strips.clear()

        group: list[tuple[bytes, int, int]] = []  # suffixes with one core: text, common length, item
        for now in merge(runs):
            if now[1] < core and group:
                if len(group) > 1:  # a lone suffix has no neighbour to prove anything
                    settle_group(group, columns, covers, strips)
                    if len(covers) + len(strips) >= ROWS:
                        yield from emit()
                group = []
            group.append(now)
        if len(group) > 1:
            settle_group(group, columns, covers, strips)
        yield from emit()

    def settle_group(group: list[tuple[bytes, int, int]], columns: list[list], covers: list[tuple], strips: list[tuple]) -> None:
        owned, rights, bases, _, _, _, open_firsts, open_lasts = columns
        still: list[tuple[int, int, bytes]] = []
        around: list[tuple[int, int, bytes]] = []
        for k, (text, same, item) in enumerate(group):
            right, base, own, open_last = rights[item], bases[item], owned[item], open_lasts[item]
            size = len(text) - LINE
            if own:
                nearest = base + size - right
                beside = [(n, (same if n < k else group[n][1]) - LINE, rights[group[n][2]]) for n in (k - 1, k + 1) if 0 <= n < len(group)]
                if any(r == right and group[n][0] == text for n, _, r in beside):
                    covers.append((item, base, base + size))
                    own = False
                elif right >= match:
                    # A neighbour cut off at its text's end says nothing beyond its last byte.
                    common = max(c if r >= match else min(c, r) for _, c, r in beside)
                    if common >= match:
                        covers.append((item, nearest - (common - match), nearest + match))
                        open_last = min(open_last, nearest - (common - match) - 1)
                    elif all(c < match for _, c, _ in beside):
                        open_last = min(open_last, nearest - 1)
            if grid > 1:
                plain = text[:HEAD] + text[HEAD + LINE :]
                strip = plain[right:][::-1] + plain[:right]
                if own and open_firsts[item] <= open_last:
                    still.append((item, open_last, strip))
                else:
                    around.append((item, -1, strip))
        if still:
            strips += still
            strips += around

    def merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            run = batch.column("run").to_numpy()
            if (run < 0).any():  # proved where it was found
                done = batch.filter(pa.array(run < 0))
                yield _batch([*(done.column(c) for c in ("id", "own", "base", "anchor")), *NOWHERE], found)
                batch = batch.filter(pa.array(run >= 0))
            where = batch.column("range").to_numpy()
            edges = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if parts and where[a] != current:
                    yield from merge_range(parts)
                    parts = []
                current = where[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from merge_range(parts)

    runs = source.mapInArrow(sort_runs, sent)
    ranged = runs.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "run", "place")
    return settle(ranged.mapInArrow(merge_all, found), label)


def _batch(columns: list, schema: T.StructType) -> pa.RecordBatch:
    """Arrow arrays as they are, other sequences by the schema's types; None is a column of nulls."""
    from pyspark.sql.pandas.types import to_arrow_type

    n = next(len(c) for c in columns if c is not None)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    arrays = [pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, schema.names)


def _strings(column: pa.Array) -> list[bytes]:
    data, offsets = tx.flat(column)
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _splits(source: DataFrame, ranges: int, texts: int = 4096) -> list[bytes]:
    """Range borders from short prefixes at a few places of at most ``texts`` texts."""
    size = F.char_length("text")
    some = source.where(F.length("text") > 0).select("text", size.alias("n"), F.xxhash64("text").alias("h")).where(
        F.pmod("h", F.lit(8)) == 0
    ).limit(texts)
    places = [F.substring("text", (F.pmod(F.xxhash64("h", F.lit(k)), F.col("n")) + 1).cast("int"), F.lit(SPLIT_BYTES)) for k in range(4)]
    got = sorted(bytes(r[0])[:SPLIT_BYTES] for r in some.select(F.explode(F.array(*(p.cast("binary") for p in places)))).collect())
    return sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []


def _own(text: str) -> Column:
    """``store.text_key`` as 17 bytes, which travel with every suffix."""
    key = text_key(text)
    digits = [F.lpad(F.hex(key.getField(k)), 16, "0") for k in ("a", "b")]
    return F.unhex(F.concat(*digits, F.when(key.getField("null"), "01").otherwise("00")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, seed: int = SEED, grid: tuple[int, ...] = GRID) -> DataFrame:
    """(id, own, spans): byte ranges proved repeated, per document (own: ``_own`` of its text)."""
    source = docs.select(F.col(id_col).alias("id"), _own(text_col).alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = source.schema["id"].dataType, source.schema["own"].dataType
    ranges = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = _splits(source, ranges)
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    at, bits, covers = source, bits_for(total // CELL_BYTES), []
    for k, size in enumerate(grid):
        done = _level(at, kinds, size, splits, bits, ranges, match, seed, f"suffixes-{size}")
        covers.append(done.where("low is not null").select("id", "own", "low", "high"))
        if k + 1 < len(grid):
            at = done.where("strip is not null").select("id", "own", *_PLACE, "strip")
            bits = bits_for(at.count() * -(-size // grid[k + 1]))
    covered = covers[0]
    for c in covers[1:]:
        covered = covered.union(c)
    return covered.groupBy("id", "own").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed ranges) and ``kept`` bytes."""
    spans = repeated_spans(docs, id_col, text_col, **options).withColumnsRenamed({"id": "_id", "own": "_own"})
    source = docs.select(F.col(id_col).alias("id"), _own(text_col).alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    joined = source.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own")), "left").select("id", "text", "spans")
    span_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    names = ["id", "n_bytes", "n_removed", "spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in tx.slices(whole):
                data, offsets = tx.flat(part.column("text"))
                found = part.column("spans")
                row = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
                low, high = (c.to_numpy() for c in pc.list_flatten(found).flatten())
                order = np.lexsort((low, row))
                row, low, high = row[order], low[order] + offsets[row[order]], high[order] + offsets[row[order]]
                # Rows lie one after another, so spans of one row reach no other's, but may touch them.
                reach = np.maximum.accumulate(high) if len(high) else high
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (low[1:] > reach[:-1])
                first = np.flatnonzero(new)
                row, low, high = row[first], low[first], reach[np.append(first[1:], len(reach))[: len(first)] - 1]
                edge = np.zeros(len(data) + 1, np.int8)
                np.add.at(edge, low, 1)
                np.add.at(edge, high, -1)
                left = data[np.cumsum(edge[:-1], dtype=np.int8) == 0]
                gone = np.concatenate(([0], np.cumsum(np.bincount(row, high - low, part.num_rows).astype(np.int64))))
                at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows))))
                merged = pa.StructArray.from_arrays([pa.array(low - offsets[row]), pa.array(high - offsets[row])], ["low", "high"])
                kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets - gone), pa.py_buffer(left)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(offsets)), pa.array(np.diff(gone)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), merged).cast(span_type),
                     kept.cast(pa.binary())], names)

    kind = source.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, spans array<struct<low: long, high: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
