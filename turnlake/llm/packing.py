"""Pack documents into fixed-length token sequences: cutting stock by column generation.

Every document becomes its token ids and an end id, cut into pieces of at most ``LENGTH``.  The histogram of
piece lengths (at most ``LENGTH / UNIT`` classes, whatever the corpus) goes to the driver.  There a linear
program chooses how often each pattern of lengths is used; a knapsack dynamic program prices new patterns
from the dual values until the bound says that no more than ``GAP`` can be gained.  Pattern counts are
rounded down; piece number r of its length class goes to the pattern and copy that owns place r.  Pieces that
no full pattern takes are laid end to end and cut at sequence borders; the last, partial sequence is cut
into powers of two, which need no padding.

Null and empty texts are one end id.  Null or repeated document ids are fine: every row is its own document.
An empty table gives an empty result.  Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.session import settle

from . import text as tx
from .bpe import vocabulary
from .store import BROADCAST_ROWS

LENGTH = 2048
END_ID = 1
#: Lengths are rounded up to multiples of UNIT in the program; pieces of up to SMALL ids fill the stream.
UNIT, SMALL = 8, 64
GAP = 0.001
FULL = 0.985
SALTS = 64


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of each document: id, start, length, ids, their checksum, and the document's number of ids."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer)
        for whole in batches:
            for part in tx.slices(whole, limit=tx.SLICE_BYTES // 2):
                flat, at = words.encode([t or "" for t in part.column("text").to_pylist()])
                flat = np.insert(flat, at[1:], END_ID).astype("<i4", copy=False)
                at = at + np.arange(len(at))
                total = np.diff(at)
                cuts = -(-total // length)
                row = np.repeat(np.arange(len(total)), cuts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * length
                where = np.append(at[:-1][row] + start, at[-1])
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
                ids = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row)), pa.array(start), pa.array(np.diff(where)), pa.array(crc, pa.int64()), pa.array(total[row]), ids], names)
        tx.release()

    return source.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")


def size_class(length: np.ndarray) -> np.ndarray:
    """A length in units, rounded up."""
    return -(-length // UNIT)


def price(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (unbounded knapsack), and how often it takes each."""
    use = np.flatnonzero(value > 1e-12)
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    s, v = sizes[use], value[use]
    order = np.argsort(s, kind="stable")
    s, v, use = s[order], v[order], use[order]
    fit = np.searchsorted(s, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if fit[c]:
            total = best[c - s[: fit[c]]] + v[: fit[c]]
            k = int(total.argmax())
            if total[k] > best[c]:
                best[c], pick[c] = total[k], k
    count = np.zeros(len(sizes), np.int64)
    c = room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[use[pick[c]]] += 1
            c -= s[pick[c]]
    return float(best[room]), count


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int = LENGTH // UNIT, gap: float = GAP, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one row each, counts per size) and their real-valued numbers in the linear program's optimum.

    Revised simplex over equality rows; the first basis cuts each size by itself.
    """
    m = len(sizes)
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns)) if m else np.zeros((0, 0))
    x = inverse @ demand
    for _ in range(rounds if m else 0):
        dual = inverse.sum(0)
        top, column = price(sizes, dual, room)
        if top <= 1 + 1e-9 or x.sum() * (1 - 1 / top) <= gap * x.sum():
            break
        direction = inverse @ column
        move = direction > 1e-9
        if not move.any():
            break
        ratio = np.where(move, x / np.where(move, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        columns[:, out] = column
    return columns.T.astype(np.int64), x


class Plan:
    """Which pattern and copy owns place r of a length class; built from the histogram alone."""

    def __init__(self, histogram: dict[int, int]):
        sizes = self.classes = np.array(sorted(c for c in histogram if c > SMALL // UNIT), np.int64)
        have = np.array([histogram[int(c)] for c in self.classes], np.int64)
        found, x = patterns(sizes, have.astype(float))
        number = np.floor(x + 1e-6).astype(np.int64)
        number[found @ sizes < FULL * LENGTH // UNIT] = 0
        use = np.flatnonzero(number)
        found, number = found[use], number[use]
        # A shortage can only come from rounding noise: then take copies back.
        while len(found) and ((found * number[:, None]).sum(0) > have).any():
            over = int(np.argmax((found * number[:, None]).sum(0) - have))
            number[np.flatnonzero((found[:, over] > 0) & (number > 0))[0]] -= 1
        self.sequences = int(number.sum())
        first = np.concatenate(([0], np.cumsum(number)))
        self.table = {}
        for k, c in enumerate(self.classes):
            by = np.flatnonzero(found[:, k]) if len(found) else np.zeros(0, np.int64)
            each = found[by, k] if len(by) else by
            places = np.concatenate(([0], np.cumsum(each * number[by] if len(by) else by)))
            self.table[int(c)] = (places, each, first[by] if len(by) else by)

    def sequence(self, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Sequence of each (class, place); -1 for pieces that no pattern takes."""
        out = np.full(len(cls), -1, np.int64)
        for c in np.unique(cls):
            if int(c) not in self.table:
                continue
            at = np.flatnonzero(cls == c)
            places, each, first = self.table[int(c)]
            k = np.searchsorted(places, place[at], "right") - 1
            inside = np.flatnonzero(k < len(each))
            k = k[inside]
            out[at[inside]] = first[k] + (place[at[inside]] - places[k]) // each[k]
        return out


def borders(total: int, length: int = LENGTH) -> np.ndarray:
    """Cuts of the last, partial sequence of a stream into powers of two, as stream positions."""
    at, rest, cuts = total - total % length, total % length, []
    for bit in range(length.bit_length(), -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    return np.array(cuts, np.int64)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the settled row
    (``row``, ``skip``) that holds its ids; see ``sequences``."""
    return _pack(docs, tokenizer, id_col, text_col)[0]


def sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids."""
    placed, held = _pack(docs, tokenizer, id_col, text_col)
    parts = placed.join(held.select("row", "ids"), "row").select(
        "sequence_id", F.struct("offset", F.slice("ids", (F.col("skip") + 1).cast("int"), F.col("length").cast("int")).alias("ids")).alias("part")
    )
    # A sequence has at most LENGTH pieces.
    whole = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))
    return whole.select("sequence_id", F.size("ids").alias("n_tokens"), "ids")


def _pack(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    held = settle(
        pieces(docs, tokenizer, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pack-pieces"
    )
    cls = F.ceil(F.col("length") / UNIT).cast("int")
    narrow = held.drop("ids").withColumn("class", cls).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))

    counts = narrow.groupBy("class", "salt").count().orderBy("class", "salt").collect()  # at most classes x SALTS rows
    histogram: dict[int, int] = {}
    places = []
    for r in counts:
        places.append((r["class"], r["salt"], histogram.get(r["class"], 0)))
        histogram[r["class"]] = histogram.get(r["class"], 0) + r["count"]
    plan = Plan(histogram)
    first = F.broadcast(spark.createDataFrame(places, "class int, salt int, first long"))
    order = W.partitionBy("class", "salt").orderBy("row")
    ranked = narrow.withColumn("nth", F.row_number().over(order)).join(first, ["class", "salt"]).withColumn(
        "place", F.col("first") + F.col("nth") - 1
    ).drop("first", "nth")
    names = ranked.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = plan.sequence(b.column("class").to_numpy(), b.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*names, "sequence_id"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    assigned = settle(ranked.mapInArrow(assign, f"{kinds}, sequence_id long"), "pack-assigned")

    by_sequence = W.partitionBy("sequence_id").orderBy(F.desc("class"), "row").rowsBetween(W.unboundedPreceding, -1)
    whole = assigned.where("sequence_id >= 0").select(
        "id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(by_sequence), F.lit(0)).alias("offset"),
        "row", F.lit(0).cast("long").alias("skip"),
    )
    return whole.unionByName(_stream(assigned, held, plan.sequences)).withColumnRenamed("id", id_col), held


def _stream(assigned: DataFrame, held: DataFrame, taken: int) -> DataFrame:
    """Pieces without a pattern, laid end to end over (class, salt, row) and cut at sequence borders."""
    spark = assigned.sparkSession
    rest = assigned.where("sequence_id < 0").drop("sequence_id", "place")
    sums = rest.groupBy("class", "salt").agg(F.sum("length").alias("tokens")).orderBy("class", "salt").collect()
    starts, total = [], 0
    for r in sums:
        starts.append((r["class"], r["salt"], total))
        total += r["tokens"]
    first = F.broadcast(spark.createDataFrame(starts, "class int, salt int, first long"))
    order = W.partitionBy("class", "salt").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    laid = rest.withColumn("before", F.coalesce(F.sum("length").over(order), F.lit(0))).join(first, ["class", "salt"]).withColumn(
        "at", F.col("first") + F.col("before")
    )
    tail = borders(total)
    full = total // LENGTH
    # Sequence borders inside a piece: multiples of LENGTH, and those of the partial last sequence.
    last = F.array(*(F.lit(int(c)).cast("long") for c in tail)) if len(tail) else F.array().cast("array<long>")
    end = F.col("at") + F.col("length")
    step = F.expr(f"sequence(at div {LENGTH} + 1, greatest(at div {LENGTH} + 1, (at + length - 1) div {LENGTH}))")
    inner = F.filter(
        F.array_distinct(F.concat(F.transform(step, lambda k: k * LENGTH), last)), lambda c: (c > F.col("at")) & (c < end)
    )
    cut = laid.withColumn("cuts", F.array_sort(F.concat(F.array(F.col("at")), inner, F.array(end)))).withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1))
    )
    begin, stop = F.element_at("cuts", F.col("k")), F.element_at("cuts", F.col("k") + 1)
    borders_passed = F.size(F.filter(last, lambda c: c <= F.col("begin")))
    cut = cut.withColumn("begin", begin).withColumn("stop", stop).withColumn("skip", F.col("begin") - F.col("at"))
    base = F.when(
        F.col("begin") < full * LENGTH, F.expr(f"begin div {LENGTH}")
    ).otherwise(F.lit(full) + borders_passed)
    seq_start = F.when(F.col("begin") < full * LENGTH, F.expr(f"begin div {LENGTH} * {LENGTH}")).otherwise(
        F.greatest(F.lit(full * LENGTH), F.coalesce(F.array_max(F.filter(last, lambda c: c <= F.col("begin"))), F.lit(0)))
    )
    cut = cut.withColumn("sequence_id", (taken + base).cast("long")).withColumn("offset", F.col("begin") - seq_start)
    parts = cut.withColumn("whole", F.size("cuts") == 2).withColumn("size", F.col("stop") - F.col("begin")).select(
        "id", (F.col("start") + F.col("skip")).alias("start"), F.col("size").alias("length"), "ids_crc32", "doc_tokens",
        "sequence_id", "offset", "row", "skip", "whole",
    )
    parts = settle(parts, "pack-stream")
    broken = parts.where("not whole")
    # Every border cuts one piece at most, so the number of cut pieces is known before the join.
    broken = F.broadcast(broken) if 2 * (full + len(tail)) <= BROADCAST_ROWS else broken
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    names = parts.columns
    ids = held.select("row", "ids").join(broken, "row").select(
        *names, F.slice("ids", (F.col("skip") + 1).cast("int"), F.col("length").cast("int")).alias("ids")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [zlib.crc32(np.array(v, "<u4").tobytes()) for v in b.column("ids").to_pylist()]
            columns = {n: b.column(n) for n in names} | {"ids_crc32": pa.array(sums, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return parts.where("whole").unionByName(ids.mapInArrow(check, kinds)).drop("whole")
