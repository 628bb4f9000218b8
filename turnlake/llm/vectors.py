"""Embedding near-duplicates by spherical-cap filters.

Vectors are turned by a random rotation and cut into blocks.  Each block has a small code of random unit
vectors; a filter is one choice of code word per block, its direction their sum (a random product code).  Every
vector is list-decoded to the ``FILTERS`` filters it exceeds most, block by block, without looking at all.
Vectors of one label meet where they share a filter; a sign sketch discards pairs that are far apart inside the
join, and the cosine in double precision decides.

Equal vectors of a label form one class first, so copies are never paired: links between classes count for
all their members.  A null label, and vectors that are null, zero or hold null or non-finite numbers, link with
nothing.  Vectors of different length never link.  Null ids and repeated rows are vectors like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.session import settle

from .components import labels

FILTERS = 16
BLOCKS, WORDS = 4, 32
SKETCH_BITS = 256


@lru_cache(maxsize=4)
def _code(dim: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[slice]]:
    """Rotation, code words per block, sketch directions and block ranges for vectors of this length."""
    rng = np.random.default_rng(dim)
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    ranges = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    code = []
    for r in ranges:
        words = rng.standard_normal((WORDS, r.stop - r.start))
        code.append(words / np.linalg.norm(words, axis=1, keepdims=True))
    return turn, code, rng.standard_normal((dim, SKETCH_BITS)), ranges


@lru_cache(maxsize=16)
def _ranks(a: int, b: int, best: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank pairs that can be among the ``best`` largest sums of two descending lists."""
    i, j = np.divmod(np.arange(a * b), b)
    keep = (i + 1) * (j + 1) <= best
    return i[keep], j[keep]


def _top(score: np.ndarray, ident: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-score, axis=1, kind="stable")[:, :best]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ident, order, 1)


def list_decode(unit: np.ndarray, best: int = FILTERS) -> np.ndarray:
    """Identities of the ``best`` filters with the largest inner products, per row."""
    turn, code, _, ranges = _code(unit.shape[1])
    turned = unit @ turn
    total = ident = None
    for r, words in zip(ranges, code):
        score = turned[:, r] @ words.T
        score, word = _top(score, np.broadcast_to(np.arange(len(words)), score.shape), best)
        if total is None:
            total, ident = score, word
            continue
        i, j = _ranks(total.shape[1], score.shape[1], best)
        total, ident = _top(total[:, i] + score[:, j], ident[:, i] * WORDS + word[:, j], best)
    return ident


def _decode(classes: DataFrame, best: int) -> DataFrame:
    """(key, c, s0..s3) per class and filter."""
    names = ["key", "c", *(f"s{k}" for k in range(SKETCH_BITS // 64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                c, label = b.column("c").to_numpy(), b.column("label_hash").to_numpy()
                rows = b.column("embedding").to_pylist()
                size = np.array([len(r) for r in rows])
                for dim in np.unique(size):
                    use = np.flatnonzero(size == dim)
                    x = np.array([rows[k] for k in use], float)
                    x /= np.abs(x).max(1, keepdims=True)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    found = list_decode(unit, best)
                    bits = np.packbits(unit @ _code(int(dim))[2] > 0, axis=1).view(np.int64)
                    key = (found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)) ^ label[use].astype(np.uint64)[:, None]
                    n = found.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(c[use], n)),
                         *(pa.array(np.repeat(bits[:, k], n)) for k in range(bits.shape[1]))], names)

    return classes.select("c", F.xxhash64("label").alias("label_hash"), "embedding").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _verify(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes with equal labels and cosine >= threshold."""
    side = lambda n: classes.select(F.col("c").alias(n), F.col("label").alias(f"l{n}"), F.col("embedding").alias(f"e{n}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("la") == F.col("lb")) & (F.size("ea") == F.size("eb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ea, eb = b.column("ea"), b.column("eb")
            size = np.diff(ea.offsets.to_numpy())
            ok = np.zeros(b.num_rows, bool)
            for dim in np.unique(size):
                use = np.flatnonzero(size == dim)
                x, y = (v.take(pa.array(use)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) for v in (ea, eb))
                x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                ok[use] = cosine >= threshold
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])

    return full.select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def near_vectors(table: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", filters: int = FILTERS) -> tuple[DataFrame, DataFrame]:
    """Per vector: id, ``n_links``, ``component_id``, ``kept``; and the links between classes (a, b)."""
    v = F.col("embedding")
    big = v.cast("array<double>")
    sound = (
        v.isNotNull() & F.col("label").isNotNull() & F.forall(big, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(big, lambda x: x != 0)
    )
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = rows.withColumn("c", F.when(F.col("sound"), F.xxhash64("label", "embedding")))
    classes = settle(
        rows.where("sound").groupBy("c").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first")),
        "vector-classes",
    )
    # How far apart the sketches of two vectors at the threshold may be: six deviations above the mean.
    p = float(np.arccos(threshold) / np.pi)
    limit = int(np.ceil(SKETCH_BITS * p + 6 * np.sqrt(SKETCH_BITS * p * (1 - p))))
    caps = settle(_decode(classes, filters), "vector-filters")
    signs = [n for n in caps.columns if n[0] == "s"]
    other = caps.select("key", F.col("c").alias("d"), *(F.col(n).alias(f"t{n}") for n in signs))
    apart = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"t{n}"))) for n in signs), F.lit(0))
    pairs = caps.join(other, "key").where((F.col("c") < F.col("d")) & (apart <= limit)).select(F.col("c").alias("a"), F.col("d").alias("b")).distinct()
    links = settle(_verify(pairs, classes, threshold), "vector-links")

    weight = classes.select(F.col("c").alias("to"), F.col("n").alias("m"))
    both = links.union(links.select("b", "a"))
    degree = both.join(weight, both["b"] == weight["to"]).groupBy(F.col("a").alias("c")).agg(F.sum("m").alias("linked"))
    found = classes.select("c", "n", "first").join(degree, "c", "left")
    found = found.join(labels(links).withColumnRenamed("node", "c"), "c", "left")
    smallest = found.where("label is not null").groupBy("label").agg(F.min("first").alias("smallest"))
    found = found.join(smallest, "label", "left").select(
        "c", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("smallest", "first").alias("component_id")
    )
    out = rows.select("id", "c").join(found, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    ), links
