"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its shingles.  The sketch has ``COORDINATES`` values.  In round i every
element is thrown into one bin with value i plus a fraction; a bin keeps its least value.  Rounds go on until every
bin is filled, and from round COORDINATES on, bin i - COORDINATES takes all elements, so it always ends.  Large
sets need one or two rounds instead of one hash per coordinate and element.

Documents with equal sets form a class first.  Classes that agree in all coordinates of a band share a bucket.
Each bucket first compares its members with one centre only, and verified links are contracted to components.  Members
outside a drawn member's component then meet that one, links are contracted, and others are drawn per bucket, until
that links hardly any; a large group of near copies costs a few comparisons per member.  Those still apart
are compared with all of the bucket's members of other components, behind a longer sketch (``FINE`` bits) drawn for
them alone, so every pair that shares a bucket is either verified or already connected.  Sketches of one bit per
coordinate discard far pairs inside the joins; what is left is decided on the full sets.

Null and empty texts, and texts without words, have no set and link with nothing.  Null ids are allowed (a
component's id is its smallest non-null id); equal rows are in one class.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.session import settle

from . import text as tx
from .components import labels

BAND_ROWS, BANDS = 6, 40
COORDINATES = BAND_ROWS * BANDS
FINE = 3072
#: Members drawn per bucket at once; drawing ends when it links fewer than one in FEW of those outside.
DRAWS, FEW = 2, 200
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(elements: np.ndarray, at: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """Sketches of many sets at once: elements of set k are ``elements[at[k]:at[k + 1]]`` (none is empty)."""
    n = len(at) - 1
    out = np.full((n, size), _EMPTY)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(at))
    left = elements
    # Leading bits that hold the number of every round.
    top = max(10, (2 * size - 1).bit_length())
    for i in range(2 * size):
        z = tx.mix(left + np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(i) << np.uint64(64 - top)) | (tx.mix(z) >> np.uint64(top))
        bins = (z >> np.uint64(32)).astype(np.int64) % size if i < size else np.full(len(left), i - size)
        # Values of later rounds are larger, so a filled bin stays as it is.
        np.minimum.at(flat, owner * size + bins, value)
        open_rows = (out == _EMPTY).any(axis=1)
        if not open_rows.any():
            break
        keep = open_rows[owner]
        if not keep.all():
            owner, left = owner[keep], left[keep]
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and where each row's begin."""
    data = tx.LOWER[data]
    starts, ends, at = tx.words(data, offsets)
    found, to = tx.shingles(tx.Sums(data).hash(starts, ends), at, shingle)
    parts, sizes = [], []
    for a, b in zip(to[:-1], to[1:]):
        own = np.sort(found[a:b])
        if b - a > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        parts.append(own)
        sizes.append(len(own))
    return np.concatenate(parts) if parts else found, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _one_bit(coords: np.ndarray) -> np.ndarray:
    """One bit per coordinate, in longs."""
    bits = np.packbits((tx.mix(coords) & np.uint64(1)).astype(np.uint8), axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.int64)


def _identity(elements: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketches(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text hash, set size, set identity (f, g), band hashes and one-bit sketch per document."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "h", "n_shingles", "f", "g", "bands", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in tx.slices(whole):
                elements, at = _sets(*tx.flat(part.column("text")), shingle)
                n = np.diff(at)
                use = np.flatnonzero(n)
                coords = sketch(elements, np.concatenate(([0], np.cumsum(n[use]))))
                shape = coords.reshape(len(use), BANDS, BAND_ROWS)
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(use), BANDS)).copy()
                for k in range(BAND_ROWS):
                    band = tx.mix(band * np.uint64(31) + shape[:, :, k])
                bits = _one_bit(coords)
                ids = [(None, None)] * part.num_rows
                for k in use:
                    ids[k] = _identity(elements[at[k] : at[k + 1]])
                bands_of, bits_of = [None] * part.num_rows, [None] * part.num_rows
                for j, k in enumerate(use):
                    bands_of[k], bits_of[k] = band[j].view(np.int64), bits[j]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("h"), pa.array(n, pa.int64()), pa.array([a for a, _ in ids], pa.int64()),
                     pa.array([b for _, b in ids], pa.int64()), pa.array(bands_of, pa.list_(pa.int64())), pa.array(bits_of, pa.list_(pa.int64()))], names)

    return source.mapInArrow(run, f"id {kind}, h long, n_shingles long, f long, g long, bands array<long>, bits array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """(f, elements) of the wanted texts (h), one row per set."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).join(wanted, "h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in tx.slices(whole):
                elements, at = _sets(*tx.flat(part.column("text")), shingle)
                at = np.concatenate((at[:1], at[1:][np.diff(at) > 0]))
                ids = [_identity(elements[a:b])[0] for a, b in zip(at[:-1], at[1:])]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["f", "elements"])

    return source.select("text").mapInArrow(run, "f long, elements array<long>").dropDuplicates(["f"])


def _fine(sets: DataFrame) -> DataFrame:
    """(f, bits): the longer one-bit sketch of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Some sets at a time: short ones are many, and a long sketch is 24 KB while it is filled.
            for k in range(0, whole.num_rows, 256):
                part = whole.slice(k, 256)
                lists = pa.concat_arrays([part.column("elements")])
                at = lists.offsets.to_numpy().astype(np.int64)
                bits = _one_bit(sketch(lists.values.to_numpy(zero_copy_only=False).view(np.uint64), at, FINE))
                fine = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * bits.shape[1], pa.int32()), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("f"), fine], ["f", "bits"])

    spread = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.repartition(spread, F.xxhash64("f")).mapInArrow(run, "f long, bits array<long>")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| on the full sets."""
    side = lambda n: sets.select(F.col("f").alias(n), F.col("elements").alias(f"e{n}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            left, right = b.column("ea"), b.column("eb")
            for k in range(b.num_rows):
                x, y = (v[k].values.to_numpy(zero_copy_only=False) for v in (left, right))
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(np.flatnonzero(ok), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])

    return full.select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def _far(a: str, b: str, percent: int, size: int = COORDINATES) -> Column:
    """True where two one-bit sketches differ more than sets of the threshold similarity do (five deviations)."""
    p = (1 - percent / 100) / 2
    limit = int(np.ceil(size * p + 5 * np.sqrt(size * p * (1 - p))))
    words = -(-size // 64)
    apart = sum((F.bit_count(F.element_at(a, k + 1).bitwiseXOR(F.element_at(b, k + 1))) for k in range(words)), F.lit(0))
    return apart > limit


def near_documents(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    component_id = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return _grouped(docs, shingle, percent, id_col, text_col).select(
        F.col("id").alias(id_col), "n_shingles", component_id.alias("component_id"), component_id.eqNullSafe(F.col("id")).alias("kept")
    )


def drop_near(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group (the one with the smallest id), and all those without words."""
    rows = settle(_grouped(docs, shingle, percent, id_col, text_col).select("id", "h", "label"), "grouped")
    best = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h")).alias("best"))
    alone = rows.where("label is null").groupBy("id", "h").agg(F.lit(1).cast("long").alias("n_rows"))
    # Rows equal in id and text cannot be told apart: where a winner has such twins, they are merged below.
    winners = best.select("best.id", "best.h").join(
        rows.where("label is not null").groupBy(F.col("id").alias("i"), F.col("h").alias("j")).agg(F.count(F.lit(1)).alias("n_rows")),
        F.col("id").eqNullSafe(F.col("i")) & F.col("h").eqNullSafe(F.col("j")),
    ).select("id", "h", "n_rows")
    chosen = winners.unionByName(alone)
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("of"), F.xxhash64(F.col(text_col).cast("string")).alias("of_text"))
    kept = own.join(chosen, F.col("of").eqNullSafe(F.col("id")) & (F.col("of_text") == F.col("h")))
    merged = kept.where("n_rows > 1").dropDuplicates(["of", "of_text"])
    return kept.where("n_rows = 1").unionByName(merged).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _grouped(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, h, n_shingles, label (null without a set) and smallest id of the label, per document."""
    drawn = settle(sketches(docs, shingle, id_col, text_col), "sketches")
    classes = drawn.where("f is not null").groupBy("f", "g").agg(
        F.min("id").alias("first"), F.min("h").alias("h"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n")
    )
    member = classes.select("f", "h", "bits", F.explode("bands").alias("key"))
    bucket = classes.select("f", F.explode("bands").alias("key")).groupBy("key").agg(
        F.min("f").alias("centre"), F.count(F.lit(1)).alias("size")
    ).where("size > 1").select("key", "centre")
    shared = settle(member.join(bucket, "key"), "buckets")
    sets = settle(_full_sets(docs, shared.select("h").distinct(), shingle, text_col), "sets")
    bits = shared.select("f", "bits").dropDuplicates(["f"])

    def compare(pairs: DataFrame, drawn_of: DataFrame, size: int, label: str) -> DataFrame:
        """Links among pairs (f, bits, other) of which the first carries its sketch of ``size`` coordinates; the others' are in ``drawn_of``."""
        pairs = pairs.where("f <> other").dropDuplicates(["f", "other"])
        theirs = drawn_of.select(F.col("f").alias("other"), F.col("bits").alias("theirs"))
        near = pairs.join(theirs, "other").where(~_far("bits", "theirs", percent, size))
        return settle(_verify(near.select(F.col("f").alias("a"), F.col("other").alias("b")), sets, percent), label)

    def placed(named: DataFrame) -> DataFrame:
        """Bucket members with their component's label and that of the bucket's centre."""
        main = named.select(F.col("node").alias("centre"), F.col("label").alias("main"))
        return shared.join(named.withColumnRenamed("node", "f"), "f", "left").join(main, "centre", "left").select(
            "key", "f", "bits", F.coalesce("label", F.xxhash64("f")).alias("label"), F.coalesce("main", F.xxhash64("centre")).alias("main")
        )

    links = compare(shared.select("f", "bits", F.col("centre").alias("other")), bits, COORDINATES, "links")
    fine = None
    # Members outside the centre's component meet drawn members of each of their buckets; what that links is contracted and
    # others are drawn, as long as it links a fair share.  What it misses is found below.
    draw = 0
    while True:
        members = settle(placed(labels(links)), "members")
        outside = members.where("label <> main")
        mixed = members.join(outside.select("key").distinct(), "key", "left_semi")
        order = [F.min(F.struct(F.xxhash64("f", "key", F.lit(draw + k)).alias("d"), "f", "label")).alias(f"p{k}") for k in range(DRAWS)]
        partners = mixed.groupBy("key").agg(*order).withColumn("p", F.explode(F.array(*(f"p{k}" for k in range(DRAWS)))))
        if fine is None:
            # What lies outside now is all that is compared from here on.
            fine = settle(_fine(sets.join(mixed.select("f").distinct(), "f", "left_semi")), "fine")
        asked = mixed.join(partners.select("key", "p"), "key").where(F.col("label") != F.col("p.label")).select("f", F.col("p.f").alias("other"))
        asked = asked.dropDuplicates(["f", "other"]).join(fine, "f")
        found = compare(asked, fine, FINE, "drawn-links")
        links = links.unionByName(found)
        draw += DRAWS
        if found.count() * FEW <= outside.count():
            break

    # What is left is compared in full, behind the longer sketch; a pair in several buckets is one pair, of the first one.
    buckets = mixed.groupBy("f").agg(F.collect_set("key").alias("keys"))
    side = mixed.drop("bits").join(buckets, "f").join(fine, "f")
    stray = side.where("label <> main").select("key", *(F.col(c).alias(f"a{c}") for c in ("f", "bits", "label", "keys")))
    other = side.select("key", *(F.col(c).alias(f"b{c}") for c in ("f", "bits", "label", "keys")), (F.col("label") != F.col("main")).alias("bstray"))
    once = (F.col("alabel") != F.col("blabel")) & (~F.col("bstray") | (F.col("af") < F.col("bf"))) & ~_far("abits", "bbits", percent, FINE)
    rest = stray.join(other, "key").where(once & (F.array_min(F.array_intersect("akeys", "bkeys")) == F.col("key"))).select(
        F.col("af").alias("a"), F.col("bf").alias("b")
    )
    more = settle(_verify(rest, sets, percent), "last-links")
    named = labels(links.unionByName(more))

    found = classes.select("f", "first").join(named.withColumnRenamed("node", "f"), "f", "left").withColumn("label", F.coalesce("label", F.xxhash64("f")))
    smallest = found.groupBy("label").agg(F.min("first").alias("smallest"))
    component = found.join(smallest, "label").select("f", "label", "smallest")
    return drawn.select("id", "h", "n_shingles", "f").join(component, "f", "left").drop("f")
