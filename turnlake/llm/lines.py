"""Line dedup: two Bloom filters name the suspected repeats; only those are shuffled and counted.

A line's key is the line without white space at both ends, A-Z lower-cased.  Keys of at least ``MIN_CHARS``
code points found in at least ``MIN_DOCS`` documents lose all their lines, except in the document with the
largest id that holds the key.  The first pass hashes every long line into a once-seen and a twice-seen
filter; the second sends the suspects' keys, once per document, to be counted exactly on the whole key; the
third drops lines by position.

A null or empty text is one empty line and stays as it is (null becomes empty in the output).  Null ids come
before all others; of documents with equal ids that hold a key all keep it.  Equal rows are decided alike and each
counts as a document.  An empty table gives an empty result.  All other columns are carried; those named
``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .store import text_key
from .twins import bits_for, twice_seen

MIN_CHARS, MIN_DOCS = 40, 5
#: Bytes per long line that the filters are sized for.
LINE_BYTES = 160

_LEAD = (np.arange(256) & 0xC0) != 0x80


def _keys(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """Row, position in the row, start, end and hash of the keys that are long enough (one per line)."""
    start, end, at = tx.lines(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    solid = np.flatnonzero(~tx.SPACE[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = np.flatnonzero(b > a)
    start, end, row = solid[a[some]], solid[b[some] - 1] + 1, row[some]
    lead = np.concatenate(([0], np.cumsum(_LEAD[data], dtype=np.int64)))
    long = np.flatnonzero(lead[end] - lead[start] >= min_chars)
    start, end, row, place = start[long], end[long], row[long], some[long] - at[row[long]]
    return row, place, start, end, tx.Sums(data).hash(start, end) if len(long) else np.zeros(0, np.uint64)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, plus ``n_lines`` (before) and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in tx.slices(batch):
            data, offsets = tx.flat(part.column("text"))
            row, _, _, _, h = _keys(tx.LOWER[data], offsets, min_chars)
            order = np.lexsort((h, row))
            first = np.ones(len(h), bool)
            first[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            yield h[order][first]

    seen = source.sparkSession.sparkContext.broadcast(twice_seen(source.select("text"), hashes, bits_for(total // LINE_BYTES)))
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "own", "key", "places"]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in tx.slices(whole):
                data, offsets = tx.flat(part.column("text"))
                data = tx.LOWER[data]
                row, place, start, end, h = _keys(data, offsets, min_chars)
                use = np.flatnonzero(seen.value.suspects(h))
                raw = data.tobytes()
                found: dict[tuple[int, bytes], list[int]] = {}
                for k in use:
                    found.setdefault((int(row[k]), raw[start[k] : end[k]]), []).append(int(place[k]))
                if found:
                    rows = pa.array([r for r, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(rows), part.column("own").take(rows), pa.array([k for _, k in found], pa.binary()),
                         pa.array(list(found.values()), pa.list_(pa.int32()))], names)

    own = text_key("text")
    held = source.select("id", own.alias("own"), "text").mapInArrow(
        suspects, T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("own", source.select(own.alias("o")).schema[0].dataType),
                                T.StructField("key", T.BinaryType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
    )
    common = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    drops = (
        held.join(common.select(F.col("key").alias("k"), "last"), F.col("key") == F.col("k"))
        .where(~F.col("id").eqNullSafe(F.col("last")))
        # Equal rows name the same places; they are merged, not repeated.
        .groupBy("id", "own").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    ).select(F.col("id").alias("of"), F.col("own").alias("of_text"), "places")
    # Other columns travel as one, whatever their names.
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*others).alias("rest"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), text_key(text_col).alias("own"))
    joined = packed.join(drops, F.col("id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("of_text")), "left").select("rest", "text", "places")
    counts = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    schema = T.StructType([joined.schema["rest"], joined.schema["text"], *counts])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in tx.slices(whole):
                texts, n_lines, n_dropped = [], [], []
                for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist()):
                    text = text or ""
                    n = text.count("\n") + 1
                    if places:
                        gone = set(places)
                        text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
                    texts.append(text)
                    n_lines.append(n)
                    n_dropped.append(len(places) if places else 0)
                columns = [part.column("rest"), pa.array(texts, part.schema.field("text").type), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["rest", "text", "n_lines", "n_dropped"])

    carried = [F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return joined.mapInArrow(drop, schema).select(*carried, "n_lines", "n_dropped")
