"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Words are runs of letters, of digits or of other marks, so that marks glued to words count as words of their
own.  Features are unigrams and bigrams, hashed to ``2 ** BITS`` weights, and one weight for word five-grams
that a text has already used.  A feature's value is its share of the text's words, times ``SCALE``.

The model is fitted on a bounded sample: the ``sample`` labelled rows with the smallest digest of their id.
One task sees that sample only, slice by slice; what it returns has a fixed size.  Scoring reads every whole
text.  Null and empty texts get the score of the bias alone.  Rows without a label value, or labels without
a document, train nothing; with no usable label the score is 0.5 throughout.  Equal texts score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

BITS = 18
AGAIN = 1 << BITS
BIAS = AGAIN + 1
SCALE = 20.0
REPEAT = 5

_LETTER, _DIGIT, _MARK = 1, 2, 3
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[tx.SPACE] = 0
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes in order, and where each row's tokens begin."""
    kind = _CLASS[data]
    first = kind > 0
    last = first.copy()
    change = kind[1:] != kind[:-1]
    first[1:] &= change
    last[:-1] &= change
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= kind[inner] > 0
    last[inner - 1] |= kind[inner - 1] > 0
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return tx.Sums(data).hash(starts, ends), np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices of all rows, where each row's begin, and the value that each occurrence adds."""
    hashes, at = _tokens(data, offsets)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    shift = np.uint64(64 - BITS)
    single = (hashes >> shift).astype(np.int64)
    inside = row[1:] == row[:-1]
    pair = (tx.mix(hashes[:-1] * np.uint64(3) + hashes[1:]) >> shift).astype(np.int64)[inside]
    runs, to = tx.shingles(hashes, at, REPEAT)
    owner = np.repeat(np.arange(len(n)), np.diff(to))
    salted = runs ^ tx.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(salted, kind="stable")
    again = owner[order[1:][salted[order[1:]] == salted[order[:-1]]]]
    rows = np.concatenate((row, row[1:][inside], again))
    index = np.concatenate((single, pair, np.full(len(again), AGAIN)))
    order = np.argsort(rows, kind="stable")
    begin = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(n)))))
    return index[order], begin, SCALE / np.maximum(n, 1)


class Leader:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        out = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, out)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        new = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = new


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        usable: Column | None = None, sample: int = 8192, passes: int = 3) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled rows; ``usable`` restricts the label rows."""
    rows = labels.where(F.col(label_col).isin(0, 1))
    if usable is not None:
        rows = rows.where(usable)
    picked = rows.select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col).cast("string")).alias("order")
    ).orderBy("order", "_id", "label").limit(sample)
    # At most ``sample`` rows of three numbers: bounded, whatever the corpus.
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(picked), F.col("id") == F.col("_id")
    ).select("text", "label", "order", F.xxhash64("text").alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Leader()
        for whole in batches:
            for part in tx.slices(whole):
                index, begin, value = features(*tx.flat(part.column("text")))
                known = part.column("label").to_numpy(zero_copy_only=False)
                for _ in range(passes):
                    for k, label in enumerate(known):
                        at, count = np.unique(index[begin[k] : begin[k + 1]], return_counts=True)
                        model.learn(np.append(at, BIAS), np.append(count * value[k], 1.0), int(label))
        w = model.weights()
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(w[used])], ["at", "weight"])

    found = train.repartition(1).sortWithinPartitions("order", "tie", "label").mapInArrow(run, "at int, weight double")
    weights = np.zeros(BIAS + 1)
    for r in found.collect():  # at most 2 ** BITS + 2 rows
        weights[r["at"]] = r["weight"]
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1 for each whole text (a column of that name is replaced)."""
    docs = docs.drop(score_col)
    held = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for whole in batches:
            for part in tx.slices(whole, text_col):
                index, begin, value = features(*tx.flat(part.column(text_col)))
                total = np.concatenate(([0.0], np.cumsum(w[index])))
                odds = (total[begin[1:]] - total[begin[:-1]]) * value + w[BIAS]
                p = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, score_col])
        tx.release()

    return docs.mapInArrow(run, schema)
