"""Document statistics, rules that vote or abstain, and their combination by weak supervision.

Each rule votes 1 (good), -1 (bad) or 0 (abstains).  Expectation-maximisation over the histogram of vote
patterns (at most 3 ** rules rows, whatever the corpus) estimates how each rule votes on good and on bad
documents; the posterior probability of "good" replaces an all-must-pass filter.

Null and empty texts have no words and all counts 0; null ids pass through; equal rows are scored alike;
columns other than id and text are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.session import settle

from . import text as tx

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_bare", "n_upper", "n_letters", "n_exclaim",
)

_IS = {
    "symbol": np.isin(np.arange(256), [ord(c) for c in SYMBOLS]),
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "lower": np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 0xC0),
    "exclaim": np.arange(256) == 33,
    "lead": (np.arange(256) & 0xC0) != 0x80,
}


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    return out


def _sum(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    rows = np.arange(len(offsets) - 1, dtype=np.uint64)
    salt = tx.mix(rows + np.uint64(1))
    sums = tx.Sums(data)
    space = tx.SPACE[data]
    starts, ends, at = tx.words(data, offsets)
    n = np.diff(at)

    windows, to = tx.shingles(sums.hash(starts, ends), at, WINDOW)
    owner = np.repeat(np.arange(len(n)), np.diff(to))
    hits = np.flatnonzero(_repeated(windows ^ salt[owner]))
    edge = np.zeros(len(starts) + 1, np.int64)
    first = at[:-1][owner[hits]] + hits - to[:-1][owner[hits]]
    np.add.at(edge, first, 1)
    np.add.at(edge, first + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0

    line_start, line_end, line_at = tx.lines(data, offsets)
    solid = np.concatenate(([0], np.cumsum(~space, dtype=np.int64)))
    worded = np.flatnonzero(solid[line_end] > solid[line_start])
    line_row = np.repeat(np.arange(len(n)), np.diff(line_at))
    dup = np.zeros(len(line_start), bool)
    dup[worded] = _later(sums.hash(line_start[worded], line_end[worded]) ^ salt[line_row[worded]])

    letters = np.concatenate(([0], np.cumsum(_IS["upper"][data] | _IS["lower"][data], dtype=np.int64)))
    return {
        "n_words": n,
        "word_chars": _sum(_IS["lead"][data] & ~space, offsets),
        "n_symbols": _sum(_IS["symbol"][data], offsets),
        "n_dup_lines": _sum(dup, line_at),
        "n_repeat_words": _sum(covered, at),
        "n_lines": np.diff(line_at),
        "n_bare": _sum(letters[ends] == letters[starts], at),
        "n_upper": _sum(_IS["upper"][data], offsets),
        "n_letters": letters[offsets[1:]] - letters[offsets[:-1]],
        "n_exclaim": _sum(_IS["exclaim"][data], offsets),
    }


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the counts of ``STATS``, over the whole text."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in tx.slices(whole):
                found = _measure(*tx.flat(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(found[k], pa.int64()) for k in STATS)], ["id", *STATS]
                )

    schema = f"id {kind}, " + ", ".join(f"{k} long" for k in STATS)
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _defect(found: Column) -> Column:
    return F.when(found, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name of a rule -> its vote, from the statistics alone.

    A rule that looks for a defect says nothing about documents without that defect, so it abstains there;
    only length and word shape can speak for a document.
    """
    length = _share("word_chars", "n_words")
    marks = (F.col("word_chars") - F.col("n_letters")) / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "v_words": F.when(F.col("n_words") < 20, -1).when(F.col("n_words") >= 40, 1).otherwise(0),
        "v_word_length": F.when((length < 2) | (length > 20), -1).when(length.between(3, 12), 1).otherwise(0),
        "v_symbols": _defect(_share("n_symbols", "n_words") > 0.1),
        "v_marks": _defect(marks > 0.3),
        "v_bare": _defect(_share("n_bare", "n_words") > 0.1),
        "v_upper": _defect(_share("n_upper", "n_letters") > 0.3),
        "v_exclaim": _defect(_share("n_exclaim", "n_words") > 0.1),
        "v_repeats": _defect(_share("n_repeat_words", "n_words") > 0.3),
        "v_dup_lines": _defect(_share("n_dup_lines", "n_lines") > 0.5),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, prior: float = 0.0, rounds: int = 200) -> np.ndarray:
    """The log-odds of "good" that each vote adds, as [rule, vote + 1].

    The class balance is given (``prior``, log-odds), the rules' behaviour in each class is estimated.  Starts
    from rules that are right four times in five; one pseudo-document per vote and class keeps every
    estimate inside (0, 1).  Without documents the starting values are returned.
    """
    start = np.log(np.array([0.2, 0.5, 0.8]) / np.array([0.8, 0.5, 0.2]))
    weight = np.tile(start, (n_rules, 1))
    if not patterns:
        return weight
    votes = np.array([p for p, _ in patterns]) + 1
    counts = np.array([c for _, c in patterns], float)
    rule = np.arange(n_rules)
    for _ in range(rounds):
        odds = np.clip(prior + weight[rule, votes].sum(1), -700, 700)
        good = counts / (1 + np.exp(-odds))
        bad = counts - good
        tables = []
        for part in (good, bad):
            t = np.ones((n_rules, 3))
            for k in rule:
                np.add.at(t[k], votes[:, k], part)
            tables.append(t / t.sum(1, keepdims=True))
        new = np.log(tables[0] / tables[1])
        moved, weight = float(np.abs(new - weight).max()), new
        if moved < 1e-9:
            break
    # A vote may only speak for its own side: "good" never counts against, "bad" never in favour.
    weight[:, 0] = np.minimum(weight[:, 0], 0)
    weight[:, 2] = np.maximum(weight[:, 2], 0)
    return weight


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
                  prior: float = 0.0) -> DataFrame:
    """Statistics, votes, posterior ``quality`` and ``kept`` (posterior >= threshold) per document."""
    named = rules()
    voted = settle(statistics(docs, id_col, text_col).select("*", *(v.cast("tinyint").alias(k) for k, v in named.items())), "votes")
    names = list(named)
    seen = voted.groupBy(*names).count().orderBy(*names).collect()  # bounded: 3 ** rules patterns
    weight = fit([(tuple(r[k] for k in names), r["count"]) for r in seen], len(names), prior)
    odds = F.lit(float(prior))
    for k, name in enumerate(names):
        odds = odds + F.element_at(F.array(*(F.lit(float(w)) for w in weight[k])), F.col(name).cast("int") + 2)
    return voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("quality") >= threshold)
