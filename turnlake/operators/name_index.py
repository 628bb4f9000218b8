"""Closest names by an exact index over characters: no name meets all candidates.

A name's tokens are its characters with their occurrence ("a1", "a2"), so the number of common tokens of two names is the
number of characters they share, which bounds the matching blocks and (from below) the edits.  A score of at least t
needs a number of common tokens that follows from the length alone.  Tokens are ordered by how rare they are among
the candidates; two names with ``need`` tokens in common share a pair of tokens among their rarest
``length - need + 2``, and one token among their rarest ``length - need + 1``.  Names meet on such pairs; very long
names, and names that may be alike with one token in common, meet on single tokens.  A pair that meets on several
keys is kept at its smallest one, with no distinct.  What is left after the bound on the score is compared, best
bound first, until no bound can beat the best score.

Names without a candidate at t look again at lower thresholds, so that the best score is exact for all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

#: Names from this length on meet on single tokens: their pairs would be too many.
WIDE = 64
#: Candidates of one name that one task compares.
BLOCK = 20_000
_SLACK = 1e-9


class Ratio:
    """Matching blocks: 2 * matched / (length + length)."""

    @staticmethod
    def longest(n: Column, t: float) -> Column:
        return n * (2 - t) / t

    @staticmethod
    def need(n: Column, t: float) -> Column:
        return F.ceil((n + F.ceil(n * t / (2 - t) - _SLACK)) * t / 2 - _SLACK)

    @staticmethod
    def bound(common: Column, n: Column, m: Column) -> Column:
        return 2.0 * common / (n + m)


class Edits:
    """1 - edit distance / longer length; the distance is at least the longer length less the common tokens."""

    @staticmethod
    def longest(n: Column, t: float) -> Column:
        return n / t

    @staticmethod
    def need(n: Column, t: float) -> Column:
        return F.ceil(n * t - _SLACK)

    @staticmethod
    def bound(common: Column, n: Column, m: Column) -> Column:
        return common / F.greatest(n, m)


METHODS = {"ratio": Ratio, "levenshtein": Edits}


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)), F.lit(True))


def _spelled(name: Column) -> Column:
    chars = F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0))
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))


def tokens(df: DataFrame, rarity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` (unique ``keys``) with ``n`` and ``tokens``, the rarest first."""
    each = df.select(*keys, F.explode(_spelled(F.col(keys[-1]))).alias("token")).join(rarity, "token", "left")
    ordered = each.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token"))), lambda s: s["token"]).alias("tokens")
    )
    return ordered.withColumn("n", F.size("tokens"))


def _keyed(df: DataFrame, kind: type, t: float, wide: int) -> DataFrame:
    """Add ``keys``: what two names must share one of to reach a score of t."""
    n, all_tokens = F.col("n"), F.col("tokens")
    need = F.greatest(kind.need(n, t), F.lit(1)).cast("int")
    first = F.slice(all_tokens, F.lit(1), n - F.greatest(need, F.lit(2)) + 2)
    pairs = F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda b: F.concat(a, F.lit(" "), b))))
    single = F.slice(all_tokens, F.lit(1), n - need + 1)
    none = F.array().cast("array<string>")
    both = F.concat(
        F.when((n < wide) & (n > 1), pairs).otherwise(none),
        F.when((need == 1) | (kind.longest(n, t) >= wide), single).otherwise(none),
    )
    return df.withColumn("keys", both)


def pairs(asked: DataFrame, held: DataFrame, method: str, t: float, by: Sequence[str] = (), wide: int = WIDE) -> DataFrame:
    """All pairs that may reach a score of t > 0: (by.., norm, other, bound); both sides as ``tokens`` makes them."""
    kind = METHODS[method]
    left = _keyed(asked, kind, t, wide).withColumn("key", F.explode("keys"))
    right = _keyed(held, kind, t, wide).withColumn("key2", F.explode("keys"))
    right = right.toDF(*(f"{c}2" if c != "key2" else c for c in right.columns))
    near = (F.col("n2") <= kind.longest(F.col("n"), t) + _SLACK) & (F.col("n") <= kind.longest(F.col("n2"), t) + _SLACK)
    met = left.join(right, (F.col("key") == F.col("key2")) & near & _same(by, [f"{b}2" for b in by]))
    met = met.where(F.array_min(F.array_intersect("keys", "keys2")) == F.col("key"))
    bound = kind.bound(F.size(F.array_intersect("tokens", "tokens2")), F.col("n"), F.col("n2"))
    return met.select(*by, "norm", F.col("norm2").alias("other"), bound.alias("bound")).where(F.col("bound") >= t - _SLACK)


def best_ratios(met: DataFrame, by: Sequence[str], blocks: int, k: int = 1, atleast: float = 0.0, name_first: bool = True) -> DataFrame:
    """(by.., norm, canonical, tie, score): per name and block the ``k`` best candidates with a score over 0, of at least ``atleast``.

    ``met`` are (by.., norm, other, canonical, tie, bound); among equal scores the larger ``tie`` wins.  Pairs stream through a task, a
    name's best bounds first; what cannot be among the k best so far is not compared.
    """
    part = [*by, "norm", "block"]
    laid = met.withColumn("block", F.pmod(F.xxhash64("other"), F.lit(blocks)).cast("int")).repartition(*part)
    laid = laid.sortWithinPartitions(*part, F.desc("bound"), F.desc("tie")).select(*part, "other", "canonical", "tie", "bound")
    out = laid.select(*by, "norm", "canonical", "tie").schema
    width = len(part)
    names = [f.name for f in out] + ["score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, []

        def emit(key: tuple, found: list[tuple], to: list[list]) -> None:
            for score, tie, canonical in found:
                for column, value in zip(to, (*key[:-1], canonical, tie, score)):
                    column.append(value)

        for b in batches:
            kinds = [b.schema.field(n).type for n in names[:-1]] + [pa.float64()]
            rows: list[list] = [[] for _ in names]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key, (other, canonical, tie, bound) = row[:width], row[width:]
                if key != at:
                    if best:
                        emit(at, best, rows)
                    at, best = key, []
                if len(best) == k and (bound, tie) <= best[-1][:2]:
                    continue
                norm = key[-2]
                score = SequenceMatcher(None, *((norm, other) if name_first else (other, norm))).ratio()
                if score > 0 and score >= atleast:
                    best = sorted([*best, (score, tie, canonical)], key=lambda s: s[:2], reverse=True)[:k]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)
        if best:
            rows = [[] for _ in names]
            emit(at, best, rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

    return laid.mapInArrow(run, T.StructType([*out, T.StructField("score", T.DoubleType())]))


def indexed(names: DataFrame, candidates: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tokens, as tables: distinct (by.., norm)."""
    keys = [*by, "norm"]
    known = candidates.select(*keys).distinct()
    rarity = known.select(F.explode(_spelled(F.col("norm"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    return settle(tokens(names.select(*keys).distinct(), rarity, keys), "names-asked"), settle(tokens(known, rarity, keys), "names-held")


def _first(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first registration of each candidate form, as (by_of.., other, ord, canonical)."""
    forms = candidates.groupBy(*(F.col(k).alias(f"{k}_of") for k in by), F.col("norm").alias("other"))
    return forms.agg(F.min(F.struct("ord", "canonical")).alias("at")).select(*(f"{k}_of" for k in by), "other", "at.ord", "at.canonical")


def closest(names: DataFrame, candidates: DataFrame, cutoff: float, method: str = "ratio", by: Sequence[str] = ()) -> DataFrame:
    """Best candidate of each name: (by.., norm, score, canonical); names that share no character with any have no row.

    ``candidates`` are (by.., norm, canonical, ord); among equal scores the first one wins.
    """
    keys = [*by, "norm"]
    candidates = settle(candidates.select(*keys, "canonical", "ord"), "names-candidates")
    first = _first(candidates, by)
    asked, held = indexed(names, candidates, by)
    blocks = max(1, -(-candidates.count() // BLOCK))
    out: list[DataFrame] = []
    # Below the cutoff only the score itself is wanted; the last step takes all that have a token in common.
    steps = [cutoff, 1e-6] if cutoff > 0.05 else [1e-6]
    for t in steps:
        last = t == steps[-1]
        met = pairs(asked, held, method, t, by, wide=0 if last else WIDE)
        same = (F.col("other") == F.col("other_of")) & _same(by, [f"{k}_of" for k in by])
        met = met.join(first.withColumnRenamed("other", "other_of"), same).select(*keys, "other", "canonical", (-F.col("ord")).alias("tie"), "bound")
        if method == "levenshtein":
            longer = F.greatest(F.char_length("norm"), F.char_length("other"))
            scored = met.withColumn("score", 1.0 - F.levenshtein("norm", "other") / longer).where("score > 0")
        else:
            scored = best_ratios(met, by, blocks)
        best = scored.groupBy(*keys).agg(F.max(F.struct("score", "tie", "canonical")).alias("b")).where(F.col("b.score") >= (0 if last else t))
        out.append(settle(best.select(*keys, "b.score", "b.canonical"), "names-best"))
        if last:
            break
        done = out[-1].select(*(F.col(k).alias(f"{k}_done") for k in keys))
        asked = asked.join(done, _same(keys, [f"{k}_done" for k in keys]), "left_anti")
        if asked.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def close_matches(names: DataFrame, candidates: DataFrame, k: int, cutoff: float, method: str = "ratio", by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best candidates of each name with a score of at least ``cutoff``: (by.., norm, canonical, score).

    ``ratio`` compares the candidate with the name (the ratio depends on the order) and prefers the larger candidate among
    equal scores; ``levenshtein`` prefers the smaller one.
    """
    keys = [*by, "norm"]
    candidates = settle(candidates.select(*keys, "canonical"), "names-candidates")
    asked, held = indexed(names, candidates, by)
    met = pairs(asked, held, method, cutoff, by)
    forms = candidates.select(*(F.col(k).alias(f"{k}_of") for k in by), F.col("norm").alias("other_of"), "canonical")
    met = met.join(forms, (F.col("other") == F.col("other_of")) & _same(by, [f"{k}_of" for k in by])).select(*keys, "other", "canonical", "bound")
    if method == "levenshtein":
        longer = F.greatest(F.char_length("norm"), F.char_length("other"))
        scored = met.withColumn("score", 1.0 - F.levenshtein("norm", "other") / longer).where(F.col("score") >= cutoff)
        return scored.select(*keys, "canonical", "score")
    blocks = max(1, -(-candidates.count() // BLOCK))
    best = best_ratios(met.withColumn("tie", F.col("canonical")), by, blocks, k, cutoff, name_first=False)
    return best.select(*keys, "canonical", "score")
