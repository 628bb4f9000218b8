"""Interval primitives: bucketed range joins, ownership, unions of spans.

Rows join on (episode, time bucket), so a day-long recording is spread over many
tasks.  Identical spans are folded before they are joined; a bucket then holds at
most as many distinct spans as it has distinct boundary pairs, however many copies
the input has.  No broadcast is forced: Spark picks one from measured sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import prefix_scan

BUCKET_MS = 15_000
SCAN_MS = 600_000


def floor_div(col: Column, n: int) -> Column:
    return F.floor(col / F.lit(n)).cast("bigint")


def spread(df: DataFrame, start: Column, end: Column, bucket_ms: int, name: str = "__tb") -> DataFrame:
    """One row per time bucket touched by [start, end); empty spans keep their start bucket."""
    last = F.greatest(end - 1, start)
    return df.withColumn(
        name, F.explode(F.sequence(floor_div(start, bucket_ms), floor_div(last, bucket_ms)))
    )


def clip_to_bucket(df: DataFrame, bucket_ms: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Cut spans at bucket edges: pieces of one bucket never reach into another."""
    cut = spread(df, F.col(start), F.col(end), bucket_ms)
    low = F.col("__tb") * bucket_ms
    return (
        cut.withColumn(start, F.greatest(F.col(start), low))
        .withColumn(end, F.least(F.col(end), low + bucket_ms))
        .filter(F.col(start) < F.col(end))
    )


def owner_spans(
    turns: DataFrame,
    payload: Sequence[str] = ("speaker",),
    key: str = "episode_id",
    tie: str = "turn_id",
) -> DataFrame:
    """Disjoint spans, each owned by the first active turn in (start, end, tie) order.

    In that order a turn owns what lies after every earlier end, so one running
    maximum decides it; no pair of turns is ever formed.
    """
    folded = turns.filter(F.col("start_ms") < F.col("end_ms")).groupBy(key, "start_ms", "end_ms").agg(
        F.min_by(F.struct(*payload), F.col(tie)).alias("__p")
    )
    scanned = prefix_scan(
        folded,
        [key],
        ["start_ms", "end_ms"],
        floor_div(F.col("start_ms"), SCAN_MS),
        maxes={"__reach": F.col("end_ms")},
    )
    own = F.greatest(F.col("start_ms"), F.col("__reach"))
    return (
        scanned.withColumn("own_start", own)
        .filter(F.col("own_start") < F.col("end_ms"))
        .select(key, "own_start", F.col("end_ms").alias("own_end"), "start_ms", "__p.*")
    )


def locate_points(
    points: DataFrame,
    spans: DataFrame,
    mid2: Column,
    payload: Sequence[str],
    key: str = "episode_id",
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Left join each point to the span holding it.  ``mid2`` is twice the point time.

    ``spans`` are disjoint (see :func:`owner_spans`): at most one match per point.
    """
    left = points.withColumn("__m2", mid2).withColumn(
        "__tb", F.floor(F.col("__m2") / (2 * bucket_ms)).cast("bigint")
    )
    right = spread(spans, F.col("own_start"), F.col("own_end"), bucket_ms).select(
        F.col(key).alias("__k"),
        F.col("__tb").alias("__rb"),
        F.col("own_start").alias("__s"),
        F.col("own_end").alias("__e"),
        *[F.col(c).alias(f"__p_{c}") for c in payload],
    )
    cond = (
        (F.col(key) == F.col("__k"))
        & (F.col("__tb") == F.col("__rb"))
        & (F.col("__m2") >= F.col("__s") * 2)
        & (F.col("__m2") < F.col("__e") * 2)
    )
    return left.join(right, cond, "left").drop("__k", "__tb", "__rb", "__m2", "__s", "__e")


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    right_cols: Sequence[str],
    key: str = "episode_id",
    how: str = "inner",
    once: bool = True,
    bucket_ms: int = BUCKET_MS,
    widen_ms: int = 0,
) -> DataFrame:
    """Pairs of rows whose spans overlap by more than zero milliseconds.

    ``widen_ms`` extends the left span on both sides.  ``once=True`` emits a pair
    only in the bucket of the later start; with ``once=False`` a pair may repeat
    per bucket, which is right below an idempotent aggregate (max, min) and needed
    for a left join, where a row without a partner must stay.
    """
    a = left.withColumn("__as", F.col("start_ms") - widen_ms).withColumn(
        "__ae", F.col("end_ms") + widen_ms
    )
    a = spread(a, F.col("__as"), F.col("__ae"), bucket_ms)
    b = spread(right.filter(F.col("start_ms") < F.col("end_ms")), F.col("start_ms"), F.col("end_ms"), bucket_ms).select(
        F.col(key).alias("__k"),
        F.col("__tb").alias("__rb"),
        F.col("start_ms").alias("b_start"),
        F.col("end_ms").alias("b_end"),
        *[F.col(c).alias(f"b_{c}") for c in right_cols],
    )
    low = F.greatest(F.col("__as"), F.col("b_start"))
    high = F.least(F.col("__ae"), F.col("b_end"))
    cond = (
        (F.col(key) == F.col("__k"))
        & (F.col("__tb") == F.col("__rb"))
        & (F.col("__as") < F.col("b_end"))
        & (F.col("b_start") < F.col("__ae"))
        & (low < high)
    )
    if once:
        cond = cond & (F.col("__tb") == floor_div(low, bucket_ms))
    joined = a.join(b, cond, how)
    # least/greatest skip nulls: an unmatched row must not show an overlap.
    length = F.when(F.col("b_start").isNotNull(), high - low)
    return joined.withColumn("overlap_ms", length).drop("__k", "__tb", "__rb", "__as", "__ae")


def union_lengths(spans: DataFrame, keys: Sequence[str], side: str, sides: Sequence[str]) -> DataFrame:
    """Length of the union of spans per key: for each side (``len_<side>``) and for all (``len_all``).

    One scan carries the furthest end seen, per side and overall; a span adds what
    lies beyond it.
    """
    folded = (
        spans.filter(F.col("start_ms") < F.col("end_ms"))
        .groupBy(*keys, "start_ms", side)
        .agg(F.max("end_ms").alias("end_ms"))
    )
    mine = lambda s: F.when(F.col(side) == s, F.col("end_ms"))
    scanned = prefix_scan(
        folded,
        keys,
        ["start_ms", side],
        floor_div(F.col("start_ms"), SCAN_MS),
        maxes={"__all": F.col("end_ms"), **{f"__{s}": mine(s) for s in sides}},
    )
    beyond = lambda reach: F.greatest(
        F.lit(0), F.col("end_ms") - F.greatest(F.col("start_ms"), F.col(reach))
    )
    return scanned.groupBy(*keys).agg(
        F.sum(beyond("__all")).alias("len_all"),
        *[F.sum(F.when(F.col(side) == s, beyond(f"__{s}")).otherwise(0)).alias(f"len_{s}") for s in sides],
    )


def last_writer_cells(
    turns: DataFrame,
    side: str,
    sides: Sequence[str],
    key: str = "episode_id",
    order: str = "ord",
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Elementary spans with the last writer (highest ``order``) of each side in ``who_<side>``.

    Spans are cut at bucket edges and folded, each bucket is cut at its own
    boundaries, and every piece between two boundaries keeps its last writer per
    side.  Stretches nobody covers are absent.
    """
    pieces = (
        clip_to_bucket(turns.select(key, "start_ms", "end_ms", "speaker", order, side), bucket_ms)
        .groupBy(key, "__tb", "start_ms", "end_ms", side)
        .agg(F.max(F.struct(F.col(order).alias("o"), F.col("speaker").alias("speaker"))).alias("__w"))
    )
    cuts = (
        pieces.select(key, "__tb", F.explode(F.array("start_ms", "end_ms")).alias("__cut"))
        .distinct()
    )
    # A bucket has at most bucket_ms + 1 distinct boundaries: a bounded window.
    w = W.partitionBy(key, "__tb").orderBy("__cut")
    cells = cuts.withColumn("__until", F.lead("__cut").over(w)).filter(
        F.col("__until").isNotNull()
    )
    return (
        pieces.join(cells, [key, "__tb"])
        .filter((F.col("__cut") >= F.col("start_ms")) & (F.col("__cut") < F.col("end_ms")))
        .groupBy(key, F.col("__cut").alias("start_ms"), F.col("__until").alias("end_ms"))
        .agg(*[F.max(F.when(F.col(side) == s, F.col("__w")))["speaker"].alias(f"who_{s}") for s in sides])
    )
