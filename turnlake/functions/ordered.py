"""Running values over long ordered groups without one task per group.

A plain window over ``partitionBy(episode_id)`` sorts a whole episode in one
task.  If one episode holds a third of all rows that task never ends.  Here the
order axis is cut into buckets: each (key, bucket) is scanned on its own, bucket
totals (one small row each, pre-combined map-side) are scanned per key, and the
carry is joined back.  Rows are shuffled once, exactly as with the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_B = BUCKET = "__bucket"


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    prevs: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per ``keys`` in ``order``.

    ``sums``/``maxes`` cover the rows strictly before the current one (0 / null on
    the first row), ``prevs``/``nexts`` give the value of the neighbouring row.
    ``order`` must be total within a key and ``bucket`` non-decreasing along it.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    prevs, nexts = dict(prevs or {}), dict(nexts or {})
    row_order = F.struct(*order)
    src = df.withColumn(_B, bucket)

    totals = []
    for name, col in sums.items():
        totals.append(F.sum(col).alias(f"__t_{name}"))
    for name, col in maxes.items():
        totals.append(F.max(col).alias(f"__t_{name}"))
    for name, col in prevs.items():
        totals.append(F.max_by(F.struct(col.alias("v")), row_order).alias(f"__t_{name}"))
    for name, col in nexts.items():
        totals.append(F.min_by(F.struct(col.alias("v")), row_order).alias(f"__t_{name}"))

    per_key = W.partitionBy(*keys).orderBy(_B)
    before = per_key.rowsBetween(W.unboundedPreceding, -1)
    carry = []
    for name in sums:
        carry.append(F.sum(f"__t_{name}").over(before).alias(f"__c_{name}"))
    for name in maxes:
        carry.append(F.max(f"__t_{name}").over(before).alias(f"__c_{name}"))
    for name in prevs:
        carry.append(F.lag(f"__t_{name}").over(per_key).alias(f"__c_{name}"))
    for name in nexts:
        carry.append(F.lead(f"__t_{name}").over(per_key).alias(f"__c_{name}"))
    # Null keys and null buckets are groups like any other, as in a window.
    group = [*keys, _B]
    renamed = [F.col(c).alias(f"__k{i}") for i, c in enumerate(group)]
    carried = src.groupBy(*group).agg(*totals).select(*renamed, *carry)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(group)))

    local = W.partitionBy(*keys, _B).orderBy(*order)
    local_before = local.rowsBetween(W.unboundedPreceding, -1)
    joined = src.join(carried, same)
    out = list(df.columns)
    cols = [F.col(c) for c in out]
    for name, col in sums.items():
        cols.append(
            (
                F.coalesce(F.col(f"__c_{name}"), F.lit(0))
                + F.coalesce(F.sum(col).over(local_before), F.lit(0))
            ).alias(name)
        )
    for name, col in maxes.items():
        cols.append(F.greatest(F.col(f"__c_{name}"), F.max(col).over(local_before)).alias(name))
    for name, col in prevs.items():
        near = F.lag(F.struct(col.alias("v"))).over(local)
        cols.append(F.coalesce(near, F.col(f"__c_{name}"))["v"].alias(name))
    for name, col in nexts.items():
        near = F.lead(F.struct(col.alias("v"))).over(local)
        cols.append(F.coalesce(near, F.col(f"__c_{name}"))["v"].alias(name))
    return joined.select(*cols)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    label: Column,
    name: str = "island",
) -> DataFrame:
    """Number maximal runs of equal ``label`` along ``order`` (0-based)."""
    flagged = prefix_scan(df, keys, order, bucket, prevs={"__prev": F.struct(label.alias("x"))})
    changed = F.when(F.col("__prev").isNull(), 0).otherwise(
        F.when(F.col("__prev")["x"].eqNullSafe(label), 0).otherwise(1)
    )
    flagged = flagged.withColumn("__new", changed).drop("__prev")
    scanned = prefix_scan(flagged, keys, order, bucket, sums={"__before": F.col("__new")})
    return scanned.withColumn(name, (F.col("__before") + F.col("__new")).cast("bigint")).drop(
        "__before", "__new"
    )


def runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str | Column, label: Column,
    aggs: Mapping[str, tuple[Column, Callable[[str], Column]]], name: str = "island",
) -> DataFrame:
    """One row per maximal run of equal ``label``: keys.., ``name`` (from 0), ``label`` and the aggregates.

    Two shuffles: rows by (key, bucket), where runs are numbered and aggregated on one sort, and the runs, far fewer, by
    key, where those that a bucket border cuts are put together.  ``aggs`` are (aggregate of rows, aggregate of parts).
    ``order`` must be total within a key and ``bucket`` non-decreasing along it; a name is an existing column.
    """
    src = df if isinstance(bucket, str) else df.withColumn(_B, bucket)
    at = bucket if isinstance(bucket, str) else _B
    inside = W.partitionBy(*keys, at).orderBy(*order)
    marked = src.withColumn("__label", label)
    before = F.lag(F.struct("__label")).over(inside)
    flagged = marked.withColumn("__new", F.when(before.isNotNull() & before["__label"].eqNullSafe(F.col("__label")), 0).otherwise(1))
    numbered = flagged.withColumn("__run", F.sum("__new").over(inside))
    parts = numbered.groupBy(*keys, at, "__run").agg(F.first("__label").alias("__label"), *(a.alias(n) for n, (a, _) in aggs.items()))
    whole = W.partitionBy(*keys).orderBy(at, "__run")
    last = F.lag(F.struct("__label")).over(whole)
    joined = parts.withColumn("__new", F.when(last.isNotNull() & last["__label"].eqNullSafe(F.col("__label")), 0).otherwise(1))
    joined = joined.withColumn(name, (F.sum("__new").over(whole) - 1).cast("bigint"))
    return joined.groupBy(*keys, name).agg(F.first("__label").alias("label"), *(both(n).alias(n) for n, (_, both) in aggs.items()))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per key.  Spark prunes to n per key before the shuffle, so hot keys are cheap."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def trailing(
    df: DataFrame, keys: Sequence[str], t: str, span: int, bucket: int, aggs: Mapping[str, Column]
) -> DataFrame:
    """Aggregates over the rows of the last ``span`` units before each row (itself excluded).

    Rows near the end of a bucket are repeated as a halo in the next ones, so each
    (key, bucket) is complete on its own.
    """
    return trailing_buckets(df, keys, t, span, bucket, aggs).drop(_B)


def trailing_buckets(
    df: DataFrame, keys: Sequence[str], t: str, span: int, bucket: int, aggs: Mapping[str, Column]
) -> DataFrame:
    """``trailing``, with the bucket that the rows are dealt by kept as column ``BUCKET``."""
    first = F.floor(F.col(t) / bucket).cast("bigint")
    last = F.floor((F.col(t) + span) / bucket).cast("bigint")
    haloed = df.withColumn(_B, F.explode(F.sequence(first, last)))
    w = W.partitionBy(*keys, _B).orderBy(t).rangeBetween(-span, -1)
    out = haloed.select("*", *[a.over(w).alias(name) for name, a in aggs.items()])
    return out.filter(F.col(_B) == first)
