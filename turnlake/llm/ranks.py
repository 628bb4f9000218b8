"""Numbers of rows inside groups of any size: range partitions are numbered by themselves, then shifted by counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.session import settle


def ranked(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Add ``rank`` (from 0, ascending, nulls first) and ``size`` of each row's group.

    Rows are sorted over all tasks by group and order, so a group of any size is spread; only the number of rows per
    group and range is gathered.  Rows equal in group and order are numbered in no stated order.
    """
    keys = [*group, *order]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = settle(
        df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), label
    ).withColumn("part", F.shiftright("at", 33))
    counts = laid.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(*group)
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    shift = counts.select(
        *(F.col(g).alias(f"group{i}") for i, g in enumerate(group)), F.col("part").alias("of"),
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"),
    )
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"group{i}")) for i, g in enumerate(group)), F.col("part") == F.col("of"))
    return laid.join(shift, same).select(*df.columns, (F.col("at") + F.col("shift")).alias("rank"), "size")
