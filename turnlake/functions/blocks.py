"""Spreading rows for compute-heavy steps.

Such rows are few bytes but much work; left alone, adaptive execution would coalesce them by size into a
handful of tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that one task compares with a cell of candidates.
GROUP_ROWS = 20_000


def tasks(df: DataFrame) -> int:
    """Tasks of the session, for steps whose work does not show in bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def wide(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key, over as many tasks as the session has."""
    return df.repartition(tasks(df), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``wide`` for rows that need not lie by key.

    A repartitioning by the key itself would be dropped where a join below has it already, and the join's few
    small partitions would do all the work.
    """
    return df.repartition(tasks(df), F.xxhash64(*keys))
