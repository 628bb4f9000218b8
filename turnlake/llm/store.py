"""Joins and tables that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.session import settle

#: Rows of a counted side that may be broadcast; all such sides have rows of fixed width.
BROADCAST_ROWS = 100_000


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df`` as a table in the shared folder, with its number of rows."""
    table = settle(df, label)
    return table, table.count()


def join_counted(big: DataFrame, small: DataFrame, on: Column | list[str], how: str, label: str) -> DataFrame:
    """Join with a side whose rows are counted first: broadcast when few, shuffled otherwise."""
    table, n = counted(small, label)
    return big.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, on, how)


def text_key(text: str = "text") -> Column:
    """Identity of a text for joins next to its document id: rows equal in both are interchangeable."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(7), t).alias("b"), F.col(text).isNull().alias("null"))
