"""Connected components by contraction: every node moves to its smallest neighbour until no edge is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.session import settle


def labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the edges (longs); nodes share a label iff they are connected.

    Nodes are compared by a digest (a bijection on longs), so that ordered chains shrink by a constant factor
    per round like all others.  Each round is a table in the shared folder: a lost executor costs one round.
    """
    first = edges.select(F.xxhash64(a).alias("u"), F.xxhash64(b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    first = settle(first.where("u <> v"), "edges")
    named = first.select(F.col("u").alias("node"), F.col("a").alias("name")).union(first.select("v", "b")).distinct()
    steps: list[DataFrame] = []
    left = first.select("u", "v")
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        step = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "contraction")
        steps.append(step)
        left = (
            left.join(step.select("u", F.col("to").alias("tu")), "u")
            .join(step.select(F.col("u").alias("v"), F.col("to").alias("tv")), "v")
            .where("tu <> tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct()
        )
        left = settle(left, "edges")
    if not steps:
        return named.select(F.col("name").alias("node"), F.col("node").alias("label"))

    def then(moved: DataFrame, step: DataFrame) -> DataFrame:
        onward = step.select(F.col("u").alias("to"), F.col("to").alias("next"))
        return moved.join(onward, "to", "left").select("u", F.coalesce("next", "to").alias("to"))

    final = reduce(then, steps[1:], steps[0])
    return named.join(final, named["node"] == final["u"]).select(F.col("name").alias("node"), F.col("to").alias("label"))
