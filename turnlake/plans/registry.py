"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .fixtures import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(
    name: str, covers: str, sql: str | None = None, needs: str = "", extra: str = "", recursive: bool = False
):
    """Register a query.  ``covers`` lists inventory ids; ``sql`` is its check on the same tables."""

    def add(fn: Callable[[Tables], DataFrame]):
        text = None if sql is None else with_views(sql, needs.split(), extra, recursive)
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, covers, fn, text)
        return fn

    return add


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return q.run(Tables(spark, sf_dir))

    call.__name__ = q.name
    return call
