"""Every registered query against its SQL check, on the smallest data directory."""

import os

import pytest
from check_query import compare, duck

import __spark_entry__ as entry

SF = os.environ.get("TURNLAKE_TEST_SF", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        ok, message = compare(df, con, ORACLE[name])
        assert ok, message
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
