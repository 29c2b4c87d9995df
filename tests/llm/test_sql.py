"""Queries with SQL against DuckDB on the small fixture."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck


@pytest.mark.parametrize("key", sorted(E.LLM_SQL))
def test_query_matches_sql(spark, key):
    r = compare(spark, duck(SF_SMALL), SF_SMALL, key, E.queries()[key], E.oracle_sql()[key])
    assert r["cols"] and r["values"], r
