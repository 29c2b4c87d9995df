"""Registered queries against their DuckDB oracle on the small fixture."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck
from tests.conftest import SF_SMALL

KEYS = sorted(set(E.oracle_sql()) - set(E.LLM_SQL))


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, SF_SMALL, key, E.queries()[key], E.oracle_sql()[key])
    assert r["cols"], r
    assert r["values"], r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["severity", "n"]


def test_every_query_has_oracle_or_is_rows_only():
    own = set(E.queries()) - set(E.LLM_QUERIES)
    assert own - set(E.oracle_sql()) == E.ROWS_ONLY
