"""The correctness gate: every registered query against its DuckDB SQL at sf0.01."""

import pytest
from support import SF01

import __spark_entry__ as E
from ledgerlens.plans.oracle import ORACLE as SQL
from ledgerlens.plans.registry import QUERIES
from oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    got = QUERIES[name](spark, SF01).toPandas()
    want = con.execute(SQL[name]).df()
    ok, msg = compare(got, want)
    assert ok, msg


def test_every_query_has_oracle_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["month", "month_key", "label", "income", "expense", "net"]
