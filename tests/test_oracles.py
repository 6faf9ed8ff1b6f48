"""Every registered query against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    if name not in ORACLES:
        assert df.count() > 0
        return
    rows, problem = differences(df, duck, ORACLES[name])
    assert problem is None, problem
    assert rows > 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert {"request_id", "rank", "score", "name", "country"} <= set(df.columns)
    assert df.count() > 0
