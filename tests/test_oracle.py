"""Every query with SQL gives the rows of that SQL; the others give rows."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
EMPTY_AT_THIS_SIZE = {"top_candidates"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        df = fn(spark, SF)
        assert df.columns and df.count() > 0
    else:
        problem = compare(spark, SF, fn, sql, con)
        assert problem is None or (problem == "both empty" and name in EMPTY_AT_THIS_SIZE), problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
