"""Every registered query with an SQL twin gives the same rows, and the same column types."""

import pytest
from oracle import connect, mismatch, type_difference

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, con, name):
    frame = QUERIES[name](spark, data)
    assert mismatch(frame.toPandas(), con.execute(ORACLES[name]).df()) is None
    assert type_difference(frame, con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 12
