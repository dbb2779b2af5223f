"""Every registered query runs; those with an oracle agree with it."""

import pytest
from conftest import SF
from oracle import compare, duck_connection

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    problem, _ = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.columns and frame.count() >= 0


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_registered_queries():
    assert set(ORACLES) <= set(QUERIES)
