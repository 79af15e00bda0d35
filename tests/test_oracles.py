"""Every registered query against its DuckDB oracle, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
import compare

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    difference = compare.difference(compare.spark_rows(QUERIES[name](spark, sf_dir)), compare.duck_rows(con, ORACLES[name]))
    assert not difference, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
