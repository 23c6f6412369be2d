"""Every catalogue query with SQL gives the SQL's rows, names and types on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf, name):
    assert differences(spark, con, sf, entry.queries()[name], ORACLE[name]) == []


def test_catalogue_and_sql_names_agree():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["relevance", "rank", "term", "weight"]
    assert df.count() == 40
