"""Every registered query with reference SQL against DuckDB, on the smallest data."""

import pytest
from compare import differences, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
# its closed form needs a balanced hierarchy, which the smallest data does not have
LARGER = {"rec_nested_cg": "/root/testdata/sf0.01"}
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(SQL) - set(LARGER)))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(LARGER))
def test_same_as_sql_on_larger_data(spark, name):
    sf = LARGER[name]
    assert differences(spark, duck(sf), QUERIES[name], SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 8


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
