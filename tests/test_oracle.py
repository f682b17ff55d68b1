"""Every query that SQL expresses gives the rows that the SQL gives, on the smallest data set."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, QUERIES[name], ORACLE[name], SF)
    assert problem is None, problem


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
