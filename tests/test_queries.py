import compare
import pytest

import __spark_entry__ as entry
from catalog import oracle
from catalog import queries as catalogue

SF = "/root/testdata/sf0.001"
SQL = oracle.statements()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare.mismatch(spark, con, catalogue.QUERIES[name], SQL[name], SF) is None


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() > 0
