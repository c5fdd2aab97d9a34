import compare
import pytest

import __spark_entry__ as entry
from hearscore.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert compare.mismatch(spark, con, queries.QUERIES[name], queries.SQL[name], SF) is None
