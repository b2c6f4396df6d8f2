"""Every registered query with SQL gives the SQL's result at the smallest scale; the others run."""

import oracle
import pytest

import __spark_entry__ as entry_point
from quillhawk.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SMALL)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert oracle.difference(df, con, sql) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    found = entry_point.entry(spark)
    assert found.columns == ["query_id", "rank", "chunk_id", "score"]
    assert found.count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
