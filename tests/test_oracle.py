import pytest
from oracle import compare, connect

from lakepipe import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLE[name], DIR, con) == ""


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
