"""Every named query against DuckDB on the smallest tables (CHECK_SF_DIR picks another directory)."""

import os

import pytest

import __spark_entry__ as entry
import compare

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare.difference(df, duck, sql) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset", "level", "type", "subtype", "n", "percent"] and df.count() > 0
