"""Every query with a SQL equivalent gives the same rows as that SQL; the entry query runs."""

import pytest

import __spark_entry__ as entry

from oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 8
    assert {"column_name", "skew", "kurt", "outlier_ratio", "missing_ratio"} <= set(df.columns)
