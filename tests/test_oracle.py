"""Every registered query against its check SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows(spark, con, name):
    result = compare(spark, con, name, QUERIES[name], ORACLE[name], FOLDER)
    assert result.startswith("ok "), result


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert {"district", "female_ratio", "risk_level"} <= set(df.columns)
    assert df.count() > 0
