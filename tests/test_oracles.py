"""Every registered query against its SQL on the given tables."""

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.database(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.differences(df, con, sql) is None
        assert df.take(1), "no row on either side proves nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
