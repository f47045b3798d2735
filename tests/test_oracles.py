"""Every checked query against its SQL oracle on the smallest driver tables."""

import os

import pytest

from checks import catalog
from checks.run import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    sql = catalog.ORACLES.get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert compare(con, sql, df) is None


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
