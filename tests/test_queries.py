"""Every registered query with a SQL twin, compared on the smallest tables; the rest must give rows."""

import os

import pytest

from shelfmark.plans.catalog import ORACLES, QUERIES
from tests.oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], database) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.columns and frame.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
