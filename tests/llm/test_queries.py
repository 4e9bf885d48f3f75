"""Every query of the training-data operators that has a SQL twin, compared with it on the smallest tables."""

import os

import pytest

from shelfmark.llm.queries import ORACLES, QUERIES
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


def test_all_are_registered():
    import __spark_entry__ as entry

    numbers = sorted(int(n[2:].partition("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
