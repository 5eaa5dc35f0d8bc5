"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from checks.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry.queries())


def test_entry_gives_one_scored_row(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0 <= rows[0]["overall"] <= 100


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None
