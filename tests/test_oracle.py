"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    status, _, _, note = compare(spark, duck, FOLDER, QUERIES[name], ORACLES.get(name))
    spark.catalog.clearCache()
    assert status in ("ok", "rows-only", "EMPTY"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
