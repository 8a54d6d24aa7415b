"""All named queries of the catalog against their SQL texts, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from limpid.catalog import cleaning, profiling, records
from tests.compare import compare, connect

FOLDER = os.environ.get("LIMPID_TEST_TABLES", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = [name for part in (profiling, cleaning, records) for name in part.QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message = compare(spark, con, FOLDER, QUERIES[name], SQL.get(name))
    assert ok, message


def test_entry(spark):
    if FOLDER == "/root/testdata/sf0.001":
        assert entry.entry(spark).count() == 1


def test_every_sql_text_has_its_query():
    assert set(SQL) <= set(QUERIES) and set(NAMES) <= set(QUERIES)
