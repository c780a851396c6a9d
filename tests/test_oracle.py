"""Every registered query against its reference SQL on the given tables."""

from __future__ import annotations

import os

import compare
import pytest

import __spark_entry__ as entry
from rollatlas.catalog import oracle
from rollatlas.catalog import queries as catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = catalog.registry()
SQL = oracle.statements()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = compare.connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_result(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    want = duck.execute(SQL[name]).to_arrow_table()
    assert compare.differences(got, want) == []


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
