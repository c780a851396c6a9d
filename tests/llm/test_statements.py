"""Queries of the subpackage against their SQL on the given tables."""

from __future__ import annotations

import os

import compare
import pytest

from rollatlas.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.statements()))
def test_same_result(spark, name):
    con = compare.connect(FOLDER)
    want = con.execute(queries.statements()[name]).to_arrow_table()
    got = queries.registry()[name](spark, FOLDER).toArrow()
    con.close()
    assert compare.differences(got, want) == []
    assert got.num_rows > 0
