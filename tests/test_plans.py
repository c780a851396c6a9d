"""Plan shapes that must hold on large tables."""

from __future__ import annotations

import os

import pytest
from helpers import plan_of

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize(
    "name", ["school_counts", "school_links", "geocode_schools", "district_map_view", "page_schools", "search_terms", "broken_links", "quality_report"]
)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "InPandas" not in plan


def test_row_operators_do_not_shuffle(spark):
    for name in ("internal_links", "page_link_counts", "guide_outline", "addresses", "boundary_boxes"):
        plan = plan_of(entry.queries()[name](spark, FOLDER))
        shuffles = plan.count("\n* Exchange") + plan.count("hashpartitioning")
        # boundary_boxes keeps the last feature per key.
        assert shuffles <= 1, name


def test_counts_are_combined_before_the_join(spark):
    plan = plan_of(entry.queries()["school_counts"](spark, FOLDER))
    assert plan.count("partial_count") == 1
    assert "c_acctbal" not in plan.split("ReadSchema")[1] or "c_mktsegment" not in plan
