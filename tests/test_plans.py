"""Physical plans that matter at scale: what happens before the first shuffle."""

import os

import pytest

from orbitile.plans import select_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tested", [select_queries.tested_scenes, select_queries.fleet_tests])
def test_tests_are_cut_before_the_shuffle(spark, tested):
    """A group limit stands below the first exchange, and scores are worked out above it."""
    plan = plan_of(tested(spark, SF)).split("\n")
    limits = [k for k, line in enumerate(plan) if "WindowGroupLimit" in line]
    assert len(limits) == 2
    between = plan[limits[0] : limits[1]]
    assert any("Exchange" in line for line in between)
    # lines further down run earlier: the score's view term is in none of those below the upper limit
    assert not any("view_zenith" in line and "/ 40.0" in line for line in plan[limits[0] :])


def test_counts_combine_before_the_shuffle(spark):
    plan = plan_of(select_queries.tested_scenes(spark, SF))
    assert "partial_count(1)" in plan


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(select_queries.last_resort(spark, SF))
    assert "ReadSchema" in plan and "session" not in plan.split("ReadSchema")[1].split("\n")[0]
