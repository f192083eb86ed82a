"""Plan shapes that must hold at any size."""

import re

import pytest

from cuesheet.queries import gather

SF = "/root/testdata/sf0.001"
QUERIES = gather("queries")


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["flatten_overlaps", "visible_at", "text_at", "snap_edges", "rebase_to_clips", "clip_windows", "assign_turns", "translation_payloads", "insert_at"]
)
def test_interval_operators_use_equal_keys(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Join" in plan or name == "insert_at"


def test_scan_reads_only_needed_columns(spark):
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan_of(spark, "latest_status")).group(1)
    assert "props" not in schema
    plan = plan_of(spark, "before_cancel")
    assert "PushedFilters: [IsNotNull(user_id)" in plan or "PushedFilters" in plan


def test_top_clips_are_trimmed_before_the_shuffle(spark):
    plan = plan_of(spark, "clip_candidates")
    assert "WindowGroupLimit" in plan


def test_one_shuffle_serves_consecutive_windows(spark):
    plan = plan_of(spark, "fix_overlaps")
    assert plan.count("Exchange hashpartitioning") == 1
