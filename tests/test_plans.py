"""Plan-level guarantees of the registered queries (checked on the physical
plans, not on results)."""

import pytest

from tracekit.plans import catalog

from .conftest import SF_SMALL

ROW_LOCAL = ["repeat_flags", "repeat_filter_t2", "repeated_sentences", "last_boxed", "final_answers",
             "normalize_answer", "assistant_segment", "parse_trace_lines", "budget_from_path", "render_chat"]
BUILT_EAGERLY = {"stream_curation_report"}


def _plan(spark, name):
    return catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: _plan(spark, n) for n in catalog.QUERIES if n not in BUILT_EAGERLY}


def test_no_cross_join_and_no_python(plans):
    for name, plan in plans.items():
        for bad in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]:
            assert bad not in plan, (name, bad)


def test_row_local_queries_do_not_shuffle(plans):
    for name in ROW_LOCAL:
        assert "ENSURE_REQUIREMENTS" not in plans[name], name


def test_columns_pruned_at_scan(plans):
    scan = [line for line in plans["correct_untruncated"].splitlines() if "FileScan" in line][0]
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in scan
    assert "PushedFilters: [IsNotNull(doc_id), IsNotNull(n_chars), LessThanOrEqual(n_chars,8000)]" in scan


def test_gold_side_broadcast_by_size(plans):
    assert "BroadcastHashJoin" in plans["score_answers"]
    assert "SortMergeJoin" not in plans["score_answers"]


def test_thinking_responses_are_parsed_once(spark):
    for name in ("thinking_stats", "thinking_stats_steps"):
        plan = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("substring_index(") == 2, name  # before and after the answer tag
        assert plan.count("split(substring_index(") + plan.count("|im_start|>\\E") == 1, name
