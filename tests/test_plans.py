"""Plan invariants behind the scale design (guards against regressions)."""

import os
import sys

import __spark_entry__ as E
from conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from plan_shapes import shape  # noqa: E402


def _plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_page_queries_shuffle_once_and_never_join(spark):
    for name in ("main_content", "clean_text", "raw_markdown", "links", "link_counts",
                 "view_prompts", "view_outputs", "plain_text"):
        s = shape(_plan(spark, name))
        assert s["shuffles"] == 1 and s["joins"] == 0 and s["broadcasts"] == 0, (name, s)
        assert s["python"] == 0, name


def test_no_cartesian_or_nested_loop_join_anywhere(spark):
    for name in E.queries():
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_page_scans_read_only_needed_columns(spark):
    # Per-page outputs read page_id, url, html; token-level ones not even url.
    assert "page_id:bigint,url:string,html:string>" in _plan(spark, "main_content")
    assert "struct<page_id:bigint,html:string>" in _plan(spark, "html_tokens")
