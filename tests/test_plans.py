"""Plans hold what they should: pruned columns, pushed filters, no nested loops."""

import re

import pytest

from lexloom.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "table", "columns"),
    [("word_count_by_source", "training_lines", {"source", "text"}), ("split_counts", "training_lines", {"line_id", "source"}), ("eval_rollup", "development", {"source", "actual", "ngram_rank"}), ("seed_summary", "timing", {"method_name", "milliseconds", "round_no", "case_id", "actual", "ngram_rank"})],
)
def test_scans_read_what_is_needed(spark, name, table, columns):
    text = plan(QUERIES[name](spark, SMALL))
    read = [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text)]
    assert read and all(r <= columns for r in read)


def test_filters_reach_the_scan(spark):
    assert "IsNotNull(actual)" in plan(QUERIES["eval_rollup"](spark, SMALL))
    assert "IsNotNull(milliseconds)" in plan(QUERIES["latency_summary"](spark, SMALL))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops(spark, name):
    # a calibration needs cases of both outcomes
    text = plan(QUERIES[name](spark, SMALL.replace("0.001", "0.01") if name.startswith("calibration") else SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
