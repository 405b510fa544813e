"""What the plans of some queries must and must not hold."""

import re

import pytest

from tarnfold import plans

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return plans.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_is_used(spark):
    p = plan(spark, "language_scores")
    assert re.findall(r"ReadSchema: struct<([^>]*)>", p) == ["o_custkey:bigint,o_orderstatus:string,o_orderpriority:string"]
    p = plan(spark, "runs_filtered_sorted")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", p) and "In(c_mktsegment" in p


def test_no_shuffle_where_rows_stand_alone(spark):
    for name in ("document_lines", "lines_within_budget", "line_numbers", "truncate_output", "api_cost_openai", "chunk_documents", "number_formats", "path_segments"):
        assert "Exchange" not in plan(spark, name), name


def test_top_k_is_no_sort(spark):
    p = plan(spark, "history_search")
    assert "TakeOrderedAndProject" in p and "Exchange" not in p.split("TakeOrderedAndProject")[1]


def test_top_k_of_many_queries_cuts_before_it_exchanges(spark):
    """Tasks send their best points a query only: nothing but those crosses the one exchange."""
    for name in ("vector_topk", "vector_topk_filtered"):
        p = plan(spark, name)
        below = p.split("Exchange")
        assert len(below) == 2 and "MapInArrow" in below[1] and "WindowGroupLimit" in p, name


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - {"tree_costs"}))
def test_no_nested_loops(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_windows_are_by_task(spark):
    for name in ("conversation_truncate", "event_islands", "command_grouping", "character_budget"):
        assert "SinglePartition" not in plan(spark, name), name
