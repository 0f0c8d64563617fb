"""The physical plans queries are meant to have."""

import re

import pytest

from loam.catalogue import all_queries
from tests.conftest import SMALL

QUERIES = all_queries()
# Plans of streams are those of their sink tables.
BATCH = [n for n in QUERIES if not re.match(r"(str|snk|ddl|src[125]_|ord6|flt8|flt10)", n)]


def pushed(text):
    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text)


@pytest.mark.parametrize("name", sorted(BATCH))
def test_no_nested_loops_and_no_row_by_row_python(spark, plan, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "Python" not in text
    if name != "sql4_range_join":  # a user's own range condition on three bands
        assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(n for n in BATCH if not n.startswith("sql")))
def test_windows_always_have_a_key(spark, plan, name):
    """A window without a partition key would put all rows into one task."""
    for keys in re.findall(r"\n.*?Window \[.*\], \[(.*?)\], \[", plan(QUERIES[name](spark, SMALL))):
        assert keys


def test_rank_limits_apply_before_the_shuffle(spark, plan):
    for name in ("win7_last_messages", "win6_query_history"):
        text = plan(QUERIES[name](spark, SMALL))
        assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_top_rows_do_not_sort_everything(spark, plan):
    for name in ("ord2_latest_of_sensor", "ord1_ledger_page", "agg2_total_beside_page", "sql1_join_group_topk"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SMALL))


def test_filters_reach_the_scan(spark, plan):
    assert any("GreaterThanOrEqual(ts" in p for p in pushed(plan(QUERIES["ddl4_retention"](spark, SMALL))))
    assert any("EqualTo(o_orderpriority" in p for p in pushed(plan(QUERIES["sql3_semi_anti"](spark, SMALL))))


def test_scans_read_only_what_is_needed(spark, plan):
    text = plan(QUERIES["agg16_message_counters"](spark, SMALL))
    assert "event_type" not in text and "props" not in text
    text = plan(QUERIES["agg1_sliding_counts"](spark, SMALL))
    assert "props" not in text and "value" not in text.split("ReadSchema")[1]


def test_tenant_function_folds_into_the_filter(spark, plan):
    text = plan(QUERIES["flt3_tenant_function"](spark, SMALL))
    assert "current_user_tenant" not in text.lower()


def test_sliding_windows_count_before_copying(spark, plan):
    """Rows are reduced to panes by a partial aggregate below the copy into windows."""
    text = plan(QUERIES["agg1_sliding_counts"](spark, SMALL))
    assert text.index("Generate explode") < text.rindex("partial_count")


def test_or_join_is_one_equi_join(spark, plan):
    text = plan(QUERIES["jn6_farm_sensors"](spark, SMALL))
    assert len(re.findall(r"(?:BroadcastHashJoin|SortMergeJoin)", text)) == 1
