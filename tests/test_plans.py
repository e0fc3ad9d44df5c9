"""What the physical plans must and must not hold."""

import re
from datetime import datetime

import pytest

import __spark_entry__ as entry
from abacist.operators import metrics
from abacist.plans.views import view

D = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return QUERIES[name](spark, D)._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_pairs_of_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name, pushed", [
    ("dau", r"GreaterThanOrEqual\(ts,2024-01-01T00:00\)"), ("coin_purchase_totals", r"GreaterThanOrEqual\(ts,2024-01-01T00:00\)"),
    ("abuse_reports", r"GreaterThanOrEqual\(l_shipdate,2000-08-02T00:00\)"), ("system_perf", r"GreaterThanOrEqual\(ts,2024-01-24T00:00\)"),
    ("dashboard_summary", r"LessThan\(ts,2024-01-31T00:00\)"),
])
def test_time_filters_reach_the_scan(spark, name, pushed):
    assert re.search(r"PushedFilters: .*" + pushed + r".*ReadSchema", plan(spark, name))


def test_the_range_of_an_export_reaches_the_scan(spark):
    rows = metrics.export_metrics(view(spark, D, "model_metrics"), datetime(2024, 1, 10), datetime(2024, 1, 20, 12))
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: .*LessThanOrEqual\(ts,2024-01-20T12:00\)", text)


@pytest.mark.parametrize("name", ["consent_status", "wallet_recent", "model_metrics_recent", "version_compare", "rapid_fire_gaps",
                                  "fixed_window_limit", "sink_upsert", "vector_topk"])
def test_latest_k_is_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert re.search(r"WindowGroupLimit .* Partial", text)


@pytest.mark.parametrize("name, columns", [("dau", {"ts", "user_id", "event_type"}), ("privacy_report", {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"})])
def test_only_used_columns_are_read(spark, name, columns):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)):
        assert {c.split(":")[0] for c in schema.split(",")} == columns


def test_distinct_users_are_merged_before_the_shuffle(spark):
    text = plan(spark, "dau")
    assert text.index("HashAggregate(keys=[date") < text.rindex("Exchange hashpartitioning(date") < text.rindex("HashAggregate(keys=[date")


def test_newest_tickets_take_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "tickets_by_status")
