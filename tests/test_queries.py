"""Every registered query against its SQL, and the plans the batch queries get."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lakestream.plans import registry
from tools.compare import compare, connect

STREAMS = {
    "customer_order_analytics_stream",
    "evolve_stream_upsert",
    "late_data",
    "restart_last_state",
    "restart_savepoint",
    "restart_stateless",
    "sql_script_stream",
    "state_session_timeout",
    "stateful_count",
    "stream_dedup",
    "stream_dlq",
    "state_snapshot",
    "stream_join_ack",
    "stream_join_left",
    "stream_rate_limited",
    "stream_routed",
    "stream_routed_topics",
    "stream_sink_metrics",
    "stream_upsert_final",
    "tumble_hourly_stream",
}
PYTHON = {"match_pattern", "udf_scalar", "udaf_geo_mean", "udtf_ngrams"}
# final aggregates to a single row
ONE_ROW = {"conformance", "force_optional", "replay_idempotent"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "lake_table" in df.columns


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, sf_dir)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - STREAMS))
def test_plan(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
    if name not in ONE_ROW:
        assert "SinglePartition" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "Pandas" not in plan


def test_partition_pruning(spark, sf_dir):
    plan = entry.queries()["scan_prune"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = entry.queries()["pricing_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_quantity,24.0)" in plan
    assert "l_tax" not in plan.split("ReadSchema")[1]
