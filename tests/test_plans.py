"""What Spark makes of the queries: joins, shuffles, scans and generated code."""

import re

import pytest

from claimspan.plans import aggregates, counts
from claimspan.plans.build import build_claims
from claimspan.plans.inventory import inventory, inventory_by
from claimspan.schemas import CLAIMS_WITH_DURATIONS
from claimspan.sources.csv_inputs import analyst_parameters, diagnosis_parameters
from claimspan.sources.tables import conform, read_stage, write_stage
from support import ROOT, SF
from harness import derived
from harness.registry import (
    CLAIMS_QUERIES, CUBE_QUERIES, PERIOD, QUERIES, TODAY, shared_path,
)

HOTSPOT_LIMIT = 8000


@pytest.fixture(scope="module")
def static_plans(spark):
    """Plans without run-time changes, so that generated code shows before execution."""
    spark.catalog.clearCache()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def raw_table(spark):
    path = shared_path(spark, "raw")
    derived.claims_raw_biz(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def claims_table(spark):
    path = shared_path(spark, "claims")
    write_stage(derived.claims_with_durations(spark, SF), path, CLAIMS_WITH_DURATIONS)
    return read_stage(spark, path, CLAIMS_WITH_DURATIONS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def explained(spark, df, mode):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def method_sizes(spark, df):
    code = explained(spark, df, "codegen")
    return [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)]


@pytest.fixture(scope="module")
def build(spark, static_plans, raw_table, calendar):
    built = build_claims(raw_table, analyst_parameters(spark), diagnosis_parameters(spark),
                         calendar)
    return conform(built, CLAIMS_WITH_DURATIONS)


def test_build_runs_without_a_shuffle(build):
    plan = plan_of(build)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 2
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Python" not in plan
    assert plan.count("FileScan") == 1


def test_build_generates_code_that_hotspot_compiles(spark, build):
    sizes = method_sizes(spark, build)
    assert sizes and max(sizes) < HOTSPOT_LIMIT


@pytest.mark.parametrize("query", [
    lambda c: inventory(c, "2020-01-15"),
    lambda c: inventory_by(c, "2020-01-15", ["claims_analyst", "diagnosis"]),
    lambda c: aggregates.agg_tat(c, *PERIOD, ["claims_analyst"]),
    lambda c: aggregates.agg_gen(c, *PERIOD, ["claims_analyst", "igo_nigo"]),
    lambda c: aggregates.agg_tat_drilldown(c, *PERIOD),
    aggregates.claims_agg_base,
])
def test_aggregates_scan_once_and_aggregate_before_the_shuffle(spark, static_plans,
                                                               claims_table, query):
    df = query(claims_table)
    plan = plan_of(df)
    assert plan.count("FileScan") == 1
    assert "partial_" in plan
    assert "Join" not in plan and "Python" not in plan and "Window" not in plan
    assert max(method_sizes(spark, df)) < HOTSPOT_LIMIT
    # Below the first shuffle there is nothing but scan, filter, projection and aggregate.
    below = plan.rsplit("Exchange", 1)[1]
    assert "HashAggregate" in below and "Expand" not in below


@pytest.mark.parametrize("key", CLAIMS_QUERIES)
def test_queries_on_a_stored_table_generate_code_that_hotspot_compiles(spark, static_plans,
                                                                       claims_table, key):
    sizes = method_sizes(spark, CLAIMS_QUERIES[key](claims_table))
    assert sizes and max(sizes) < HOTSPOT_LIMIT


def test_scan_reads_only_the_columns_it_needs(spark, static_plans, claims_table, calendar):
    df = counts.claims_decided(claims_table, "TAT_gt_n_in_period", TODAY, calendar,
                               months_before=2, biz_days_count=10)
    plan = explained(spark, df, "formatted")
    assert "ReadSchema: struct<decided_2_date:date,total_biz_days:int>" in plan
    assert "GreaterThanOrEqual(decided_2_date,2020-02-10)" in plan
    assert "GreaterThan(total_biz_days,10)" in plan


def test_pending_days_become_a_date_that_reaches_the_scan(spark, static_plans, claims_table, calendar):
    df = counts.decision_inventory(claims_table, "pending_gt_n_days", TODAY, calendar, 10)
    plan = explained(spark, df, "formatted")
    assert "LessThanOrEqual(received_date,2020-03-26)" in plan
    assert "ReadSchema: struct<received_date:date,decided_2_date:date>" in plan


def test_inventory_condition_reaches_the_scan(spark, static_plans, claims_table):
    plan = explained(spark, inventory(claims_table, "2020-01-15"), "formatted")
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "LessThan(received_date,2020-01-15)" in pushed
    assert "GreaterThanOrEqual(return_to_work_date,2020-01-15)" in pushed


def test_queries_without_customer_columns_do_not_read_customers(spark, static_plans):
    plan = plan_of(QUERIES["inventory"](spark, SF))
    assert plan.count("FileScan") == 1 and "orders.parquet" in plan


# These write or collect something by what they are.
NOT_LAZY = {"param_analyst", "param_diagnosis", "ingest_claims_raw", "stage_roundtrip",
            "stage_append", "inventory_history", "export_csv", "export_json", *CUBE_QUERIES}


def test_asking_for_a_query_runs_nothing(spark):
    """Building plans starts no job but those that read a file's schema."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "building plans")
    try:
        for key, query in QUERIES.items():
            if key not in NOT_LAZY:
                query(spark, SF)
        stages = [s for job in tracker.getJobIdsForGroup("lazy")
                  for s in tracker.getJobInfo(job).stageIds]
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    # A schema is read by one task in one stage; a query of ours has more of either.
    assert all(tracker.getStageInfo(s) is None or tracker.getStageInfo(s).numTasks == 1
               for s in stages)
    text = "".join(p.read_text() for folder in ("claimspan", "harness")
                   for p in (ROOT / folder).rglob("*.py") if "llm" not in p.parts)
    assert ".rdd" not in text
