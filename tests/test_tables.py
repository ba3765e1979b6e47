import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from claimspan.constants import MILESTONES
from claimspan.plans.aggregates import agg_tat, claims_agg_base
from claimspan.plans.inventory import inventory, inventory_by
from claimspan.schemas import (
    ANALYST_PARAMS, CLAIMS_EXTENDED, CLAIMS_RAW_BIZ, CLAIMS_WITH_DURATIONS, DIAGNOSIS_PARAMS,
)
from claimspan.sources.csv_inputs import (
    analyst_parameters, diagnosis_parameters, read_parameters,
)
from claimspan.sources.exports import (
    export_csv, export_json, export_name, grouped_root, json_rows,
)
from claimspan.sources.tables import (
    conform, duplicate_keys, read_stage, require_unique, write_stage,
)
from support import SF
from harness import derived
from harness.registry import CLAIMS_QUERIES, QUERIES, shared_path


@pytest.fixture(scope="module")
def claims(spark):
    return conform(derived.claims_with_durations(spark, SF), CLAIMS_WITH_DURATIONS).cache()


@pytest.fixture(scope="module")
def by_month(spark, claims):
    path = shared_path(spark, "by_month")
    write_stage(claims, path, CLAIMS_WITH_DURATIONS, key="claim_num", by_decided_month=True)
    return read_stage(spark, path, CLAIMS_WITH_DURATIONS)


def test_schemas_extend_each_other():
    assert [len(s) for s in (CLAIMS_RAW_BIZ, CLAIMS_EXTENDED, CLAIMS_WITH_DURATIONS)] == [27, 41, 59]
    assert set(CLAIMS_RAW_BIZ.names) < set(CLAIMS_EXTENDED.names)
    assert CLAIMS_WITH_DURATIONS.fields[:41] == CLAIMS_EXTENDED.fields


def test_conform_names_missing_columns(spark):
    with pytest.raises(ValueError, match="customer_num"):
        conform(spark.createDataFrame([(1,)], ["claim_num"]), CLAIMS_RAW_BIZ)


def test_roundtrip_in_key_order(spark, claims):
    path = shared_path(spark, "plain")
    write_stage(claims.limit(5), path, CLAIMS_WITH_DURATIONS)
    write_stage(claims, path, CLAIMS_WITH_DURATIONS)  # replaces, does not append
    read = read_stage(spark, path, CLAIMS_WITH_DURATIONS, order_by="claim_num")
    assert read.schema.names == CLAIMS_WITH_DURATIONS.names
    numbers = [r.claim_num for r in read.select("claim_num").collect()]
    assert numbers == sorted(numbers) and len(numbers) == claims.count()
    assert read.exceptAll(claims).isEmpty()


def test_duplicates_are_found_and_refused(spark, claims):
    twice = claims.union(claims.where("claim_num in (3, 4)"))
    found = {(r.claim_num, r["count"]) for r in duplicate_keys(twice, "claim_num").collect()}
    assert found == {(3, 2), (4, 2)}
    path = shared_path(spark, "unique")
    write_stage(claims, path, CLAIMS_WITH_DURATIONS)
    with pytest.raises(ValueError, match="duplicate key claim_num"):
        write_stage(twice, path, CLAIMS_WITH_DURATIONS, key="claim_num")
    assert read_stage(spark, path, CLAIMS_WITH_DURATIONS).count() == claims.count()
    assert require_unique(claims, "claim_num") is claims


def test_table_by_month_gives_the_same_results(claims, by_month):
    for query in (lambda c: agg_tat(c, "2020-01-20", "2020-02-10", ["geo"]),
                  lambda c: inventory_by(c, "2020-01-15", ["industry"])):
        assert query(by_month).collect() == query(claims).collect()


def test_table_by_month_prunes_partitions(spark, by_month):
    df = agg_tat(by_month, "2020-02-03", "2020-02-28")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "decided_month" in re.search(r"PartitionFilters: \[(.*)\]", plan).group(1)
    assert "decided_2_date" in re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    months = by_month.select("decided_month").distinct().count()
    assert months > 3
    read = by_month.where("decided_month = date '2020-02-01'").inputFiles()
    assert len(read) >= 1


AS_OF = {
    "decided_month": ["decision_inventory_total", "decision_inventory_pending_gt_n"],
    "closed_month": ["claims_received_this_year", "claims_received_this_month",
                     "payout_inventory_total", "payout_inventory_missed_touches",
                     "returned_to_work_total", "returned_to_work_duration_gt_pct", "inventory",
                     "inv_agg_by_analyst", "inv_agg_by_diagnosis_igo"],
}


@pytest.mark.parametrize("month,key", [(m, key) for m, keys in AS_OF.items() for key in keys])
def test_as_of_and_period_queries_prune_partitions(spark, claims, by_month, month, key):
    df = CLAIMS_QUERIES[key](by_month)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert f"{month}#" in re.search(r"PartitionFilters: \[(.*)\]", plan).group(1)
    assert df.collect() == CLAIMS_QUERIES[key](claims).collect()


def test_irregular_claims_on_a_table_by_month(spark, claims_of):
    """Dates out of order, missing dates, no date at all: pruned and plain results agree."""
    day = dt.date.fromisoformat
    odd = claims_of(
        {}, {"received_date": None}, {"decided_2_date": None}, {"return_to_work_date": None},
        {"decided_1_date": day("2021-01-01")}, {"decided_2_date": day("2019-12-01")},
        {"nurse_reviewed_date": day("2020-12-31"), "decided_2_date": None},
        {name: None for name in (*MILESTONES, "return_to_work_date")})
    path = shared_path(spark, "odd")
    write_stage(odd, path, CLAIMS_WITH_DURATIONS, by_decided_month=True)
    stored = read_stage(spark, path, CLAIMS_WITH_DURATIONS)
    assert stored.count() == 8
    for when in ("2020-01-07", "2020-01-22", "2020-02-15", "2020-11-30", "2021-03-01"):
        assert inventory(stored, when).collect() == inventory(odd, when).collect()


def test_a_failed_or_refused_write_leaves_the_old_table(spark, claims):
    path = shared_path(spark, "kept")
    write_stage(claims.limit(5), path, CLAIMS_WITH_DURATIONS, key="claim_num")
    broken = claims.withColumn("geo", F.raise_error(F.lit("no geo")).cast("string"))
    with pytest.raises(Exception, match="no geo"):
        write_stage(broken, path, CLAIMS_WITH_DURATIONS)
    assert read_stage(spark, path, CLAIMS_WITH_DURATIONS).count() == 5
    again = read_stage(spark, path, CLAIMS_WITH_DURATIONS)
    write_stage(again, path, CLAIMS_WITH_DURATIONS)  # a table may replace itself
    assert read_stage(spark, path, CLAIMS_WITH_DURATIONS).count() == 5


def test_orders_without_a_customer_are_claims(spark):
    """Left out of no query; geo and industry are null."""
    folder = shared_path(spark, "tables")
    for name in ("orders", "nation", "region", "customer"):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        kept = table.where("c_custkey % 7 > 0") if name == "customer" else table
        kept.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    known = derived.raw_claims(spark, folder)
    assert known.count() == derived.raw_claims(spark, folder, dims=False).count() == orders
    assert known.where("geo is null and industry is null").count() > 0
    base = claims_agg_base(derived.claims_with_durations(spark, folder)).collect()
    assert sum(r.total_count for r in base) == 8 * orders
    assert any(r.geo is None for r in base)


def test_parameter_headers_are_checked(spark):
    path = shared_path(spark, "parameters")
    analyst_parameters(spark).withColumnRenamed("analyst", "ANALYST").coalesce(1).write.csv(
        path, header=True)
    read = read_parameters(spark, path, ANALYST_PARAMS)
    assert sorted(read.collect()) == sorted(analyst_parameters(spark).collect())
    swapped = shared_path(spark, "swapped")
    diagnosis_parameters(spark).select(
        "diagnosis", "max_duration_days", "min_duration_days",
        *DIAGNOSIS_PARAMS.names[3:]).coalesce(1).write.csv(swapped, header=True)
    with pytest.raises(Exception, match="(?i)header"):
        read_parameters(spark, swapped, DIAGNOSIS_PARAMS).collect()


def test_a_busy_month_spreads_over_tasks(spark, claims):
    busy = claims.withColumn("decided_2_date", F.lit("2020-02-03").cast("date")).repartition(16)
    path = shared_path(spark, "busy")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        write_stage(busy, path, CLAIMS_WITH_DURATIONS, by_decided_month=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    written = read_stage(spark, path, CLAIMS_WITH_DURATIONS)
    sizes = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < busy.count() / 2
    assert written.count() == busy.count()


def test_export_names():
    at = dt.datetime(2020, 5, 4, 19, 19)
    assert export_name("inventory_as_of__2020-01-15", at) == (
        "2020-05-04--19-19__inventory_as_of__2020-01-15")
    assert grouped_root(["geo", "industry"]) == "claims_grouped_by__geo__industry"
    assert grouped_root([]) == "claims_grouped_by__empty_column_list"


def test_csv_export(spark, claims):
    result = agg_tat(claims, "2019-12-01", "2019-12-01")  # most of its cells are null
    path = export_csv(result, shared_path(spark, "csv"), "agg_TAT")
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == ",".join(result.columns)
    assert spark.read.csv(path, header=True, schema=result.schema).collect() == result.collect()


def test_json_exports(spark, claims):
    result = inventory(claims, "2020-01-15")
    texts = [json.loads(r.json) for r in json_rows(result).collect()]
    assert texts == [r.asDict() for r in result.collect()]
    empty = agg_tat(claims, "2015-12-01", "2015-12-01")
    assert json.loads(json_rows(empty).head().json)["avg_tat"] is None
    path = export_json(empty, shared_path(spark, "json"), "agg_TAT")
    assert json.loads(spark.read.text(path).head()[0]) == {**empty.head().asDict()}


@pytest.mark.parametrize("query", ["stage_roundtrip", "stage_append"])
def test_more_claims_than_the_stride(spark, tmp_path, query):
    """Copies then share claim numbers; every one of them is stored all the same."""
    for name in ("customer", "nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    few = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 20")
    orders = few.union(few.withColumn("o_orderkey", F.expr("o_orderkey + 3000000")))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES[query](spark, str(tmp_path))
    assert found.schema.names == CLAIMS_WITH_DURATIONS.names
    assert found.count() == 40 * 8 and found.select("claim_num").distinct().count() == 20 * 11
    expected = derived.claims_with_durations(spark, str(tmp_path)).select(*found.columns)
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    orders.union(few.limit(1)).write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    with pytest.raises(ValueError, match="duplicate key"):
        QUERIES[query](spark, str(tmp_path))


def test_a_write_does_not_move_rows(spark, claims, tmp_path):
    """Each task writes its own rows: shuffling and sorting them cost more than the table."""
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    one_month = claims.where("decided_2_date is not null").limit(30).withColumn(
        "decided_2_date", F.lit("2020-02-03").cast("date")).withColumns(
        {day: F.lit("2020-02-04").cast("date") for day in (*MILESTONES[:-1], "return_to_work_date")})
    rows = one_month.toArrow().to_pylist()
    spread = spark.createDataFrame(rows, CLAIMS_WITH_DURATIONS).repartition(3)
    for layout in ("by_decided_month", "by_open_interval"):
        write_stage(spread, str(tmp_path / layout), CLAIMS_WITH_DURATIONS, **{layout: True})
        assert len(list((tmp_path / layout).rglob("*.parquet"))) == 3
        read = read_stage(spark, str(tmp_path / layout), CLAIMS_WITH_DURATIONS)
        assert sorted(r.claim_num for r in read.collect()) == sorted(r["claim_num"] for r in rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
