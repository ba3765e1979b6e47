"""Answers from a stored cube equal those from the claims, without a scan of them."""

import pytest
from pyspark.sql import functions as F

from claimspan.constants import PERMITTED_COLUMNS
from claimspan.plans import aggregates
from claimspan.plans.cube import add_to_cube, cube_of, merged, read_cube, write_cube
from harness import derived
from harness.registry import PERIOD, shared_path
from support import SF, date


@pytest.fixture(scope="module")
def claims(spark):
    path = shared_path(spark, "claims")
    derived.claims_with_durations(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def cube(spark, claims):
    path = shared_path(spark, "cube")
    write_cube(claims, path)
    return read_cube(spark, path)


QUERIES = {
    "tat": lambda c: aggregates.agg_tat(c, *PERIOD),
    "tat_by_all": lambda c: aggregates.agg_tat(c, *PERIOD, PERMITTED_COLUMNS),
    "tat_of_no_claim": lambda c: aggregates.agg_tat(c, "2015-01-01", "2015-02-01"),
    "gen": lambda c: aggregates.agg_gen(c, *PERIOD),
    "gen_of_no_claim": lambda c: aggregates.agg_gen(c, "2015-01-01", "2015-02-01"),
    "gen_by_geo": lambda c: aggregates.agg_gen(c, *PERIOD, ["geo", "accuracy_of_decision"]),
    "gen_of_a_day": lambda c: aggregates.agg_gen(c, PERIOD[0], PERIOD[0], ["diagnosis"]),
    "drilldown": lambda c: aggregates.agg_tat_drilldown(c, *PERIOD, ["geo", "industry"]),
    "base": aggregates.claims_agg_base,
}


@pytest.mark.parametrize("name", QUERIES)
def test_equal_results_without_the_claims(spark, claims, cube, name):
    answer = QUERIES[name](cube)
    plan = answer._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "part_claims" in plan
    assert "sum(part_claims" in plan and "sum(over_five_biz_days" not in plan
    direct = QUERIES[name](claims)
    assert answer.schema.names == direct.schema.names
    assert [f.dataType for f in answer.schema] == [f.dataType for f in direct.schema]
    assert answer.collect() == direct.collect()


def test_a_drilldown_prunes_files_of_other_days(spark, cube):
    plan = spark._jvm.PythonSQLUtils.explainString(
        QUERIES["tat"](cube)._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(decided_2_date" in plan
    assert "ReadSchema: struct<decided_2_date:date,part_claims:bigint" in plan


def test_a_cube_grows_by_batches(spark, claims, cube):
    path = shared_path(spark, "grown")
    write_cube(claims.where("claim_num % 3 = 0"), path)
    for rest in (1, 2):
        add_to_cube(claims.where(f"claim_num % 3 = {rest}"), path)
    grown = read_cube(spark, path)
    assert grown.exceptAll(cube).isEmpty() and grown.count() == cube.count()


def test_claims_with_missing_values(claims_of):
    """Nulls in days, dimensions and measures; all-null groups keep their nulls."""
    odd = claims_of(
        {}, {"decided_2_date": None}, {"geo": None, "total_biz_days": None},
        {"igo_nigo": None}, {"total_claims_analyst_hours": None, "claims_analyst": "Nobody"},
        {"total_biz_days": None, "claims_analyst": "Nobody"},
        {"decided_2_date": date("2020-02-05"), "decision": "Declined"},
        {"decided_2_date": date("2020-02-28"), "salary_per_month": 4_100})
    halves = merged(cube_of(odd.where("claim_num < 4")), cube_of(odd.where("claim_num >= 4")))
    for cube in (cube_of(odd), halves):
        for query in (lambda c: aggregates.agg_gen(c, "2020-01-01", "2020-03-01", ["claims_analyst"]),
                      lambda c: aggregates.agg_tat(c, "2020-01-01", "2020-03-01", ["igo_nigo"]),
                      lambda c: aggregates.agg_tat_drilldown(c, "2020-01-01", "2020-03-01"),
                      aggregates.claims_agg_base):
            assert query(cube).collect() == query(odd).collect()
    empty = cube_of(odd.where("false"))
    assert aggregates.agg_gen(empty, *PERIOD).collect() == aggregates.agg_gen(
        odd.where("false"), *PERIOD).collect()


def test_hours_are_exact(claims_of):
    """Sums of hours don't depend on how often they were summed before."""
    odd = claims_of(*({"total_claims_analyst_hours": 0.1 * n, "total_hours": 1 / (n + 1)}
                      for n in range(60)))
    parts = [cube_of(odd.where(F.col("claim_num") % 7 == i)) for i in range(7)]
    for query in (lambda c: aggregates.agg_gen(c, "2020-01-01", "2020-03-01"),
                  aggregates.claims_agg_base):
        assert query(merged(merged(*parts[:3]), merged(*parts[3:]))).collect() == query(
            odd).collect()
