"""The registered queries. Each takes a session and a folder of the given tables.

All build their claims lazily from those tables, so that a plan shows everything from
the scan on and reads only the columns it needs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from claimspan.constants import PERMITTED_COLUMNS, REPROJECTED_DATES
from claimspan.functions import dates
from claimspan.operators.cleaning import fill_missing, ingest_claims
from claimspan.operators.decisioning import backdate_receipt, stage_durations
from claimspan.operators.lookups import analyst_compliance
from claimspan.operators.payout import payout_dates, with_plan
from claimspan.plans import aggregates, counts
from claimspan.plans.cube import add_to_cube, read_cube, write_cube
from claimspan.plans.inventory import inventory, inventory_by
from claimspan.plans.known import known_on
from claimspan.schemas import (
    ANALYST_PARAMS, CLAIMS_EXTENDED, CLAIMS_WITH_DURATIONS, DIAGNOSIS_PARAMS, STAGE_DURATIONS,
    TOUCHES, extended,
)
from claimspan.sources.csv_inputs import (
    analyst_parameters, diagnosis_parameters, read_claims_export, read_parameters,
)
from claimspan.sources.exports import export_csv, export_json
from claimspan.sources.tables import (
    append_stage, conform, duplicate_keys, has_value, read_stage, write_stage,
)
from harness import derived
from harness.derived import CALENDAR
from harness.export_file import write_export

Query = Callable[[SparkSession, str], DataFrame]

TODAY = "2020-04-10"
INVENTORY_DAY = "2020-01-15"
PERIOD = ("2020-02-03", "2020-02-28")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="claimspan-")
    return f"{folder}/claimspan/{uuid.uuid4().hex}/{name}"


# ---- queries over the wide claims table -------------------------------------------------

# Key to query over claims_with_durations.
CLAIMS_QUERIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "claims_decided_this_year":
        lambda c: counts.claims_decided(c, "total_this_year", TODAY, CALENDAR),
    "claims_decided_this_month":
        lambda c: counts.claims_decided(c, "total_this_month", TODAY, CALENDAR),
    "claims_decided_biz_days":
        lambda c: counts.claims_decided(c, "total_in_period", TODAY, CALENDAR,
                                        biz_days_before=20),
    "claims_decided_months":
        lambda c: counts.claims_decided(c, "total_in_period", TODAY, CALENDAR, months_before=2),
    "claims_decided_tat_gt_n":
        lambda c: counts.claims_decided(c, "TAT_gt_n_in_period", TODAY, CALENDAR,
                                        months_before=2, biz_days_count=10),
    "claims_received_this_year":
        lambda c: counts.claims_received(c, "this_year", TODAY),
    "claims_received_this_month":
        lambda c: counts.claims_received(c, "this_month", TODAY),
    "decision_inventory_total":
        lambda c: counts.decision_inventory(c, "total", TODAY, CALENDAR),
    "decision_inventory_pending_gt_n":
        lambda c: counts.decision_inventory(c, "pending_gt_n_days", TODAY, CALENDAR, 10),
    "payout_inventory_total":
        lambda c: counts.payout_inventory(c, "total", TODAY),
    "payout_inventory_missed_touches":
        lambda c: counts.payout_inventory(c, "count_with_missed_touches", TODAY),
    "returned_to_work_total":
        lambda c: counts.claims_returned_to_work(c, "total", TODAY, CALENDAR, 2),
    "returned_to_work_duration_gt_pct":
        lambda c: counts.claims_returned_to_work(c, "duration_gt_x_percent", TODAY, CALENDAR,
                                                 2, percent=20),
    "inventory": lambda c: inventory(c, INVENTORY_DAY),
    "inv_agg_by_analyst": lambda c: inventory_by(c, INVENTORY_DAY, ["claims_analyst"]),
    "inv_agg_by_diagnosis_igo":
        lambda c: inventory_by(c, INVENTORY_DAY, ["diagnosis", "igo_nigo"]),
    "inv_agg_by_geo": lambda c: inventory_by(c, INVENTORY_DAY, ["geo"]),
    "agg_tat": lambda c: aggregates.agg_tat(c, *PERIOD),
    "agg_tat_by_analyst": lambda c: aggregates.agg_tat(c, *PERIOD, ["claims_analyst"]),
    "agg_tat_by_analyst_igo":
        lambda c: aggregates.agg_tat(c, *PERIOD, ["claims_analyst", "igo_nigo"]),
    "agg_tat_by_analyst_igo_nurse":
        lambda c: aggregates.agg_tat(c, *PERIOD, list(aggregates.DRILL_DOWN)),
    "agg_tat_by_geo_industry":
        lambda c: aggregates.agg_tat(c, *PERIOD, ["geo", "industry"]),
    "agg_tat_drilldown": lambda c: aggregates.agg_tat_drilldown(c, *PERIOD),
    "agg_gen": lambda c: aggregates.agg_gen(c, *PERIOD),
    "agg_gen_by_analyst_igo":
        lambda c: aggregates.agg_gen(c, *PERIOD, ["claims_analyst", "igo_nigo"]),
    "agg_gen_by_all_columns": lambda c: aggregates.agg_gen(c, *PERIOD, PERMITTED_COLUMNS),
    "claims_agg_base": aggregates.claims_agg_base,
}
# These also read geo or industry.
READS_CUSTOMER = {"agg_gen_by_all_columns", "agg_tat_by_geo_industry", "claims_agg_base",
                  "inv_agg_by_geo"}


def _over_claims(key: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        claims = derived.claims_with_durations(spark, sf_dir, dims=key in READS_CUSTOMER)
        return CLAIMS_QUERIES[key](claims)
    return run


# ---- parameters and ingest --------------------------------------------------------------


def _from_csv(params: DataFrame, schema: StructType) -> DataFrame:
    """Parameters written as a CSV file and read back."""
    path = shared_path(params.sparkSession, "parameters")
    params.write.csv(path, header=True)
    return read_parameters(params.sparkSession, path, schema)


def param_analyst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each analyst's parameter with the number of claims it applies to."""
    claims = derived.raw_claims(spark, sf_dir, dims=False)
    used = claims.groupBy("claims_analyst").agg(F.count("*").alias("__claims"))
    params = _from_csv(analyst_parameters(spark), ANALYST_PARAMS)
    joined = params.join(used, F.col("analyst") == F.col("claims_analyst"), "left")
    return joined.select(*params.columns, F.coalesce("__claims", F.lit(0)).alias("claims"))


def param_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each diagnosis's parameters with its number of claims and of approved claims."""
    claims = derived.raw_claims(spark, sf_dir, dims=False)
    used = claims.groupBy("diagnosis").agg(
        F.count("*").alias("__claims"),
        F.count_if(F.col("decision") == "Approved").alias("__approved"))
    params = _from_csv(diagnosis_parameters(spark), DIAGNOSIS_PARAMS)
    return params.join(used, "diagnosis", "left").select(
        *params.columns,
        F.coalesce("__claims", F.lit(0)).alias("claims"),
        F.coalesce("__approved", F.lit(0)).alias("approved_claims"))


def ingest_claims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a claims export as CSV, read it back and clean it."""
    path = shared_path(spark, "claims_export")
    write_export(derived.raw_claims(spark, sf_dir), path)
    return ingest_claims(read_claims_export(spark, path), CALENDAR)


def ingest_null_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_missing(derived.raw_claims(spark, sf_dir, dims=False))
    return filled.select(
        "claim_num", "nigo_following_up_hours", "deciding_1_hours", "deciding_2_hours",
        "nurse_reviewing_hours", "accurate_decision", "wrongly_approved", "wrongly_declined",
        "nigo_followed_up_mode", "dollar_cost_per_hour")


def dq_duplicate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim numbers that collide under a stride that is too short."""
    claims = derived.claims_replicated(spark, sf_dir, dims=False, key_stride=1000)
    return duplicate_keys(claims, "claim_num")


# Copies of claims share numbers where there are more claims than the stride of the copies, so
# a claim is known by its copy and its number.
COPY = "copy"
COPIED_CLAIMS = extended(CLAIMS_WITH_DURATIONS, [StructField(COPY, IntegerType())])
COPIED_KEY = (COPY, "claim_num")


def stage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace a stage table laid out by decision date, then read it in key order."""
    path = shared_path(spark, "claims_with_durations")
    write_stage(derived.claims_with_durations(spark, sf_dir, copy_column=COPY), path,
                COPIED_CLAIMS, key=COPIED_KEY, by_decided_month=True)
    stage = read_stage(spark, path, COPIED_CLAIMS, order_by="claim_num")
    return stage.select(*CLAIMS_WITH_DURATIONS.names)


BATCHES = 8  # one for each copy of a claim


def stage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage table from a first batch that replaces it and seven that are appended."""
    whole, path = shared_path(spark, "whole"), shared_path(spark, "appended")
    write_stage(derived.claims_with_durations(spark, sf_dir, copy_column=COPY), whole,
                COPIED_CLAIMS, by_column=COPY)
    claims = read_stage(spark, whole, COPIED_CLAIMS)
    for i in range(BATCHES):
        batch = claims.where(has_value(claims, COPY, i)).select(*COPIED_CLAIMS.names)
        if i == 0:
            write_stage(batch, path, COPIED_CLAIMS, key=COPIED_KEY, by_open_interval=True)
        else:
            append_stage(batch, path, COPIED_CLAIMS, key=COPIED_KEY)
    return read_stage(spark, path, COPIED_CLAIMS).select(*CLAIMS_WITH_DURATIONS.names)


HISTORY = ("2019-12-02", "2020-02-14", "2020-06-01")


def inventory_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of an early, a middle and a late day, from a table by open interval."""
    path = shared_path(spark, "by_open_interval")
    write_stage(derived.claims_with_durations(spark, sf_dir, dims=False)
                .withColumns({c: F.lit(None).cast("string") for c in ("geo", "industry")}),
                path, CLAIMS_WITH_DURATIONS, by_open_interval=True)
    claims = read_stage(spark, path, CLAIMS_WITH_DURATIONS)
    return reduce(DataFrame.unionByName, (
        inventory(claims, day).select(F.lit(day).cast("date").alias("as_of"), "stage", "count")
        for day in HISTORY))


# ---- calendar ---------------------------------------------------------------------------


def cal_date_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = derived.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_num"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.expr("int(o_orderkey % 40) - 20").alias("n"))
    n = F.col("n")
    return orders.select(
        "claim_num", "day",
        dates.cal_days_between(F.lit("1998-01-01").cast("date"), "day").alias("days_between"),
        dates.cal_days_offset("day", n + 0.5).alias("days_offset"),
        dates.months_before("day", n).alias("months_before"),
        dates.first_day_of_year("day").alias("year_start"),
        dates.first_day_of_month("day").alias("month_start"))


def _any_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business and other days, in both orders, from the milestones of the claims."""
    claims = derived.claims_raw_biz(spark, sf_dir, dims=False)
    return claims.select(
        "claim_num",
        F.expr("date_add(received_date, int(claim_num % 11))").alias("day"),
        F.expr("date_add(decided_2_date, int(claim_num % 13) - 15)").alias("other_day"),
        F.expr("int(claim_num % 41) - 20").alias("n"))


def bizday_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _any_days(spark, sf_dir).select(
        "claim_num", "day", CALENDAR.roll("day").alias("rolled"),
        CALENDAR.is_biz_day("day").cast("int").alias("is_biz_day"))


def bizday_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _any_days(spark, sf_dir).select(
        "claim_num", "day", "n", CALENDAR.offset("day", F.col("n")).alias("moved"))


def bizday_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _any_days(spark, sf_dir).select(
        "claim_num", "day", "other_day",
        CALENDAR.between("day", "other_day").alias("biz_days"))


def bizday_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = derived.claims_raw_biz(spark, sf_dir, dims=False)
    return claims.select("claim_num", *REPROJECTED_DATES)


# ---- claim operators --------------------------------------------------------------------


def stage_durations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = backdate_receipt(derived.claims_raw_biz(spark, sf_dir, dims=False), CALENDAR)
    return stage_durations(dated, CALENDAR).select("claim_num", "total_biz_days",
                                                   *STAGE_DURATIONS)


def claims_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(derived.claims_extended(spark, sf_dir), CLAIMS_EXTENDED)


def claims_replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(derived.claims_replicated(spark, sf_dir), CLAIMS_EXTENDED)


def claims_with_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(derived.claims_with_durations(spark, sf_dir), CLAIMS_WITH_DURATIONS)


def analyst_compliance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = derived.claims_replicated(spark, sf_dir, dims=False)
    return analyst_compliance(claims, analyst_parameters(spark)).select(
        "claim_num", "claims_analyst", "analyst_duration_touch_compliance")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one copy with their pay-out plan."""
    return with_plan(derived.claims_extended(spark, sf_dir, dims=False),
                     analyst_parameters(spark), diagnosis_parameters(spark))


def payout_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payout_dates(_planned(spark, sf_dir), CALENDAR).select(
        "claim_num", "decision", "recommended_dur_touch_count", "min_duration_days",
        "actual_duration_days", "payout_start_date", "return_to_work_date")


def expected_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select(
        "claim_num", "diagnosis", "actual_dur_touch_count",
        F.col("__plan_duration")[F.col("__plan_made")].alias("expected_duration_days"))


def touch_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select(
        "claim_num", "diagnosis", "touch_draw", "actual_dur_touch_count")


def touch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payout_dates(_planned(spark, sf_dir), CALENDAR).select(
        "claim_num", *(f"dur_touch_{i}_target_date" for i in TOUCHES))


def touch_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payout_dates(_planned(spark, sf_dir), CALENDAR).select(
        "claim_num", *(f"dur_touch_{i}_actual_date" for i in TOUCHES))


def touch_attainment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select(
        "claim_num", "recommended_dur_touch_count", "actual_dur_touch_count",
        "dur_touch_actual_v_rec_percentage")


# ---- cube and sources -------------------------------------------------------------------


def _over_cube(key: str) -> Query:
    """A query over claims, answered by a stored cube, which grew by a batch."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_path(spark, "cube")
        claims = derived.claims_with_durations(spark, sf_dir)
        first = F.col("claim_num") < derived.KEY_STRIDE
        write_cube(claims.where(first), path)
        add_to_cube(claims.where(~first), path)
        return CLAIMS_QUERIES[key](read_cube(spark, path))
    return run


KNOWN_ON = "2019-11-25"


def claims_known_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_on(derived.source_records(spark, sf_dir), KNOWN_ON)


CUBE_QUERIES = {
    "cube_agg_tat_by_geo_industry": "agg_tat_by_geo_industry",
    "cube_agg_gen_by_analyst_igo": "agg_gen_by_analyst_igo",
    "cube_agg_tat_drilldown": "agg_tat_drilldown",
    "cube_agg_base": "claims_agg_base",
}


# ---- exports ----------------------------------------------------------------------------


def _inventory_by_analyst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_claims("inv_agg_by_analyst")(spark, sf_dir)


def export_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a result as CSV and read the files back."""
    result = _inventory_by_analyst(spark, sf_dir)
    root = f"inv_agg_for__claims_analyst__as_of__{INVENTORY_DAY}"
    path = export_csv(result, shared_path(spark, "exports"), root)
    return spark.read.csv(path, header=True, schema=result.schema)


def export_json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a result as JSON, a row a line, and read the lines back."""
    root = f"inv_agg_for__claims_analyst__as_of__{INVENTORY_DAY}"
    path = export_json(_inventory_by_analyst(spark, sf_dir), shared_path(spark, "exports"), root)
    return spark.read.text(path).withColumnRenamed("value", "json")


QUERIES: dict[str, Query] = {
    "param_analyst": param_analyst,
    "param_diagnosis": param_diagnosis,
    "ingest_claims_raw": ingest_claims_raw,
    "ingest_null_fill": ingest_null_fill,
    "dq_duplicate_claims": dq_duplicate_claims,
    "stage_roundtrip": stage_roundtrip,
    "stage_append": stage_append,
    "inventory_history": inventory_history,
    "cal_date_math": cal_date_math,
    "bizday_roll": bizday_roll,
    "bizday_offset": bizday_offset,
    "bizday_between": bizday_between,
    "bizday_reproject": bizday_reproject,
    "stage_durations": stage_durations_query,
    "claims_extended": claims_extended,
    "claims_replicated": claims_replicated,
    "claims_with_durations": claims_with_durations,
    "analyst_compliance": analyst_compliance_query,
    "payout_schedule": payout_schedule,
    "expected_duration": expected_duration,
    "touch_band": touch_band,
    "touch_targets": touch_targets,
    "touch_alignment": touch_alignment,
    "touch_attainment": touch_attainment,
    **{key: _over_claims(key) for key in CLAIMS_QUERIES},
    "claims_known_on": claims_known_on,
    **{key: _over_cube(query) for key, query in CUBE_QUERIES.items()},
    "export_csv": export_csv_query,
    "export_json": export_json_query,
}
