"""Claims derived from the given tables, one per order; formulas as in FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspan.constants import ANALYST_PARAMETERS, ANCHOR_DATE, DIAGNOSIS_PARAMETERS
from claimspan.functions.bizcal import BusinessCalendar
from claimspan.operators.cleaning import fill_missing, reproject_dates
from claimspan.operators.decisioning import extend_claims
from claimspan.operators.replication import replicate_claims
from claimspan.plans.build import build_claims
from claimspan.schemas import TOUCHES
from claimspan.sources.csv_inputs import analyst_parameters, diagnosis_parameters

CALENDAR = BusinessCalendar()
KEY_STRIDE = 1_000_000

# Days between milestones; each date follows the one before it.
_STEPS = {
    "received_date": "k % 15",
    "nigo_followed_up_date": "if(nigo, 1 + k % 3, 0)",
    "all_info_received_date": "if(nigo, 2 + (k div 7) % 9, 0)",
    "decided_1_date": "1 + (k div 2) % 5",
    "nurse_reviewed_date": "if(nurse, 1 + (k div 13) % 4, 0)",
    "decided_2_date": "if(nurse, 1 + (k div 17) % 2, 0)",
}
# Cells are left empty where a claims export would leave them empty.
_RAW_COLUMNS = {
    "claim_num": "k",
    "customer_num": "o_custkey",
    "salary_per_month": "int(3000 + (k * 37) % 5000)",
    "employee_level": "concat('L', 1 + k % 5)",
    "igo_nigo": "if(nigo, 'NIGO', 'IGO')",
    "nigo_followed_up_mode": "if(nigo, if((k div 3) % 2 = 0, 'Call', 'Email'), null)",
    "is_nurse_review_required": "if(nurse, 'Yes', 'No')",
    "nigo_following_up_hours": "if(nigo, 0.25D * ((k div 3) % 8), null)",
    "deciding_1_hours": "0.25D * (2 + (k div 4) % 10)",
    "nurse_reviewing_hours": "if(k % 97 = 0, null, if(nurse, 0.25D * (1 + (k div 6) % 6), 0D))",
    "deciding_2_hours": "if(nurse, 0.25D * (1 + k % 4), null)",
    "decision": "if(approved, 'Approved', 'Declined')",
    "accuracy_of_decision":
        "if(k % 20 != 0, 'Accurate', if(approved, 'Wrongly approved', 'Wrongly declined'))",
    "accurate_decision": "if(k % 20 != 0, 1, null)",
    "wrongly_approved": "if(k % 20 = 0 and approved, 1, null)",
    "wrongly_declined": "if(k % 20 = 0 and not approved, 1, null)",
    "dollar_cost_per_hour": "' $42 '",
}
# What the reference draws at random comes from the key instead.
_INPUT_COLUMNS = {
    "intake_analyst": "concat('Intake ', k % 6)",
    "intake_deciding_hours": "0.25D * (1 + k % 3)",
    "intake_biz_days": "int((k div 19) % 6)",
    "touch_draw": "((k * 7919) % 10000) / 10000D",
    "duration_noise_days": "int((k div 23) % 5 - 2)",
} | {f"touch_lag_{j}": f"int(((k div 29) + {j}) % 5)" for j in TOUCHES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry and geo of each customer, null if unknown; small tables are joined first."""
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"),
              "left")
        .select("c_custkey", F.col("c_mktsegment").alias("industry"),
                F.col("r_name").alias("geo"))
    )


def _pick(names: list[str], index: str) -> str:
    quoted = ", ".join(f"'{name}'" for name in names)
    return f"element_at(array({quoted}), int({index}) + 1)"


def raw_claims(spark: SparkSession, sf_dir: str, dims: bool = True) -> DataFrame:
    """Raw claims before cleaning, with clean names. Without dims the customer join,
    the one shuffle there is, is left out for queries that need neither of its columns.
    Every order is a claim, with or without a known customer."""
    orders = table(spark, sf_dir, "orders")
    if dims:
        customers = customer_dims(spark, sf_dir)
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    named = {
        "claims_analyst": _pick([a for a, _ in ANALYST_PARAMETERS], "(k * 7 + k div 11) % 10"),
        "diagnosis": _pick([d[0] for d in DIAGNOSIS_PARAMETERS], "(k div 4) % 6"),
    }
    dated, day = {}, f"date '{ANCHOR_DATE}'"
    for milestone, step in _STEPS.items():
        dated[milestone] = day = f"date_add({day}, int({step}))"
    columns = dated | named | _RAW_COLUMNS | _INPUT_COLUMNS
    kept = ["geo", "industry"] if dims else []
    return orders.selectExpr(
        "o_custkey", "o_orderkey as k", "o_orderstatus = 'F' as nigo",
        "o_orderpriority in ('1-URGENT', '2-HIGH') as nurse",
        "(o_orderkey div 5) % 10 < 7 as approved", *kept,
    ).selectExpr(*kept, *(f"{formula} as {name}" for name, formula in columns.items()))


def claims_raw_biz(spark: SparkSession, sf_dir: str, dims: bool = True) -> DataFrame:
    return reproject_dates(fill_missing(raw_claims(spark, sf_dir, dims)), CALENDAR)


# Records of three systems: (recorded on, days until arrival, further columns, condition).
_RECORDS = {
    "intake": [
        ("received_date", "k % 4", {"reported": "diagnosis", "complete": "igo_nigo"}, "true"),
        ("date_add(received_date, 2)", "1 + k % 9",
         {"reported": "concat(diagnosis, ', corrected')", "complete": "igo_nigo"}, "k % 6 = 0")],
    "handling": [
        ("nigo_followed_up_date", "k % 7",
         {"status": "'asked'", "mode": "nigo_followed_up_mode"}, "igo_nigo = 'NIGO'"),
        ("all_info_received_date", "k % 3",
         {"status": "'answered'", "mode": "nigo_followed_up_mode"}, "igo_nigo = 'NIGO'")],
    "decisions": [
        ("decided_1_date", "(k div 3) % 5",
         {"phase": "'first'", "verdict": "decision"}, "true"),
        ("decided_2_date", "(k div 5) % 6", {"phase": "'final'", "verdict": "decision"},
         "is_nurse_review_required = 'Yes'")],
}


def source_records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Records of claims from three systems, some of which arrive after later ones."""
    claims = claims_raw_biz(spark, sf_dir, dims=False).withColumn("k", F.col("claim_num"))

    def records(recorded: str, days: str, columns: dict[str, str], where: str) -> DataFrame:
        return claims.where(where).selectExpr(
            "claim_num", f"{recorded} as recorded_on",
            f"date_add({recorded}, int({days})) as arrived_on",
            *(f"{formula} as {name}" for name, formula in columns.items()))

    return {name: records(*first).unionByName(records(*second))
            for name, (first, second) in _RECORDS.items()}


def claims_extended(spark: SparkSession, sf_dir: str, dims: bool = True) -> DataFrame:
    return extend_claims(claims_raw_biz(spark, sf_dir, dims), CALENDAR)


def claims_replicated(spark: SparkSession, sf_dir: str, dims: bool = True,
                      key_stride: int = KEY_STRIDE) -> DataFrame:
    return replicate_claims(claims_extended(spark, sf_dir, dims), CALENDAR,
                            key_stride=key_stride)


def claims_with_durations(spark: SparkSession, sf_dir: str, dims: bool = True,
                          copy_column: str | None = None) -> DataFrame:
    return build_claims(claims_raw_biz(spark, sf_dir, dims), analyst_parameters(spark),
                        diagnosis_parameters(spark), CALENDAR, key_stride=KEY_STRIDE,
                        copy_column=copy_column)
