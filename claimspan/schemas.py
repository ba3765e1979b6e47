"""Declared schema of every stage table. Each stage extends the one before it."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

_TYPES: dict[str, DataType] = {
    "long": LongType(), "int": IntegerType(), "double": DoubleType(),
    "string": StringType(), "date": DateType(),
}


def _fields(type_name: str, *names: str) -> list[StructField]:
    return [StructField(name, _TYPES[type_name]) for name in names]


def extended(parent: StructType, *added: list[StructField]) -> StructType:
    """The parent's columns followed by the added ones."""
    return StructType(parent.fields + [f for group in added for f in group])


_CUSTOMER = (
    _fields("long", "claim_num", "customer_num")
    + _fields("int", "salary_per_month")
    + _fields("string", "employee_level", "geo", "industry", "diagnosis")
)
_HANDLING = _fields("string", "claims_analyst", "igo_nigo", "nigo_followed_up_mode",
                    "is_nurse_review_required")
_HOURS = _fields("double", "nigo_following_up_hours", "deciding_1_hours",
                 "nurse_reviewing_hours", "deciding_2_hours")
_LATER_DATES = _fields("date", "nigo_followed_up_date", "all_info_received_date",
                       "decided_1_date", "nurse_reviewed_date", "decided_2_date")
_OUTCOME = (
    _fields("string", "decision", "accuracy_of_decision")
    + _fields("int", "accurate_decision", "wrongly_approved", "wrongly_declined")
    + _fields("double", "dollar_cost_per_hour")
)

CLAIMS_RAW_BIZ = StructType(
    _CUSTOMER + _HANDLING + _HOURS + _fields("date", "received_date") + _LATER_DATES + _OUTCOME
)

STAGE_DURATIONS = (
    "received_to_intake_decided_biz_days",
    "intake_decided_to_nigo_followed_up_biz_days",
    "nigo_followed_up_to_all_info_received_biz_days",
    "all_info_received_to_decided_1_biz_days",
    "decided_1_to_nurse_reviewed_biz_days",
    "nurse_reviewed_to_decided_2_biz_days",
)

CLAIMS_EXTENDED = StructType(
    _CUSTOMER
    + _fields("string", "intake_analyst") + _HANDLING
    + _fields("double", "intake_deciding_hours") + _HOURS
    + _fields("date", "received_date", "intake_decided_date") + _LATER_DATES
    + _OUTCOME
    + _fields("double", "total_claims_analyst_hours", "total_hours")
    + _fields("int", "total_biz_days", "over_five_biz_days", "over_ten_biz_days",
              *STAGE_DURATIONS)
)

TOUCHES = range(1, 6)

CLAIMS_WITH_DURATIONS = extended(
    CLAIMS_EXTENDED,
    _fields("double", "analyst_duration_touch_compliance", "recommended_dur_touch_count",
            "actual_dur_touch_count", "dur_touch_actual_v_rec_percentage"),
    _fields("date", "payout_start_date", "return_to_work_date"),
    _fields("double", "min_duration_days", "actual_duration_days"),
    _fields("date", *(f"dur_touch_{i}_target_date" for i in TOUCHES)),
    _fields("date", *(f"dur_touch_{i}_actual_date" for i in TOUCHES)),
)

ANALYST_PARAMS = StructType(
    _fields("string", "analyst") + _fields("double", "duration_touch_compliance")
)

DIAGNOSIS_PARAMS = StructType(
    _fields("string", "diagnosis")
    + _fields("int", "min_duration_days", "max_duration_days", "rec_touch_number",
              *(f"percent_{n}_touches" for n in range(5, -1, -1)),
              *(f"touch_{i}_target_day" for i in TOUCHES))
)
