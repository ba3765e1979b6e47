"""A raw claims export as a spreadsheet would write it, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header of each column that is kept, and of each that the build computes itself.
KEPT_HEADERS = {
    "claim_num": "Claim #",
    "customer_num": "Customer #",
    "salary_per_month": "Salary per month",
    "employee_level": "Employee Level",
    "geo": "Geo",
    "industry": "Industry",
    "diagnosis": "Diagnosis",
    "claims_analyst": "Claims Analysts",
    "igo_nigo": "IGO, NIGO",
    "nigo_following_up_hours": "Follow-up",
    "deciding_1_hours": "Preliminary analysis for decision plus nurse/no nurse",
    "nurse_reviewing_hours": "Nurse Review_Hours",
    "deciding_2_hours": "Reconsidered decision only for nurse review cases'",
    "nigo_followed_up_mode": "Mode of follow-up",
    "is_nurse_review_required": " Is Nurse Review Required",
    "received_date": "Date Received",
    "nigo_followed_up_date": "Date follow-up made",
    "all_info_received_date": "Date all information received",
    "decided_1_date": "Date of decision/ask for nurse review",
    "nurse_reviewed_date": "Date nurse decision made",
    "decided_2_date": "Date of decision after nurse review___",
    "decision": "Decision",
    "accuracy_of_decision": "Accuracy of Decision",
    "accurate_decision": "Accurate Decision",
    "wrongly_approved": "Wrongly Approved",
    "wrongly_declined": "Wrongly Declined",
    "dollar_cost_per_hour": "$ Cost per hour",
}
RECOMPUTED_HEADERS = (
    "Unnamed: 8",
    "Total",
    "Num of days to follow-up",
    "Num of days to receive information",
    "Num of days to make/make decision - ask for nurse review",
    "Num of days for nurse to make the decision",
    "Num of days to take decision after nurse review",
    "Total num of days to make the decision from date of receipt",
    "TAT > 7 days",
    "TAT > 14 days",
    "Inventory/waiting to be followed up",
    "Inventory - waiting for information from client",
    "Inventory - waiting for decision/ask for nurse review",
    "Inventory - waiting for decision after nurse review",
    "Claims processed",
    "$ Cost per claim",
    "Claims to be processed",
    "Penalty for claims with TAT > 7 days",
    "Penalty for claims with TAT > 14 days",
    "Penalty for claims with wrongly declined",
    "Loss Ratio",
    "Impact on customer srevice  for claims with TAT > 7 days",
    "Impact on customer srevice - for claims with TAT > 14 days",
    "Impact on customer service/for claims with wrongly declined",
)


def as_export(raw: DataFrame) -> DataFrame:
    """Raw claims under the headers of an export, with the columns that get dropped."""
    kept = [F.col(name).alias(header) for name, header in KEPT_HEADERS.items()]
    extra = [(F.col("claim_num") % 7).alias(header) for header in RECOMPUTED_HEADERS]
    return raw.select(*kept, *extra)


def write_export(raw: DataFrame, path: str) -> None:
    as_export(raw).write.csv(path, header=True, ignoreLeadingWhiteSpace=False,
                             ignoreTrailingWhiteSpace=False)
