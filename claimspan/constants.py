"""Fixed values. Results depend on them, so they are written out, not derived."""

# US federal holidays from 2019 to 2021. Pinned, because libraries
# that generate such lists have since added days.
US_HOLIDAYS = (
    "2019-01-01", "2019-01-21", "2019-02-18", "2019-05-27", "2019-07-04",
    "2019-09-02", "2019-10-14", "2019-11-11", "2019-11-28", "2019-12-25",
    "2020-01-01", "2020-01-20", "2020-02-17", "2020-05-25", "2020-07-03",
    "2020-09-07", "2020-10-12", "2020-11-11", "2020-11-26", "2020-12-25",
    "2021-01-01", "2021-01-18", "2021-02-15", "2021-05-31", "2021-07-05",
    "2021-09-06", "2021-10-11", "2021-11-11", "2021-11-25", "2021-12-24",
    "2021-12-31",
)

# Fixed value: business days are counted from this date when raw dates are re-projected.
ANCHOR_DATE = "2019-11-01"

# Ordered text replacements applied to lower-cased column names.
NAME_REPLACEMENTS = (
    (" ", "_"),
    ("#", "num"),
    ("/", "__"),
    (">", "gt"),
    ("-", "_"),
    ("_$", "dollar"),
    ("$", "dollar"),
    ("srevice_", "service"),
)

# Cleaned source name to the name used from then on.
CANONICAL_NAMES = {
    "date_received": "received_date",
    "claims_analysts": "claims_analyst",
    "igo,_nigo": "igo_nigo",
    "follow_up": "nigo_following_up_hours",
    "preliminary_analysis_for_decision_plus_nurse__no_nurse": "deciding_1_hours",
    "nurse_review": "nurse_reviewing_hours",
    "reconsidered_decision_only_for_nurse_review_cases": "deciding_2_hours",
    "nurse_review_hours": "nurse_reviewing_hours",
    "mode_of_follow_up": "nigo_followed_up_mode",
    "date_follow_up_made": "nigo_followed_up_date",
    "date_all_information_received": "all_info_received_date",
    "date_of_decision__ask_for_nurse_review": "decided_1_date",
    "date_nurse_decision_made": "nurse_reviewed_date",
    "date_of_decision_after_nurse_review": "decided_2_date",
}

# Source columns that are dropped because the build computes them itself.
RECOMPUTED_COLUMNS = (
    "unnamed:_8",
    "total",
    "num_of_days_to_follow_up",
    "num_of_days_to_receive_information",
    "num_of_days_to_make__make_decision___ask_for_nurse_review",
    "num_of_days_for_nurse_to_make_the_decision",
    "num_of_days_to_take_decision_after_nurse_review",
    "total_num_of_days_to_make_the_decision_from_date_of_receipt",
    "tat_gt_7_days",
    "tat_gt_14_days",
    "inventory__waiting_to_be_followed_up",
    "inventory___waiting_for_information_from_client",
    "inventory___waiting_for_decision__ask_for_nurse_review",
    "inventory___waiting_for_decision_after_nurse_review",
    "claims_processed",
    "dollar_cost_per_claim",
    "claims_to_be_processed",
    "penalty_for_claims_with_tat_gt_7_days",
    "penalty_for_claims_with_tat_gt_14_days",
    "penalty_for_claims_with_wrongly_declined",
    "loss_ratio",
    "impact_on_customer_service_for_claims_with_tat_gt_7_days",
    "impact_on_customer_service__for_claims_with_tat_gt_14_days",
    "impact_on_customer_service__for_claims_with_wrongly_declined",
)

# What a missing cell stands for. Nurse hours stay null on purpose.
NULL_FILLS = {
    "nigo_following_up_hours": 0.0,
    "deciding_1_hours": 0.0,
    "deciding_2_hours": 0.0,
    "accurate_decision": 0,
    "wrongly_approved": 0,
    "wrongly_declined": 0,
    "nigo_followed_up_mode": "N/A",
}

# The one spelling of a dollar cost that is not a plain number.
COST_SPELLINGS = {" $42 ": "42"}

# Raw dates that are re-projected onto business days.
REPROJECTED_DATES = (
    "received_date",
    "nigo_followed_up_date",
    "all_info_received_date",
    "decided_1_date",
    "nurse_reviewed_date",
    "decided_2_date",
)

# The seven milestones in processing order.
MILESTONES = (
    "received_date",
    "intake_decided_date",
    "nigo_followed_up_date",
    "all_info_received_date",
    "decided_1_date",
    "nurse_reviewed_date",
    "decided_2_date",
)

# Columns a caller may group by.
PERMITTED_COLUMNS = (
    "diagnosis",
    "industry",
    "geo",
    "claims_analyst",
    "igo_nigo",
    "is_nurse_review_required",
    "accuracy_of_decision",
)

# The query dates that the demonstration data covers.
DEMO_QUERY_DATES = ("2019-11-15", "2020-03-01")
DEMO_TODAY_DATES = ("2020-01-01", "2020-04-24")
DEFAULT_TODAY = "2020-04-10"

# Above these a parameter is accepted with a warning.
ADVISORY_BOUNDS = {
    "months_before": 6,
    "biz_days_before": 180,
    "biz_days_count": 60,
    "percent": 100,
}

# How closely each analyst keeps to the recommended touches.
ANALYST_PARAMETERS = (
    ("Matt Johnson", 1.5),
    ("Cary Smith", 1.4),
    ("Charlton Williams", 1.3),
    ("Stiller Davis", 1.2),
    ("Luke Moore", 1.1),
    ("Henry Jones", 1.0),
    ("Robert Hall", 0.9),
    ("Paul King", 0.8),
    ("Thomas Brown", 0.7),
    ("Johnny Miller", 0.6),
)

# Fixed values, one row per diagnosis: min and max duration, recommended touches,
# percent with 5, 4, 3, 2, 1, 0 touches, target day of touches 1 to 5.
DIAGNOSIS_PARAMETERS = (
    ("Maternity", 42, 50, 2, 0, 0, 0, 65, 15, 20, 10, 25, None, None, None),
    ("Back Disorders", 28, 42, 2, 0, 0, 0, 65, 15, 20, 7, 15, None, None, None),
    ("Digestive", 14, 14, 0, 0, 0, 0, 0, 0, 100, None, None, None, None, None),
    ("Injuries", 56, 84, 4, 0, 55, 12, 12, 6, 15, 10, 20, 30, 40, None),
    ("Joint Disorders", 70, 105, 5, 55, 10, 10, 5, 5, 15, 10, 20, 30, 40, 55),
    ("Nervous", 70, 105, 5, 55, 10, 10, 5, 5, 15, 5, 12, 22, 35, 50),
)
