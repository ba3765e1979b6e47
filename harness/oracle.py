"""The registered queries as SQL over the given tables, for DuckDB.

Written independently of the Spark side: milestones come straight from the formulas in
FIXTURES.md as business-day numbers, stages are counted one branch at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from claimspan.constants import (
    ANALYST_PARAMETERS, DIAGNOSIS_PARAMETERS, MILESTONES, REPROJECTED_DATES, US_HOLIDAYS,
)
from claimspan.schemas import (
    ANALYST_PARAMS, CLAIMS_EXTENDED, CLAIMS_RAW_BIZ, CLAIMS_WITH_DURATIONS, DIAGNOSIS_PARAMS,
    STAGE_DURATIONS,
)

STRIDE = 1_000_000
CALENDAR_START = "DATE '2019-01-01'"


def _values(rows: Sequence[tuple]) -> str:
    def literal(cell: object) -> str:
        if cell is None:
            return "CAST(NULL AS INTEGER)"
        return f"'{cell}'" if isinstance(cell, str) else repr(cell)
    return "VALUES " + ", ".join(f"({', '.join(map(literal, row))})" for row in rows)


def _ord(day: str) -> str:
    """Business days before a date."""
    return f"arr.ords[CAST({day} AS DATE) - {CALENDAR_START} + 1]"


def _bday(ordinal: str) -> str:
    return f"arr.bdays[{ordinal} + 1]"


CALENDAR = f"""
holidays(h) AS (VALUES {', '.join(f"(DATE '{h}')" for h in US_HOLIDAYS)}),
days AS (
  SELECT CAST(t.d AS DATE) AS d,
         CASE WHEN isodow(t.d) < 6 AND CAST(t.d AS DATE) NOT IN (SELECT h FROM holidays)
              THEN 1 ELSE 0 END AS biz
  FROM generate_series(TIMESTAMP '2019-01-01', TIMESTAMP '2023-01-01', INTERVAL 1 DAY) AS t(d)),
numbered AS (
  SELECT d, biz, CAST(COALESCE(SUM(biz) OVER (
           ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS o
  FROM days),
arr AS (
  SELECT (SELECT list(o ORDER BY d) FROM numbered) AS ords,
         (SELECT list(d ORDER BY d) FROM numbered WHERE biz = 1) AS bdays,
         (SELECT o FROM numbered WHERE d = DATE '2019-11-01') AS base)"""

ANALYSTS = f"pa({', '.join(ANALYST_PARAMS.names)}) AS ({_values(ANALYST_PARAMETERS)})"
DIAGNOSES = f"pd({', '.join(DIAGNOSIS_PARAMS.names)}) AS ({_values(DIAGNOSIS_PARAMETERS)})"

_ANALYST_NAMES = "[" + ", ".join(f"'{a}'" for a, _ in ANALYST_PARAMETERS) + "]"
_DIAGNOSIS_NAMES = "[" + ", ".join(f"'{d[0]}'" for d in DIAGNOSIS_PARAMETERS) + "]"

SEED = f"""
source AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus = 'F' AS nigo,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS nurse,
         (o_orderkey // 5) % 10 < 7 AS approved, c_mktsegment AS industry, r_name AS geo
  FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey),
seed AS (
  SELECT *,
    k % 15 AS x0,
    CASE WHEN nigo THEN 1 + k % 3 ELSE 0 END AS x1,
    CASE WHEN nigo THEN 2 + (k // 7) % 9 ELSE 0 END AS x2,
    1 + (k // 2) % 5 AS x3,
    CASE WHEN nurse THEN 1 + (k // 13) % 4 ELSE 0 END AS x4,
    CASE WHEN nurse THEN 1 + (k // 17) % 2 ELSE 0 END AS x5,
    (k // 19) % 6 AS xi,
    CAST(3000 + (k * 37) % 5000 AS INTEGER) AS salary_per_month,
    'L' || (1 + k % 5) AS employee_level,
    CASE WHEN nigo THEN 'NIGO' ELSE 'IGO' END AS igo_nigo,
    CASE WHEN NOT nigo THEN 'N/A' WHEN (k // 3) % 2 = 0 THEN 'Call' ELSE 'Email' END
      AS nigo_followed_up_mode,
    CASE WHEN nurse THEN 'Yes' ELSE 'No' END AS is_nurse_review_required,
    CASE WHEN approved THEN 'Approved' ELSE 'Declined' END AS decision,
    {_ANALYST_NAMES}[(k * 7 + k // 11) % 10 + 1] AS claims_analyst,
    {_DIAGNOSIS_NAMES}[(k // 4) % 6 + 1] AS diagnosis,
    CASE WHEN k % 20 <> 0 THEN 'Accurate' WHEN approved THEN 'Wrongly approved'
         ELSE 'Wrongly declined' END AS accuracy_of_decision,
    CASE WHEN k % 20 <> 0 THEN 1 ELSE 0 END AS accurate_decision,
    CASE WHEN k % 20 = 0 AND approved THEN 1 ELSE 0 END AS wrongly_approved,
    CASE WHEN k % 20 = 0 AND NOT approved THEN 1 ELSE 0 END AS wrongly_declined,
    'Intake ' || (k % 6) AS intake_analyst,
    CAST(1 + k % 3 AS DOUBLE) / 4 AS intake_deciding_hours,
    CASE WHEN nigo THEN CAST((k // 3) % 8 AS DOUBLE) / 4 ELSE 0 END AS nigo_following_up_hours,
    CAST(2 + (k // 4) % 10 AS DOUBLE) / 4 AS deciding_1_hours,
    CASE WHEN k % 97 = 0 THEN NULL WHEN nurse THEN CAST(1 + (k // 6) % 6 AS DOUBLE) / 4
         ELSE 0 END AS nurse_reviewing_hours,
    CASE WHEN nurse THEN CAST(1 + k % 4 AS DOUBLE) / 4 ELSE 0 END AS deciding_2_hours,
    CAST(42 AS DOUBLE) AS dollar_cost_per_hour,
    CAST((k * 7919) % 10000 AS DOUBLE) / 10000 AS touch_draw,
    CAST((k // 23) % 5 - 2 AS INTEGER) AS duration_noise_days
  FROM source)"""

# Milestone as business days after 2019-11-01, before the shift of a copy.
_MILESTONE = {
    "received_date": "x0 - xi",
    "intake_decided_date": "x0",
    "nigo_followed_up_date": "x0 + x1",
    "all_info_received_date": "x0 + x1 + x2",
    "decided_1_date": "x0 + x1 + x2 + x3",
    "nurse_reviewed_date": "x0 + x1 + x2 + x3 + x4",
    "decided_2_date": "x0 + x1 + x2 + x3 + x4 + x5",
}


def _dated(copies: int, stride: int) -> str:
    days = ",\n".join(f"    {_bday(f'base + {n} + 15 * i')} AS {day}"
                      for day, n in _MILESTONE.items())
    return f"""
dated AS (
  SELECT seed.*, i, k + i * {stride} AS claim_num, o_custkey + i * {stride} AS customer_num,
{days}
  FROM seed, arr, range({copies + 1}) AS copy(i))"""


def _between(first: str, second: str) -> str:
    return f"CAST({_ord(second)} - {_ord(first)} AS INTEGER)"


_DURATIONS = ",\n".join(
    f"    {_between(first, second)} AS {name}"
    for name, first, second in zip(STAGE_DURATIONS, MILESTONES, MILESTONES[1:]))
EXTENDED = f"""
timed AS (
  SELECT dated.*, {_between(MILESTONES[0], MILESTONES[-1])} AS total_biz_days,
{_DURATIONS}
  FROM dated, arr),
extended AS (
  SELECT *,
    nigo_following_up_hours + deciding_1_hours + deciding_2_hours AS total_claims_analyst_hours,
    intake_deciding_hours + nigo_following_up_hours + deciding_1_hours + nurse_reviewing_hours
      + deciding_2_hours AS total_hours,
    CASE WHEN total_biz_days <= 5 THEN 0 ELSE 1 END AS over_five_biz_days,
    CASE WHEN total_biz_days <= 10 THEN 0 ELSE 1 END AS over_ten_biz_days
  FROM timed)"""


def _touch_aligned(i: int) -> str:
    return (f"CASE WHEN act >= {i} THEN CASE WHEN act = 1 THEN greatest(1, rec // 2) "
            f"WHEN act = rec THEN {i} ELSE {i if i == 1 else i + 1} END END")


def _targets(i: int) -> str:
    return (_bday(_ord(f"(payout_start_date + touch_{i}_target_day)"))
            + f" AS dur_touch_{i}_target_date")


def _actual(i: int) -> str:
    targets = ", ".join(f"dur_touch_{j}_target_date" for j in range(1, 6))
    aligned = f"[{targets}][{_touch_aligned(i)}]"
    return (_bday(f"{_ord(aligned)} + CAST(((k // 29) + {i}) % 5 AS INTEGER)")
            + f" AS dur_touch_{i}_actual_date")


PAYOUT = f"""
matched AS (
  SELECT extended.*, CAST(duration_touch_compliance AS DOUBLE)
      AS analyst_duration_touch_compliance,
    pd.* EXCLUDE (diagnosis), pd.diagnosis AS pd_diagnosis,
    least(CAST(0.9999 AS DOUBLE), touch_draw * CAST(duration_touch_compliance AS DOUBLE)) * 100
      AS score
  FROM extended
  JOIN pa ON claims_analyst = analyst
  LEFT JOIN pd ON decision = 'Approved' AND pd.diagnosis = extended.diagnosis),
counted AS (
  SELECT *, rec_touch_number AS rec,
    CASE WHEN pd_diagnosis IS NULL THEN NULL
      WHEN score <= percent_0_touches THEN 0
      WHEN score <= percent_0_touches + percent_1_touches THEN 1
      WHEN score <= percent_0_touches + percent_1_touches + percent_2_touches THEN 2
      WHEN score <= percent_0_touches + percent_1_touches + percent_2_touches
                    + percent_3_touches THEN 3
      WHEN score <= percent_0_touches + percent_1_touches + percent_2_touches
                    + percent_3_touches + percent_4_touches THEN 4
      ELSE 5 END AS act
  FROM matched),
scheduled AS (
  SELECT counted.* EXCLUDE (min_duration_days), min_duration_days AS shortest,
    CASE WHEN rec = 0 THEN min_duration_days
      ELSE min_duration_days + (max_duration_days - min_duration_days)
           * (CAST(rec - act AS DOUBLE) / rec) END AS expected_duration_days,
    CASE WHEN decision = 'Approved' THEN {_bday(_ord('received_date') + ' + 5')} END
      AS payout_start_date
  FROM counted, arr),
targeted AS (
  SELECT scheduled.*, {', '.join(_targets(i) for i in range(1, 6))}
  FROM scheduled, arr),
claims AS MATERIALIZED (
  SELECT targeted.*,
    CAST(rec AS DOUBLE) AS recommended_dur_touch_count,
    CAST(act AS DOUBLE) AS actual_dur_touch_count,
    CAST(CASE WHEN rec = 0 THEN 100 ELSE round_even(100 * (CAST(act AS DOUBLE) / rec), 0) END
      AS DOUBLE) AS dur_touch_actual_v_rec_percentage,
    CAST(shortest AS DOUBLE) AS min_duration_days,
    CAST(expected_duration_days AS DOUBLE) + duration_noise_days AS actual_duration_days,
    payout_start_date + CAST(floor(expected_duration_days + duration_noise_days) AS INTEGER)
      AS return_to_work_date,
    {', '.join(_actual(i) for i in range(1, 6))}
  FROM targeted, arr)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _over_extended(select: str, copies: int = 0, stride: int = STRIDE) -> str:
    return _with(CALENDAR, SEED, _dated(copies, stride), EXTENDED) + select


def _over_claims(select: str, copies: int = 7) -> str:
    return _with(CALENDAR, ANALYSTS, DIAGNOSES, SEED, _dated(copies, STRIDE), EXTENDED,
                 PAYOUT) + select


def _columns(schema) -> str:
    return ", ".join(schema.names)


# ---- queries over the claims ------------------------------------------------------------

TODAY = "DATE '2020-04-10'"
DAY = "DATE '2020-01-15'"
_HISTORY = ("DATE '2019-12-02'", "DATE '2020-02-14'", "DATE '2020-06-01'")
DECIDED = "decided_2_date BETWEEN DATE '2020-02-03' AND DATE '2020-02-28'"


def _count(condition: str) -> str:
    return _over_claims(f"SELECT COUNT(*) AS count FROM claims WHERE {condition}")


def _stab(start: str, end: str) -> str:
    return f"({start} < {DAY} AND {DAY} <= {end})"


_STAGES = {
    "0_intake_deciding": _stab("received_date", "intake_decided_date"),
    "1_following_up":
        f"igo_nigo = 'NIGO' AND {_stab('intake_decided_date', 'nigo_followed_up_date')}",
    "2_waiting_call": "igo_nigo = 'NIGO' AND nigo_followed_up_mode = 'Call' AND "
                      + _stab("nigo_followed_up_date", "all_info_received_date"),
    "3_waiting_email": "igo_nigo = 'NIGO' AND nigo_followed_up_mode = 'Email' AND "
                       + _stab("nigo_followed_up_date", "all_info_received_date"),
    "4_deciding_1":
        f"(igo_nigo = 'IGO' AND {_stab('intake_decided_date', 'decided_1_date')}) OR "
        f"(igo_nigo = 'NIGO' AND {_stab('all_info_received_date', 'decided_1_date')})",
    "5_nurse_deciding":
        f"is_nurse_review_required = 'Yes' AND {_stab('decided_1_date', 'nurse_reviewed_date')}",
    "6_deciding_2":
        f"is_nurse_review_required = 'Yes' AND {_stab('nurse_reviewed_date', 'decided_2_date')}",
    "7_paying_out":
        f"decision = 'Approved' AND {DAY} < return_to_work_date AND "
        f"((is_nurse_review_required = 'No' AND decided_1_date < {DAY}) OR "
        f"(is_nurse_review_required = 'Yes' AND decided_2_date < {DAY}))",
    "8_total":
        f"(decision = 'Approved' AND received_date < {DAY} AND ({DAY} < return_to_work_date "
        f"OR {DAY} <= decided_1_date OR {DAY} <= decided_2_date)) OR "
        f"(decision = 'Declined' AND is_nurse_review_required = 'Yes' AND received_date < {DAY} "
        f"AND {DAY} <= decided_2_date) OR "
        f"(decision = 'Declined' AND is_nurse_review_required = 'No' AND received_date < {DAY} "
        f"AND {DAY} <= decided_1_date)",
}


def _inventory(*by: str) -> str:
    keys = "".join(f"{c}, " for c in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, {keys}COUNT(*) AS count FROM claims WHERE {where}{group}"
        for stage, where in _STAGES.items())


def _ratio(numerator: str, denominator: str) -> str:
    """Rounded half up to two places, in whole numbers."""
    return (f"CAST((200 * ({numerator}) + ({denominator})) // (2 * ({denominator})) AS DOUBLE)"
            " / 100")


def _mean(column: str) -> str:
    return _ratio(f"SUM({column})", f"COUNT({column})")


def _mean_hours(column: str) -> str:
    return _ratio(f"CAST(SUM({column} * 4) AS BIGINT)", f"4 * COUNT({column})")


def _tat(percent) -> str:
    return f"""COUNT(*) AS count_of_claims, {_mean('total_biz_days')} AS avg_tat,
  CAST(SUM(over_five_biz_days) AS BIGINT) AS count_tat_over_5_days,
  {percent('over_five_biz_days')} AS percent_tat_over_5_days,
  CAST(SUM(over_ten_biz_days) AS BIGINT) AS count_tat_over_10_days,
  {percent('over_ten_biz_days')} AS percent_tat_over_10_days"""


def _grouped(measures: str, by: Sequence[str], rows: str = f"claims WHERE {DECIDED}") -> str:
    keys = "".join(f"{c}, " for c in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT {keys}{measures} FROM {rows}{group}"


TAT = _tat(lambda flag: _ratio(f"100 * SUM({flag})", "COUNT(*)"))
_NIGO = "COUNT(*) FILTER (WHERE igo_nigo = 'NIGO')"
_WAITING = "SUM(nigo_followed_up_to_all_info_received_biz_days)"
GEN = f"""{_tat(lambda flag: f"CAST((100 * SUM({flag})) // COUNT(*) AS BIGINT)")},
  CAST({_WAITING} AS BIGINT) AS total_nigo_follow_up_days,
  {_NIGO} AS total_nigo_count,
  {_ratio(f"1000 * {_WAITING}", f"1000 * {_NIGO} + 1")} AS avg_nigo_follow_up_days,
  SUM(total_claims_analyst_hours) AS total_analyst_hours,
  {_mean_hours('total_claims_analyst_hours')} AS avg_analyst_hours"""

_DRILL = ("claims_analyst", "igo_nigo", "is_nurse_review_required")
_BASE = ("diagnosis", "industry", "geo", "claims_analyst", "igo_nigo",
         "is_nurse_review_required", "accuracy_of_decision", "decision")
BASE_MEASURES = f"""COUNT(*) AS total_count,
  CAST(SUM(over_five_biz_days) AS BIGINT) AS total_over_five_biz_days,
  CAST(SUM(over_ten_biz_days) AS BIGINT) AS total_over_ten_biz_days,
  {_mean_hours('total_hours')} AS avg_hours_per_claim,
  {_mean('salary_per_month')} AS avg_salary_per_month,
  {_mean('intake_decided_to_nigo_followed_up_biz_days')} AS avg_nigo_follow_up_biz_days,
  {_mean('nigo_followed_up_to_all_info_received_biz_days')}
    AS avg_nigo_requested_to_all_info_biz_days,
  {_mean('received_to_intake_decided_biz_days + intake_decided_to_nigo_followed_up_biz_days'
         ' + nigo_followed_up_to_all_info_received_biz_days')}
    AS avg_nigo_received_to_all_info_biz_days,
  {_mean('decided_1_to_nurse_reviewed_biz_days')} AS avg_nurse_decision_biz_days,
  {_mean('total_biz_days')} AS avg_total_biz_days"""


def _keyed_gen(by: Sequence[str]) -> str:
    """NIGO claims are counted by equality of the keys, which no null key has."""
    keyed = " AND ".join(f"{c} IS NOT NULL" for c in by)
    return GEN.replace(_NIGO, f"(CASE WHEN {keyed} THEN {_NIGO} ELSE 0 END)")


def _drilldown() -> str:
    null_keys = [f"CAST(NULL AS VARCHAR) AS {c}" for c in _DRILL]
    levels = []
    for level in range(len(_DRILL) + 1):
        keys = ", ".join([*_DRILL[:level], *null_keys[level:]])
        group = f" GROUP BY {', '.join(_DRILL[:level])}" if level else ""
        levels.append(f"SELECT {level} AS level, {keys}, {TAT} FROM claims WHERE {DECIDED}{group}")
    return " UNION ALL ".join(levels)


# ---- other operators --------------------------------------------------------------------

RAW_BIZ = (_columns(CLAIMS_RAW_BIZ)
           .replace(" received_date,", " intake_decided_date AS received_date,"))
ANY_DAYS = f"""
probe AS (
  SELECT k AS claim_num, CAST(intake_decided_date + CAST(k % 11 AS INTEGER) AS DATE) AS day,
    CAST(decided_2_date + CAST(k % 13 - 15 AS INTEGER) AS DATE) AS other_day,
    CAST(k % 41 - 20 AS INTEGER) AS n
  FROM dated)"""


def _over_days(select: str) -> str:
    return _with(CALENDAR, SEED, _dated(0, STRIDE), ANY_DAYS) + select + " FROM probe, arr"


def _open(day: str) -> str:
    return (f"list_contains(arr.bdays, {day})")


# Counted from the list of business days, not from day numbers.
_BETWEEN = """CAST(CASE
  WHEN day <= other_day THEN (SELECT COUNT(*) FROM numbered
                              WHERE biz = 1 AND d >= day AND d < other_day)
  ELSE -(SELECT COUNT(*) FROM numbered WHERE biz = 1 AND d > other_day AND d <= day)
  END AS INTEGER)"""

_DUE = " + ".join(f"CASE WHEN dur_touch_{i}_target_date < {TODAY} THEN 1 ELSE 0 END"
                  for i in range(1, 6))
_MADE = " + ".join(f"CASE WHEN dur_touch_{i}_actual_date <= {TODAY} THEN 1 ELSE 0 END"
                   for i in range(1, 6))
_PAYING = _STAGES["7_paying_out"].replace(DAY, TODAY)
_WAITING_DECISION = f"received_date < {TODAY} AND {TODAY} <= decided_2_date"
_BIZ_DAYS_BEFORE = (f"(SELECT d FROM numbered WHERE biz = 1 AND o = "
                    f"(SELECT o FROM numbered WHERE d = {TODAY}) - 19)")

ORACLE: dict[str, str] = {
    "param_analyst": _with(ANALYSTS, SEED) + """
SELECT analyst, CAST(duration_touch_compliance AS DOUBLE) AS duration_touch_compliance,
  COUNT(k) AS claims
FROM pa LEFT JOIN seed ON analyst = claims_analyst GROUP BY ALL""",
    "param_diagnosis": _with(DIAGNOSES, SEED) + """
SELECT pd.*, COUNT(k) AS claims, COUNT(k) FILTER (WHERE decision = 'Approved') AS approved_claims
FROM pd LEFT JOIN seed ON pd.diagnosis = seed.diagnosis GROUP BY ALL""",
    "ingest_claims_raw": _with(CALENDAR, SEED, _dated(0, STRIDE))
        + f"SELECT {RAW_BIZ} FROM dated",
    "ingest_null_fill": _with(SEED) + """
SELECT k AS claim_num, nigo_following_up_hours, deciding_1_hours, deciding_2_hours,
  nurse_reviewing_hours, accurate_decision, wrongly_approved, wrongly_declined,
  nigo_followed_up_mode, dollar_cost_per_hour FROM seed""",
    "dq_duplicate_claims": _over_extended(
        "SELECT claim_num, COUNT(*) AS count FROM extended GROUP BY claim_num "
        "HAVING COUNT(*) > 1", copies=7, stride=1000),
    "stage_roundtrip": _over_claims(f"SELECT {_columns(CLAIMS_WITH_DURATIONS)} FROM claims"),
    "stage_append": _over_claims(f"SELECT {_columns(CLAIMS_WITH_DURATIONS)} FROM claims"),
    "inventory_history": _over_claims(" UNION ALL ".join(
        f"SELECT {day} AS as_of, * FROM ({_inventory().replace(DAY, day)})" for day in _HISTORY)),
    "cal_date_math": """
WITH probe AS (SELECT o_orderkey AS claim_num, CAST(o_orderdate AS DATE) AS day,
                      CAST(o_orderkey % 40 AS INTEGER) - 20 AS n FROM orders)
SELECT claim_num, day, CAST(day - DATE '1998-01-01' AS INTEGER) AS days_between,
  day + n AS days_offset, CAST(day - to_months(n) AS DATE) AS months_before,
  CAST(date_trunc('year', day) AS DATE) AS year_start,
  CAST(date_trunc('month', day) AS DATE) AS month_start
FROM probe""",
    "bizday_roll": _over_days(f"""
SELECT claim_num, day, {_bday(_ord('day'))} AS rolled,
  CASE WHEN {_open('day')} THEN 1 ELSE 0 END AS is_biz_day"""),
    "bizday_offset": _over_days(
        f"SELECT claim_num, day, n, {_bday(_ord('day') + ' + n')} AS moved"),
    "bizday_between": _with(CALENDAR, SEED, _dated(0, STRIDE), ANY_DAYS,
                            f"\npairs AS (SELECT DISTINCT day, other_day FROM probe),"
                            f"\ncounted AS (SELECT day, other_day, {_BETWEEN} AS biz_days "
                            f"FROM pairs)")
        + "SELECT claim_num, day, other_day, biz_days FROM probe JOIN counted "
          "USING (day, other_day)",
    "bizday_reproject": _with(CALENDAR, SEED, _dated(0, STRIDE))
        + "SELECT claim_num, " + ", ".join(
            "intake_decided_date AS received_date" if c == "received_date" else c
            for c in REPROJECTED_DATES) + " FROM dated",
    "stage_durations": _over_extended(
        f"SELECT claim_num, total_biz_days, {', '.join(STAGE_DURATIONS)} FROM extended"),
    "claims_extended": _over_extended(f"SELECT {_columns(CLAIMS_EXTENDED)} FROM extended"),
    "claims_replicated": _over_extended(f"SELECT {_columns(CLAIMS_EXTENDED)} FROM extended",
                                        copies=7),
    "claims_with_durations":
        _over_claims(f"SELECT {_columns(CLAIMS_WITH_DURATIONS)} FROM claims"),
    "analyst_compliance": _over_claims(
        "SELECT claim_num, claims_analyst, CAST(analyst_duration_touch_compliance AS DOUBLE) "
        "AS analyst_duration_touch_compliance FROM claims"),
    "payout_schedule": _over_claims(
        "SELECT claim_num, decision, recommended_dur_touch_count, min_duration_days, "
        "actual_duration_days, payout_start_date, return_to_work_date FROM claims", copies=0),
    "expected_duration": _over_claims(
        "SELECT claim_num, diagnosis, actual_dur_touch_count, "
        "CAST(expected_duration_days AS DOUBLE) AS expected_duration_days FROM claims",
        copies=0),
    "touch_band": _over_claims(
        "SELECT claim_num, diagnosis, touch_draw, actual_dur_touch_count FROM claims", copies=0),
    "touch_targets": _over_claims(
        "SELECT claim_num, " + ", ".join(f"dur_touch_{i}_target_date" for i in range(1, 6))
        + " FROM claims", copies=0),
    "touch_alignment": _over_claims(
        "SELECT claim_num, " + ", ".join(f"dur_touch_{i}_actual_date" for i in range(1, 6))
        + " FROM claims", copies=0),
    "touch_attainment": _over_claims(
        "SELECT claim_num, recommended_dur_touch_count, actual_dur_touch_count, "
        "dur_touch_actual_v_rec_percentage FROM claims", copies=0),
    "claims_decided_this_year":
        _count(f"decided_2_date BETWEEN date_trunc('year', {TODAY}) AND {TODAY}"),
    "claims_decided_this_month":
        _count(f"decided_2_date BETWEEN date_trunc('month', {TODAY}) AND {TODAY}"),
    "claims_decided_biz_days":
        _count(f"decided_2_date BETWEEN {_BIZ_DAYS_BEFORE} AND {TODAY}"),
    "claims_decided_months":
        _count(f"decided_2_date BETWEEN {TODAY} - INTERVAL 2 MONTH AND {TODAY}"),
    "claims_decided_tat_gt_n":
        _count(f"decided_2_date BETWEEN {TODAY} - INTERVAL 2 MONTH AND {TODAY} "
               "AND total_biz_days > 10"),
    "claims_received_this_year":
        _count(f"received_date BETWEEN date_trunc('year', {TODAY}) AND {TODAY}"),
    "claims_received_this_month":
        _count(f"received_date BETWEEN date_trunc('month', {TODAY}) AND {TODAY}"),
    "decision_inventory_total": _count(_WAITING_DECISION),
    "decision_inventory_pending_gt_n": _over_claims(
        f"SELECT COUNT(*) AS count FROM claims, arr WHERE {_WAITING_DECISION} "
        f"AND {_ord(TODAY)} - {_ord('received_date')} > 10"),
    "payout_inventory_total": _count(_PAYING),
    "payout_inventory_missed_touches": _count(f"({_PAYING}) AND ({_DUE}) > ({_MADE})"),
    "returned_to_work_total":
        _count(f"return_to_work_date BETWEEN {TODAY} - INTERVAL 2 MONTH AND {TODAY}"),
    "returned_to_work_duration_gt_pct":
        _count(f"return_to_work_date BETWEEN {TODAY} - INTERVAL 2 MONTH AND {TODAY} "
               "AND actual_duration_days * 100 > min_duration_days * 120"),
    "inventory": _over_claims(_inventory()),
    "inv_agg_by_analyst": _over_claims(_inventory("claims_analyst")),
    "inv_agg_by_geo": _over_claims(_inventory("geo")),
    "inv_agg_by_diagnosis_igo": _over_claims(_inventory("diagnosis", "igo_nigo")),
    "agg_tat": _over_claims(_grouped(TAT, [])),
    "agg_tat_by_analyst": _over_claims(_grouped(TAT, _DRILL[:1])),
    "agg_tat_by_analyst_igo": _over_claims(_grouped(TAT, _DRILL[:2])),
    "agg_tat_by_analyst_igo_nurse": _over_claims(_grouped(TAT, _DRILL)),
    "agg_tat_by_geo_industry": _over_claims(_grouped(TAT, ("geo", "industry"))),
    "agg_tat_drilldown": _over_claims(_drilldown()),
    "agg_gen": _over_claims(_grouped(GEN, [])),
    "agg_gen_by_analyst_igo": _over_claims(_grouped(GEN, _DRILL[:2])),
    "agg_gen_by_all_columns": _over_claims(_grouped(_keyed_gen(_BASE[:-1]), _BASE[:-1])),
    "claims_agg_base": _over_claims(_grouped(BASE_MEASURES, _BASE, rows="claims")),
    "export_csv": _over_claims(_inventory("claims_analyst")),
    "export_json": _over_claims(
        "SELECT CAST(json_object('stage', stage, 'claims_analyst', claims_analyst, "
        f"'count', count) AS VARCHAR) AS json FROM ({_inventory('claims_analyst')})"),
}
ORACLE |= {"cube_" + key.removeprefix("claims_"): ORACLE[key] for key in (
    "agg_tat_by_geo_industry", "agg_gen_by_analyst_igo", "agg_tat_drilldown", "claims_agg_base")}

# Records of a source, as (recorded on, days until arrival, columns, condition).
_RECORDS = {
    "intake": [("intake_decided_date", "k % 4", "diagnosis AS reported, igo_nigo AS complete",
                "true"),
               ("intake_decided_date + 2", "1 + k % 9",
                "diagnosis || ', corrected' AS reported, igo_nigo AS complete", "k % 6 = 0")],
    "handling": [("nigo_followed_up_date", "k % 7",
                  "'asked' AS status, nigo_followed_up_mode AS mode", "nigo"),
                 ("all_info_received_date", "k % 3",
                  "'answered' AS status, nigo_followed_up_mode AS mode", "nigo")],
    "decisions": [("decided_1_date", "(k // 3) % 5", "'first' AS phase, decision AS verdict",
                   "true"),
                  ("decided_2_date", "(k // 5) % 6", "'final' AS phase, decision AS verdict",
                   "nurse")],
}


def _known(name: str) -> str:
    """The last record of each claim, by a window."""
    rows = " UNION ALL ".join(
        f"SELECT claim_num, CAST({day} AS DATE) AS {name}_recorded_on, {columns} FROM dated "
        f"WHERE {where} AND {day} + CAST({lag} AS INTEGER) <= DATE '2019-11-25'"
        for day, lag, columns, where in _RECORDS[name])
    return (f"{name} AS (SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY claim_num "
            f"ORDER BY {name}_recorded_on DESC) = 1)")


ORACLE["claims_known_on"] = _with(
    CALENDAR, SEED, _dated(0, STRIDE), *map(_known, _RECORDS)) + (
    "SELECT * FROM intake FULL JOIN handling USING (claim_num) "
    "FULL JOIN decisions USING (claim_num)")
