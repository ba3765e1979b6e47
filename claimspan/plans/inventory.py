"""How many claims are in which stage on a day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspan.constants import DEFAULT_TODAY, MILESTONES
from claimspan.functions.dates import DateLike
from claimspan.plans.arguments import DateRange, checked_columns, checked_date
from claimspan.sources.tables import open_on


def stage_predicates(day: Column) -> dict[str, Column]:
    """Condition of each stage. A stage lasts from after its start date to its end date.

    The total has a condition of its own: a claim may be open without being in a stage.
    """
    received, intake, followed, informed, decided_1, reviewed, decided_2, returned = map(F.col, (
        "received_date", "intake_decided_date", "nigo_followed_up_date",
        "all_info_received_date", "decided_1_date", "nurse_reviewed_date", "decided_2_date",
        "return_to_work_date"))
    igo, nigo = F.col("igo_nigo") == "IGO", F.col("igo_nigo") == "NIGO"
    nurse = F.col("is_nurse_review_required") == "Yes"
    no_nurse = F.col("is_nurse_review_required") == "No"
    mode = F.col("nigo_followed_up_mode")
    approved, declined = F.col("decision") == "Approved", F.col("decision") == "Declined"

    def during(start: Column, end: Column) -> Column:
        return (start < day) & (day <= end)

    waiting = nigo & during(followed, informed)
    decided = (no_nurse & (decided_1 < day)) | (nurse & (decided_2 < day))
    still_open = (day < returned) | (day <= decided_1) | (day <= decided_2)
    undecided = (nurse & (day <= decided_2)) | (no_nurse & (day <= decided_1))
    return {
        "0_intake_deciding": during(received, intake),
        "1_following_up": nigo & during(intake, followed),
        "2_waiting_call": waiting & (mode == "Call"),
        "3_waiting_email": waiting & (mode == "Email"),
        "4_deciding_1": (igo & during(intake, decided_1)) | (nigo & during(informed, decided_1)),
        "5_nurse_deciding": nurse & during(decided_1, reviewed),
        "6_deciding_2": nurse & during(reviewed, decided_2),
        "7_paying_out": approved & decided & (day < returned),
        "8_total": (received < day) & ((approved & still_open) | (declined & undecided)),
    }


def may_be_open(day: Column) -> Column:
    """Holds for every claim that is in any stage: something began, something is to come.

    Simple enough for the scan, where it skips data that is all past or all future.
    """
    began = (F.col(name) < day for name in MILESTONES)
    to_come = (day <= F.col(name) for name in (*MILESTONES[1:], "return_to_work_date"))
    return reduce(or_, began) & reduce(or_, to_come)


def _stage_counts(claims: DataFrame, day: dt.date, by: Sequence[str]) -> DataFrame:
    """One scan, one aggregate: a row per group with a count per stage, then a row per stage."""
    stages = stage_predicates(F.lit(day))
    counts = (
        claims.where(may_be_open(F.lit(day)) & open_on(claims, day))
        .groupBy(*by)
        .agg(*(F.count(F.when(inside, 1)).alias(stage) for stage, inside in stages.items()))
    )
    return counts.unpivot(list(by), list(stages), "stage", "count").select("stage", *by, "count")


def inventory(claims: DataFrame, day: DateLike = DEFAULT_TODAY,
              allowed: DateRange | None = None) -> DataFrame:
    """Claims per stage on the day: always nine rows, in stage order."""
    # An aggregate without groups is one partition, so sorting that is enough.
    return _stage_counts(claims, checked_date(day, allowed), []).sortWithinPartitions("stage")


def inventory_by(claims: DataFrame, day: DateLike = DEFAULT_TODAY, by: Sequence[str] = (),
                 allowed: DateRange | None = None) -> DataFrame:
    """Claims per stage and group; pairs without a claim are absent."""
    if not by:
        return inventory(claims, day, allowed)
    columns = checked_columns(by)
    counts = _stage_counts(claims, checked_date(day, allowed), columns)
    return counts.where(F.col("count") > 0).orderBy("stage", *columns)
