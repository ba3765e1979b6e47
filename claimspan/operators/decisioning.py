"""The decision phase of a claim: receipt, effort, turn-around time and stage durations."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspan.constants import MILESTONES
from claimspan.functions.bizcal import BusinessCalendar


def backdate_receipt(raw_biz: DataFrame, calendar: BusinessCalendar,
                     intake_biz_days: str = "intake_biz_days") -> DataFrame:
    """Read the raw receipt as the end of intake and put the true receipt before it.

    ``intake_biz_days`` names the column with the days each claim spent in intake.
    """
    renamed = raw_biz.withColumnRenamed("received_date", "intake_decided_date")
    received = calendar.offset("intake_decided_date", -F.col(intake_biz_days))
    return renamed.withColumns({"received_date": received})


def duration_name(first: str, second: str) -> str:
    return f"{first.removesuffix('_date')}_to_{second.removesuffix('_date')}_biz_days"


def stage_durations(df: DataFrame, calendar: BusinessCalendar) -> DataFrame:
    """Business days in total and between each pair of consecutive milestones."""
    durations = {"total_biz_days": calendar.between(MILESTONES[0], MILESTONES[-1])}
    for first, second in pairwise(MILESTONES):
        durations[duration_name(first, second)] = calendar.between(first, second)
    return df.withColumns(durations)


def over(days: int) -> Column:
    """1 if the turn-around took more business days than this, else 0."""
    return F.when(F.col("total_biz_days") <= days, 0).otherwise(1)


def effort_and_flags(df: DataFrame) -> DataFrame:
    """Hours in total, null if any part is null, and the late flags."""
    analyst = (F.col("nigo_following_up_hours") + F.col("deciding_1_hours")
               + F.col("deciding_2_hours"))
    everyone = (F.col("intake_deciding_hours") + F.col("nigo_following_up_hours")
                + F.col("deciding_1_hours") + F.col("nurse_reviewing_hours")
                + F.col("deciding_2_hours"))
    return df.withColumns({
        "total_claims_analyst_hours": analyst,
        "total_hours": everyone,
        "over_five_biz_days": over(5),
        "over_ten_biz_days": over(10),
    })


def extend_claims(raw_biz: DataFrame, calendar: BusinessCalendar,
                  intake_biz_days: str = "intake_biz_days") -> DataFrame:
    """``claims_raw_biz`` with intake inputs becomes ``claims_extended``.

    Besides the raw columns it needs ``intake_analyst``, ``intake_deciding_hours`` and the
    intake days. Other columns pass through.
    """
    received = backdate_receipt(raw_biz, calendar, intake_biz_days)
    return effort_and_flags(stage_durations(received, calendar))
