"""Single counts for an overview: decided, received, pending, paid out, back at work.

All bounds are worked out before the query, so that each count is a filter on literals
that reaches the scan, followed by one partial aggregate per task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspan.functions.bizcal import BusinessCalendar
from claimspan.functions.dates import DateLike
from claimspan.plans.arguments import DateRange, checked_date, checked_int, period_start
from claimspan.plans.inventory import stage_predicates
from claimspan.schemas import TOUCHES
from claimspan.sources.tables import dated_between, decided_between, decided_from, open_on


def _count(claims: DataFrame, *conditions: Column) -> DataFrame:
    for condition in conditions:
        claims = claims.where(condition)
    return claims.agg(F.count("*").alias("count"))


def _start_of(unit: str, today: dt.date) -> dt.date:
    return today.replace(month=1, day=1) if unit == "year" else today.replace(day=1)


def _unknown(subfunction: str) -> ValueError:
    return ValueError(f"unknown subfunction {subfunction!r}")


def claims_decided(claims: DataFrame, subfunction: str, today: DateLike,
                   calendar: BusinessCalendar, biz_days_before: int | str | None = None,
                   months_before: int | str | None = None,
                   biz_days_count: int | str | None = None,
                   allowed: DateRange | None = None) -> DataFrame:
    """Claims decided in a period that ends today.

    Subfunctions: ``total_this_year``, ``total_this_month``, ``total_in_period`` and
    ``TAT_gt_n_in_period``, which counts turn-around times above ``biz_days_count``.
    """
    end = checked_date(today, allowed)
    slow: list[Column] = []
    if subfunction in ("total_this_year", "total_this_month"):
        start = _start_of(subfunction.removeprefix("total_this_"), end)
    elif subfunction in ("total_in_period", "TAT_gt_n_in_period"):
        start = period_start(end, calendar, biz_days_before, months_before)
        if subfunction == "TAT_gt_n_in_period":
            slow = [F.col("total_biz_days") > checked_int("biz_days_count", biz_days_count)]
    else:
        raise _unknown(subfunction)
    return _count(claims, decided_between(claims, start, end), *slow)


def claims_received(claims: DataFrame, subfunction: str, today: DateLike,
                    allowed: DateRange | None = None) -> DataFrame:
    """Claims received ``this_year`` or ``this_month``, up to today."""
    end = checked_date(today, allowed)
    if subfunction not in ("this_year", "this_month"):
        raise _unknown(subfunction)
    start = _start_of(subfunction.removeprefix("this_"), end)
    return _count(claims, F.col("received_date").between(F.lit(start), F.lit(end)),
                  dated_between(claims, start, end))


def decision_inventory(claims: DataFrame, subfunction: str, today: DateLike,
                       calendar: BusinessCalendar, biz_days_count: int | str | None = None,
                       allowed: DateRange | None = None) -> DataFrame:
    """Claims awaiting their final decision: ``total`` or ``pending_gt_n_days``."""
    day = checked_date(today, allowed)
    waiting = [(F.col("received_date") < F.lit(day)) & (F.lit(day) <= F.col("decided_2_date")),
               decided_from(claims, day), open_on(claims, day)]
    if subfunction == "total":
        return _count(claims, *waiting)
    if subfunction != "pending_gt_n_days":
        raise _unknown(subfunction)
    # More than n business days in [received, day) means received on or before this date.
    pending = calendar.ordinal_of(day) - checked_int("biz_days_count", biz_days_count)
    if pending < 1:  # before the calendar, where no claim is
        return _count(claims, F.lit(False))
    if pending > calendar.ordinal_of(calendar.end):
        return _count(claims, *waiting)
    latest = calendar.day_at(pending - 1)
    return _count(claims, *waiting, F.col("received_date") <= F.lit(latest))


def missed_touches(day: Column) -> Column:
    """More touches were due before the day than took place up to it."""
    def happened(condition) -> Column:
        return sum(F.coalesce(condition(i).cast("int"), F.lit(0)) for i in TOUCHES)

    due = happened(lambda i: F.col(f"dur_touch_{i}_target_date") < day)
    made = happened(lambda i: F.col(f"dur_touch_{i}_actual_date") <= day)
    return due > made


def payout_inventory(claims: DataFrame, subfunction: str, today: DateLike,
                     allowed: DateRange | None = None) -> DataFrame:
    """Claims being paid out: ``total`` or ``count_with_missed_touches``."""
    today = checked_date(today, allowed)
    day = F.lit(today)
    paying = [stage_predicates(day)["7_paying_out"], open_on(claims, today)]
    if subfunction == "total":
        return _count(claims, *paying)
    if subfunction != "count_with_missed_touches":
        raise _unknown(subfunction)
    return _count(claims, *paying, missed_touches(day))


def claims_returned_to_work(claims: DataFrame, subfunction: str, today: DateLike,
                            calendar: BusinessCalendar, months_before: int | str,
                            percent: int | str | None = None,
                            allowed: DateRange | None = None) -> DataFrame:
    """Returns to work in a period: ``total`` or ``duration_gt_x_percent`` above the least."""
    end = checked_date(today, allowed)
    start = period_start(end, calendar, months_before=months_before)
    returned = [F.col("return_to_work_date").between(F.lit(start), F.lit(end)),
                dated_between(claims, start, end)]
    if subfunction == "total":
        return _count(claims, *returned)
    if subfunction != "duration_gt_x_percent":
        raise _unknown(subfunction)
    allowed_percent = 100 + checked_int("percent", percent)
    longer = F.col("actual_duration_days") * 100 > F.col("min_duration_days") * allowed_percent
    return _count(claims, *returned, longer)
