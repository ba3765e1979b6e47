"""Calendar-day functions over whole date columns, and their scalar twins for arguments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = dt.date | str


def as_date(value: DateLike) -> dt.date:
    """A query argument as a date; a malformed one is a ValueError."""
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def cal_days_between(first: Column | str, second: Column | str) -> Column:
    return F.datediff(column(second), column(first))


def cal_days_offset(day: Column | str, days: Column | str) -> Column:
    """Add calendar days; part of a day is ignored."""
    return F.date_add(column(day), F.floor(column(days)).cast("int"))


def months_before(day: Column | str, months: Column | int) -> Column:
    """Go back whole months, staying within the target month."""
    return F.add_months(column(day), -months)


def first_day_of_year(day: Column | str) -> Column:
    return F.trunc(column(day), "year")


def first_day_of_month(day: Column | str) -> Column:
    return F.trunc(column(day), "month")


def date_months_before(day: dt.date, months: int) -> dt.date:
    """months_before for one date. A query bound must be a literal to reach the scan."""
    month_index = day.year * 12 + day.month - 1 - months
    first = dt.date(month_index // 12, month_index % 12 + 1, 1)
    next_month = (first + dt.timedelta(days=31)).replace(day=1)
    return min(first + dt.timedelta(days=day.day - 1), next_month - dt.timedelta(days=1))
