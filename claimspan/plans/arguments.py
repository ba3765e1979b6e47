"""Checks of query arguments. A bad argument is a ValueError, a doubtful one a warning."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Sequence

from claimspan.constants import ADVISORY_BOUNDS, PERMITTED_COLUMNS
from claimspan.functions.bizcal import BusinessCalendar
from claimspan.functions.dates import DateLike, as_date, date_months_before

DateRange = tuple[DateLike, DateLike]


def checked_date(value: DateLike, allowed: DateRange | None = None) -> dt.date:
    """A date, within the allowed range if one is given."""
    day = as_date(value)
    if allowed and not as_date(allowed[0]) <= day <= as_date(allowed[1]):
        raise ValueError(f"date {day} is not between {allowed[0]} and {allowed[1]}")
    return day


def checked_period(start: DateLike, end: DateLike,
                   allowed: DateRange | None = None) -> tuple[dt.date, dt.date]:
    first, last = checked_date(start, allowed), checked_date(end, allowed)
    if last < first:
        raise ValueError(f"the period ends on {last}, before it starts on {first}")
    return first, last


def checked_columns(by: Sequence[str]) -> list[str]:
    """Group columns, all of them permitted."""
    unknown = [name for name in by if name not in PERMITTED_COLUMNS]
    if unknown:
        raise ValueError(f"cannot group by {', '.join(unknown)}; "
                         f"permitted are {', '.join(PERMITTED_COLUMNS)}")
    return list(by)


def checked_int(name: str, value: int | str) -> int:
    """A whole number; one above its advisory bound is used with a warning."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a whole number, not {value!r}") from None
    if number > ADVISORY_BOUNDS[name]:
        warnings.warn(f"{name} should be at most {ADVISORY_BOUNDS[name]}, not {number}",
                      stacklevel=3)
    return number


def period_start(today: dt.date, calendar: BusinessCalendar,
                 biz_days_before: int | str | None = None,
                 months_before: int | str | None = None) -> dt.date:
    """First day of the period that ends today, from exactly one of the two lengths."""
    if (biz_days_before is None) == (months_before is None):
        raise ValueError("give exactly one of biz_days_before and months_before")
    if months_before is not None:
        return date_months_before(today, checked_int("months_before", months_before))
    count = checked_int("biz_days_before", biz_days_before)
    if count - 1 > calendar.ordinal_of(today):
        raise ValueError(f"biz_days_before {count} reaches before the calendar, which starts on "
                         f"{calendar.start}; build a BusinessCalendar with an earlier start")
    return calendar.offset_date(today, 1 - count)
