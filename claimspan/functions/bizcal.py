"""Business-day arithmetic as column functions.

A calendar is one row with two arrays, read by an uncorrelated scalar subquery. Spark
evaluates that once per query and then has both arrays as constants, so every operation
is one or two array lookups inside generated code: no join, no shuffle and no UDF.

- ``marks[i]`` belongs to day ``i`` of the calendar: twice the number of business days
  before it, plus 1 if it is a business day itself.
- ``bdays[j]`` is business day number ``j``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, MutableMapping
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, StructField, StructType

from claimspan.constants import US_HOLIDAYS
from claimspan.functions.dates import DateLike, as_date, column


class BusinessCalendar:
    """Monday to Friday without the holidays, between two dates.

    A date outside the calendar fails the query; null dates give null.
    """

    def __init__(self, start: DateLike = "2019-01-01", end: DateLike = "2022-12-31",
                 holidays: Iterable[DateLike] = US_HOLIDAYS):
        self.start, self.end = as_date(start), as_date(end)
        days = (self.end - self.start).days + 1
        if days < 1:
            raise ValueError(f"a calendar spans at least a day, not {days}")
        closed = {as_date(h) for h in holidays}
        self._marks: list[int] = []
        self._bdays: list[dt.date] = []
        for day in (self.start + dt.timedelta(days=i) for i in range(days)):
            is_open = day.weekday() < 5 and day not in closed
            self._marks.append(2 * len(self._bdays) + is_open)
            if is_open:
                self._bdays.append(day)
        # Stopped sessions are not kept alive.
        self._frames: MutableMapping[SparkSession, tuple[Column, Column]] = WeakKeyDictionary()

    # ---- scalars, for query arguments -------------------------------------------------

    def ordinal_of(self, day: DateLike) -> int:
        """Number of business days of the calendar before the day."""
        index = (as_date(day) - self.start).days
        if not 0 <= index < len(self._marks):
            raise ValueError(f"{day} is outside the calendar {self.start} to {self.end}")
        return self._marks[index] // 2

    def day_at(self, ordinal: int) -> dt.date:
        if not 0 <= ordinal < len(self._bdays):
            raise ValueError(f"no business day {ordinal} in {self.start} to {self.end}")
        return self._bdays[ordinal]

    def offset_date(self, day: DateLike, count: int) -> dt.date:
        return self.day_at(self.ordinal_of(day) + count)

    # ---- columns ----------------------------------------------------------------------

    def _arrays(self, spark: SparkSession) -> tuple[Column, Column]:
        if spark not in self._frames:
            row = spark.createDataFrame(
                pa.table({"marks": [self._marks], "bdays": [self._bdays]}),
                StructType([StructField("marks", ArrayType(IntegerType(), False), False),
                            StructField("bdays", ArrayType(DateType(), False), False)]),
            )
            self._frames[spark] = (row.select("marks").scalar(), row.select("bdays").scalar())
        return self._frames[spark]

    def _item(self, array_number: int, index: Column) -> Column:
        """Array item that fails when out of range, also in sessions without ANSI mode.

        The mode that holds when the Column is made counts. Switching ANSI mode off between
        that and running the query turns dates outside the calendar into nulls. The guarded
        form would do in both modes, but the build's generated methods would then have over
        17,000 bytes, twice what HotSpot compiles.
        """
        spark = SparkSession.active()
        array = self._arrays(spark)[array_number]
        if spark.conf.get("spark.sql.ansi.enabled") == "true":
            return array[index]
        outside = F.raise_error(F.lit("date outside the business calendar"))
        return F.when(index.isNotNull(), F.coalesce(F.get(array, index), outside))

    def _mark(self, day: Column | str) -> Column:
        return self._item(0, F.datediff(column(day), F.lit(self.start)))

    def ordinal(self, day: Column | str) -> Column:
        """Number of business days of the calendar before the day."""
        return _half(self._mark(day))

    def business_day(self, ordinal: Column) -> Column:
        """The business day with this many business days of the calendar before it."""
        return self._item(1, ordinal)

    def roll(self, day: Column | str) -> Column:
        """The day itself if it is a business day, else the next one."""
        return self.business_day(self.ordinal(day))

    def offset(self, day: Column | str, count: Column | int) -> Column:
        """Roll forward, then move ``count`` business days, back if negative."""
        return self.business_day(self.ordinal(day) + count)

    def between(self, first: Column | str, second: Column | str) -> Column:
        """Business days in [first, second); minus those in (second, first] if reversed."""
        reverse = (column(first) > column(second)).cast("int")
        return _half(self._mark(second) + reverse) - _half(self._mark(first) + reverse)

    def reproject(self, anchor: DateLike, day: Column | str) -> Column:
        """The date x calendar days after the anchor becomes x business days after it."""
        passed = F.datediff(column(day), F.lit(as_date(anchor)))
        return self.business_day(passed + self.ordinal_of(anchor))

    def is_biz_day(self, day: Column | str) -> Column:
        return self._mark(day) % 2 == 1


def _half(mark: Column) -> Column:
    return F.shiftright(mark, 1)
