"""Turn-around time and effort of claims, by any permitted columns.

Each takes claims, or a stored cube of them (``claimspan.plans.cube``) in their place, and is one
scan and one aggregate. Spark aggregates within tasks first, so only one row
per task and group is shuffled, however unevenly claims spread over the groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspan.constants import PERMITTED_COLUMNS
from claimspan.functions.dates import DateLike
from claimspan.functions.rounding import half_up_ratio, whole_quotient
from claimspan.plans.arguments import DateRange, checked_columns, checked_period
from claimspan.sources.tables import decided_between

DRILL_DOWN = ("claims_analyst", "igo_nigo", "is_nurse_review_required")
BASE_DIMENSIONS = (*PERMITTED_COLUMNS, "decision")
_WAITING_DAYS = "nigo_followed_up_to_all_info_received_biz_days"

_UNTIL_INFORMED = ("received_to_intake_decided_biz_days",
                   "intake_decided_to_nigo_followed_up_biz_days", _WAITING_DAYS)


def _exact(hours: str) -> Column:
    """Hours as decimals, whose sums don't depend on the order of the claims."""
    return F.col(hours).cast("decimal(18,6)")


def _whole(*columns: str) -> dict[str, Column]:
    """Sum of a whole-number column, or of a sum of such, and how many claims have it."""
    values = reduce(add, map(F.col, columns))
    return {"sum": F.sum(values), "known": F.count(values)}


def _hours(column: str) -> dict[str, Column]:
    return {"sum": F.sum(_exact(column)), "known": F.count(column)}


def part_aggregates() -> dict[str, Column]:
    """Sums and counts that every measure is worked out from. They add up across groups."""
    pairs = {
        "biz_days": _whole("total_biz_days"),
        "waiting": _whole(_WAITING_DAYS),
        "analyst_hours": _hours("total_claims_analyst_hours"),
        "total_hours": _hours("total_hours"),
        "salary": _whole("salary_per_month"),
        "follow_up": _whole("intake_decided_to_nigo_followed_up_biz_days"),
        "until_informed": _whole(*_UNTIL_INFORMED),
        "nurse": _whole("decided_1_to_nurse_reviewed_biz_days"),
    }
    return {
        "claims": F.count("*"),
        "over_5": F.sum("over_five_biz_days"),
        "over_10": F.sum("over_ten_biz_days"),
        "nigo": F.count_if(F.col("igo_nigo") == "NIGO"),
        **{f"{name}_{kind}": part for name, pair in pairs.items()
           for kind, part in pair.items()},
    }


_TAT_PARTS = ("claims", "biz_days_sum", "biz_days_known", "over_5", "over_10")
_GEN_PARTS = (*_TAT_PARTS, "waiting_sum", "nigo", "analyst_hours_sum", "analyst_hours_known")
_BASE_PARTS = ("claims", "over_5", "over_10", *(
    f"{name}_{kind}" for name in ("total_hours", "salary", "follow_up", "waiting",
                                  "until_informed", "nurse", "biz_days")
    for kind in ("sum", "known")))
_COUNTS = ("claims", "nigo")  # zero, not null, without a claim; so are all `known`
PART_PREFIX = "part_"


def _part(name: str) -> Column:
    return F.col(f"__{name}")


def _parts(claims: DataFrame, names: Sequence[str]) -> list[Column]:
    """The parts, counted from claims or summed from a stored cube of them."""
    if PART_PREFIX + "claims" not in claims.columns:
        every = part_aggregates()
        return [every[name].alias(f"__{name}") for name in names]
    return [_summed(name, PART_PREFIX + name).alias(f"__{name}") for name in names]


def _summed(name: str, column: str) -> Column:
    total = F.sum(column)
    if name in _COUNTS or name.endswith("_known"):
        return F.coalesce(total, F.lit(0))
    return total.cast("decimal(28,6)") if "hours" in name else total


def _mean(name: str) -> Column:
    """Mean of hours, rounded."""
    return F.round((_part(f"{name}_sum") / _part(f"{name}_known")).cast("double"), 2)


def _decided(claims: DataFrame, start: DateLike, end: DateLike,
             allowed: DateRange | None) -> DataFrame:
    return claims.where(decided_between(claims, *checked_period(start, end, allowed)))


def _ordered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.orderBy(*by) if by else df


def _tat_measures(percent) -> list[Column]:
    return [
        _part("claims").alias("count_of_claims"),
        half_up_ratio(_part("biz_days_sum"), _part("biz_days_known")).alias("avg_tat"),
        _part("over_5").alias("count_tat_over_5_days"),
        percent(_part("over_5"), _part("claims")).alias("percent_tat_over_5_days"),
        _part("over_10").alias("count_tat_over_10_days"),
        percent(_part("over_10"), _part("claims")).alias("percent_tat_over_10_days"),
    ]


def _percent(part: Column, whole: Column) -> Column:
    return half_up_ratio(part * 100, whole)


def _whole_percent(part: Column, whole: Column) -> Column:
    return whole_quotient(part * 100, whole)


def agg_tat(claims: DataFrame, start: DateLike, end: DateLike, by: Sequence[str] = (),
            allowed: DateRange | None = None) -> DataFrame:
    """Turn-around times of the claims decided in the period, percentages to 2 decimals.

    Without columns it is a single row, also for a period without claims.
    """
    columns = checked_columns(by)
    parts = _decided(claims, start, end, allowed).groupBy(*columns).agg(
        *_parts(claims, _TAT_PARTS))
    return _ordered(parts.select(*columns, *_tat_measures(_percent)), columns)


def agg_tat_drilldown(claims: DataFrame, start: DateLike, end: DateLike,
                      by: Sequence[str] = DRILL_DOWN,
                      allowed: DateRange | None = None) -> DataFrame:
    """``agg_tat`` for no column, the first, the first two and so on, told apart by ``level``.

    The claims are aggregated once at the finest level; the levels above are rolled up
    from those few rows. A period without claims gives no rows.
    """
    columns = checked_columns(by)
    finest = _decided(claims, start, end, allowed).groupBy(*columns).agg(
        *_parts(claims, _TAT_PARTS))
    level = (F.lit(len(columns)) - F.bit_count(F.grouping_id())).cast("int")
    levels = finest.rollup(*columns).agg(
        level.alias("level"),
        *(F.sum(_part(name)).alias(f"__{name}") for name in _TAT_PARTS),  # whole numbers
    )
    return levels.select("level", *columns, *_tat_measures(_percent)).orderBy("level", *columns)


def agg_gen(claims: DataFrame, start: DateLike, end: DateLike, by: Sequence[str] = (),
            allowed: DateRange | None = None) -> DataFrame:
    """Turn-around times, waiting days and analyst hours; percentages cut to whole numbers.

    A group with a null key counts no NIGO claims, since null equals nothing.
    """
    columns = checked_columns(by)
    parts = _decided(claims, start, end, allowed).groupBy(*columns).agg(
        *_parts(claims, _GEN_PARTS))
    keyed = reduce(and_, (F.col(c).isNotNull() for c in columns), F.lit(True))
    nigo = F.when(keyed, _part("nigo")).otherwise(0)
    # Days per NIGO claim with 0.001 added to the claims, in thousandths to stay whole.
    waiting = half_up_ratio(_part("waiting_sum") * 1000, nigo * 1000 + 1)
    result = parts.select(
        *columns,
        *_tat_measures(_whole_percent),
        _part("waiting_sum").alias("total_nigo_follow_up_days"),
        nigo.alias("total_nigo_count"),
        waiting.alias("avg_nigo_follow_up_days"),
        _part("analyst_hours_sum").cast("double").alias("total_analyst_hours"),
        _mean("analyst_hours").alias("avg_analyst_hours"),
    )
    return _ordered(result, columns)


def claims_agg_base(claims: DataFrame) -> DataFrame:
    """Counts and means of all claims by eight dimensions."""
    means = {
        "avg_salary_per_month": "salary",
        "avg_nigo_follow_up_biz_days": "follow_up",
        "avg_nigo_requested_to_all_info_biz_days": "waiting",
        "avg_nigo_received_to_all_info_biz_days": "until_informed",
        "avg_nurse_decision_biz_days": "nurse",
        "avg_total_biz_days": "biz_days",
    }
    parts = claims.groupBy(*BASE_DIMENSIONS).agg(*_parts(claims, _BASE_PARTS))
    return parts.select(
        *BASE_DIMENSIONS,
        _part("claims").alias("total_count"),
        _part("over_5").alias("total_over_five_biz_days"),
        _part("over_10").alias("total_over_ten_biz_days"),
        _mean("total_hours").alias("avg_hours_per_claim"),
        *(half_up_ratio(_part(f"{part}_sum"), _part(f"{part}_known")).alias(name)
          for name, part in means.items()),
    ).orderBy(*BASE_DIMENSIONS)
