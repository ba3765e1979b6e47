import warnings

import numpy as np
import pytest

from claimspan.constants import DEMO_TODAY_DATES, US_HOLIDAYS
from claimspan.functions.bizcal import BusinessCalendar
from claimspan.plans import counts
from support import SF, date
from harness import derived

TODAY = "2020-04-10"


@pytest.fixture(scope="module")
def claims(spark):
    return derived.claims_with_durations(spark, SF, dims=False).cache()


def number(df):
    assert df.columns == ["count"]
    return df.head()[0]


@pytest.mark.parametrize("n", [0, 3, 10, 40])
def test_pending_equals_counting_business_days(claims, calendar, n):
    day = date("2020-01-21")
    waiting = claims.where(f"received_date < '{day}' and '{day}' <= decided_2_date").collect()
    expected = sum(np.busday_count(r.received_date, day, holidays=US_HOLIDAYS) > n for r in waiting)
    assert number(counts.decision_inventory(claims, "pending_gt_n_days", day, calendar, n)) == expected
    assert number(counts.decision_inventory(claims, "total", day, calendar)) == len(waiting) > 0


def test_receipt_off_business_days(claims_of, calendar):
    saturday = claims_of({"received_date": date("2020-01-04")})
    for n in range(8):
        days = np.busday_count("2020-01-04", "2020-01-10", holidays=US_HOLIDAYS)
        got = counts.decision_inventory(saturday, "pending_gt_n_days", "2020-01-10", calendar, n)
        assert number(got) == int(days > n)


def test_decided_threshold_is_strict(claims_of, calendar):
    claims = claims_of(*({"decided_2_date": date("2020-04-01"), "total_biz_days": n}
                         for n in (9, 10, 11)))
    got = counts.claims_decided(claims, "TAT_gt_n_in_period", TODAY, calendar, months_before=1,
                                biz_days_count="10")
    assert number(got) == 1


def test_five_business_days_before_means_today_and_four_more(claims_of, calendar):
    claims = claims_of(*({"decided_2_date": date(d)} for d in
                         ("2020-04-03", "2020-04-06", "2020-04-10", "2020-04-11")))
    got = counts.claims_decided(claims, "total_in_period", TODAY, calendar, biz_days_before=5)
    assert number(got) == 2


def test_missed_touches(claims_of):
    base = {"return_to_work_date": date("2020-05-30")}
    claims = claims_of(
        {**base, "dur_touch_1_target_date": date("2020-03-01")},
        {**base, "dur_touch_1_target_date": date("2020-04-10")},
        {**base, "dur_touch_1_target_date": date("2020-03-01"),
         "dur_touch_1_actual_date": date("2020-04-10")},
        {**base, "dur_touch_1_target_date": date("2020-03-01"),
         "dur_touch_2_target_date": date("2020-03-08"),
         "dur_touch_1_actual_date": date("2020-03-02")},
    )
    assert number(counts.payout_inventory(claims, "total", TODAY)) == 4
    assert number(counts.payout_inventory(claims, "count_with_missed_touches", TODAY)) == 2


def test_returned_to_work(claims_of, calendar):
    claims = claims_of(*({"return_to_work_date": date("2020-03-16"), "min_duration_days": 50.0,
                          "actual_duration_days": days} for days in (55.0, 60.0, 61.0)))
    run = counts.claims_returned_to_work
    assert number(run(claims, "total", TODAY, calendar, 2)) == 3
    assert number(run(claims, "duration_gt_x_percent", TODAY, calendar, 2, percent=20)) == 1
    assert number(run(claims, "total", "2020-03-15", calendar, 2)) == 0


def test_received(claims_of):
    claims = claims_of({"received_date": date("2019-12-31")}, {"received_date": date("2020-01-01")},
                       {"received_date": date("2020-04-01")}, {"received_date": date("2020-04-11")})
    assert number(counts.claims_received(claims, "this_year", TODAY)) == 2
    assert number(counts.claims_received(claims, "this_month", TODAY)) == 1


def test_bad_arguments(claims_of, calendar):
    claims = claims_of({})

    def decided(subfunction, today=TODAY, **arguments):
        return counts.claims_decided(claims, subfunction, today, calendar, **arguments)

    for arguments in ({}, {"biz_days_before": 5, "months_before": 1}):
        with pytest.raises(ValueError, match="exactly one"):
            decided("total_in_period", **arguments)
    with pytest.raises(ValueError, match="biz_days_count must be a whole number"):
        decided("TAT_gt_n_in_period", months_before=1)
    with pytest.raises(ValueError, match="months_before must be a whole number"):
        decided("total_in_period", months_before="two")
    with pytest.raises(ValueError, match="not between"):
        decided("total_this_year", today="2020-04-25", allowed=DEMO_TODAY_DATES)
    for query in (lambda s: decided(s), lambda s: counts.claims_received(claims, s, TODAY),
                  lambda s: counts.decision_inventory(claims, s, TODAY, calendar),
                  lambda s: counts.payout_inventory(claims, s, TODAY),
                  lambda s: counts.claims_returned_to_work(claims, s, TODAY, calendar, 2)):
        with pytest.raises(ValueError, match="unknown subfunction"):
            query("this_decade")


def test_large_arguments_warn_but_work(claims_of, calendar):
    claims = claims_of({})
    with pytest.warns(UserWarning, match="months_before should be at most 6"):
        counts.claims_decided(claims, "total_in_period", TODAY, calendar, months_before=7)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        counts.claims_decided(claims, "total_in_period", TODAY, calendar, months_before=6)


def test_bounds_outside_the_calendar(claims_of, calendar):
    """A bound before the calendar means no claim; a period before it says what to do."""
    claims = claims_of({"decided_2_date": date("2020-02-01")})
    with pytest.warns(UserWarning):
        far = counts.decision_inventory(claims, "pending_gt_n_days", "2020-01-21", calendar, 300)
    assert far.head()[0] == 0
    all_ = counts.decision_inventory(claims, "pending_gt_n_days", "2020-01-21", calendar, -2000)
    assert all_.head()[0] == 1
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="earlier start"):
        counts.claims_decided(claims, "total_in_period", "2020-01-21", calendar,
                              biz_days_before=300)
    longer = BusinessCalendar("1900-01-01", "2100-12-31")
    assert longer.ordinal_of("2100-12-31") > 50_000
