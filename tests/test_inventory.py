import datetime as dt
import itertools
import random

import pytest

from claimspan.constants import DEFAULT_TODAY, DEMO_QUERY_DATES
from claimspan.plans.inventory import inventory, inventory_by
from support import CLAIM, SF, date
from harness import derived

STAGES = ["0_intake_deciding", "1_following_up", "2_waiting_call", "3_waiting_email",
          "4_deciding_1", "5_nurse_deciding", "6_deciding_2", "7_paying_out", "8_total"]


def stages_of(c, day):
    """The stages of one claim, in plain Python; a comparison with a missing date fails."""
    def lt(a, b):
        return a is not None and b is not None and a < b

    def le(a, b):
        return a is not None and b is not None and a <= b

    def during(start, end):
        return lt(c[start], day) and le(day, c[end])

    igo, nigo = c["igo_nigo"] == "IGO", c["igo_nigo"] == "NIGO"
    nurse = c["is_nurse_review_required"] == "Yes"
    no_nurse = c["is_nurse_review_required"] == "No"
    received, one, two = c["received_date"], c["decided_1_date"], c["decided_2_date"]
    back = c["return_to_work_date"]
    waiting = nigo and during("nigo_followed_up_date", "all_info_received_date")
    found = [
        during("received_date", "intake_decided_date"),
        nigo and during("intake_decided_date", "nigo_followed_up_date"),
        waiting and c["nigo_followed_up_mode"] == "Call",
        waiting and c["nigo_followed_up_mode"] == "Email",
        igo and during("intake_decided_date", "decided_1_date")
        or nigo and during("all_info_received_date", "decided_1_date"),
        nurse and during("decided_1_date", "nurse_reviewed_date"),
        nurse and during("nurse_reviewed_date", "decided_2_date"),
        c["decision"] == "Approved" and lt(day, back)
        and (no_nurse and lt(one, day) or nurse and lt(two, day)),
        lt(received, day) and (
            c["decision"] == "Approved" and (lt(day, back) or le(day, one) or le(day, two))
            or c["decision"] == "Declined" and (nurse and le(day, two) or no_nurse and le(day, one))
        ),
    ]
    return [stage for stage, inside in zip(STAGES, found) if inside]


def irregular(count, seed):
    """Claims that keep no rule: any order of dates, any mix of values, nulls."""
    rng = random.Random(seed)
    days = [date("2020-01-10") + dt.timedelta(days=i) for i in range(12)] + [None]
    return [
        {name: rng.choice(days) for name in CLAIM if name.endswith("_date")} | {
            "igo_nigo": rng.choice(["IGO", "NIGO", None]),
            "nigo_followed_up_mode": rng.choice(["Call", "Email", "N/A"]),
            "is_nurse_review_required": rng.choice(["Yes", "No", None]),
            "decision": rng.choice(["Approved", "Declined", None]),
            "diagnosis": rng.choice(["Nervous", "Injuries", None]),
        }
        for _ in range(count)
    ]


@pytest.mark.parametrize("day", ["2020-01-12", "2020-01-15", "2020-01-20"])
def test_irregular_claims_against_plain_python(spark, claims_of, day):
    changes = irregular(600, seed=3)
    claims = claims_of(*changes).cache()
    expected = {}
    for change in changes:
        for stage in stages_of({**CLAIM, **change}, date(day)):
            key = stage, change["diagnosis"]
            expected[key] = expected.get(key, 0) + 1
    got = {(r.stage, r.diagnosis): r["count"]
           for r in inventory_by(claims, day, ["diagnosis"]).collect()}
    assert got == expected
    totals = {s: sum(n for (stage, _), n in expected.items() if stage == s) for s in STAGES}
    assert {r.stage: r["count"] for r in inventory(claims, day).collect()} == totals


def test_total_is_not_the_sum_of_the_stages(claims_of):
    unknown_mode = claims_of({"nigo_followed_up_mode": "N/A"})
    counts = {r.stage: r["count"] for r in inventory(unknown_mode, "2020-01-10").collect()}
    assert counts.pop("8_total") == 1
    assert sum(counts.values()) == 0


def test_a_stage_starts_after_its_start_date_and_includes_its_end(claims_of):
    def stages(day):
        return [r.stage for r in inventory(claims_of({}), day).collect() if r["count"]]

    assert stages("2020-01-02") == []
    assert stages("2020-01-03") == ["0_intake_deciding", "8_total"]
    assert stages("2020-01-06") == ["0_intake_deciding", "8_total"]
    assert stages("2020-01-07") == ["1_following_up", "8_total"]
    assert stages("2020-01-20") == ["6_deciding_2", "8_total"]  # a holiday
    assert stages("2020-03-15") == ["7_paying_out", "8_total"]
    assert stages("2020-03-16") == []


def test_inventory_has_nine_ordered_rows_also_when_empty(claims_of):
    empty = claims_of({}).where("false")
    rows = inventory(empty, "2020-01-15").collect()
    assert [(r.stage, r["count"]) for r in rows] == [(stage, 0) for stage in STAGES]
    assert inventory_by(empty, "2020-01-15", ["geo"]).count() == 0


def test_groups_add_up_and_are_ordered(spark):
    claims = derived.claims_with_durations(spark, SF, dims=False).cache()
    whole = {r.stage: r["count"] for r in inventory(claims, "2020-01-15").collect()}
    rows = inventory_by(claims, "2020-01-15", ["claims_analyst", "igo_nigo"]).collect()
    keys = [(r.stage, r.claims_analyst, r.igo_nigo) for r in rows]
    assert keys == sorted(keys)
    sums = {stage: sum(r["count"] for r in group)
            for stage, group in itertools.groupby(rows, key=lambda r: r.stage)}
    assert sums == {stage: count for stage, count in whole.items() if count}
    assert min(r["count"] for r in rows) > 0


def test_no_columns_means_inventory(claims_of):
    claims = claims_of({})
    assert (inventory_by(claims, "2020-01-15").collect()
            == inventory(claims, "2020-01-15").collect())
    assert inventory(claims).collect() == inventory(claims, DEFAULT_TODAY).collect()


def test_arguments(claims_of):
    claims = claims_of({})
    with pytest.raises(ValueError, match="claim_num"):
        inventory_by(claims, "2020-01-15", ["claim_num"])
    with pytest.raises(ValueError):
        inventory(claims, "2020-02-30")
    with pytest.raises(ValueError, match="not between"):
        inventory(claims, "2020-03-02", allowed=DEMO_QUERY_DATES)
