from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from claimspan.functions.rounding import half_up_ratio
from claimspan.plans.aggregates import DRILL_DOWN, agg_gen, agg_tat, agg_tat_drilldown
from support import SF, date
from harness import derived

PERIOD = "2020-01-01", "2020-02-28"


@pytest.fixture(scope="module")
def claims(spark):
    return derived.claims_with_durations(spark, SF, dims=False).cache()


def test_half_up_ratio_is_exact(spark):
    pairs = [(n, d) for d in (1, 3, 7, 8, 40, 200) for n in range(-50, 3000, 13)]
    frame = spark.createDataFrame(pairs, "n long, d long")
    for n, d, got in frame.select("n", "d", half_up_ratio(F.col("n"), F.col("d"))).collect():
        exact = Fraction(n, d) * 100
        digits = Decimal(exact.numerator) / Decimal(exact.denominator)
        assert got == float(digits.quantize(Decimal(1), ROUND_HALF_UP)) / 100, (n, d)


def test_groups_add_up_and_are_ordered(claims):
    whole = agg_tat(claims, *PERIOD).head()
    rows = agg_tat(claims, *PERIOD, ["diagnosis", "igo_nigo"]).collect()
    keys = [(r.diagnosis, r.igo_nigo) for r in rows]
    assert keys == sorted(keys)
    for part in ("count_of_claims", "count_tat_over_5_days", "count_tat_over_10_days"):
        assert sum(r[part] for r in rows) == whole[part]


def test_drilldown_levels_agree_with_the_single_queries(claims):
    rows = agg_tat_drilldown(claims, *PERIOD).collect()
    assert [r.level for r in rows] == sorted(r.level for r in rows)
    for level in range(len(DRILL_DOWN) + 1):
        by = DRILL_DOWN[:level]
        single = [tuple(r) for r in agg_tat(claims, *PERIOD, by).collect()]
        drilled = [(*r[1:1 + level], *r[1 + len(DRILL_DOWN):]) for r in rows if r.level == level]
        assert drilled == single


def test_drilldown_tells_null_keys_from_levels(claims_of):
    rows = agg_tat_drilldown(claims_of({"claims_analyst": None}, {}), *PERIOD,
                             by=["claims_analyst"]).collect()
    assert [(r.level, r.claims_analyst, r.count_of_claims) for r in rows] == [
        (0, None, 2), (1, None, 1), (1, "Paul King", 1)]


def test_empty_period(claims_of):
    claims = claims_of({})
    tat = agg_tat(claims, "2019-12-01", "2019-12-02").collect()
    assert [tuple(r) for r in tat] == [(0, None, None, None, None, None)]
    gen = agg_gen(claims, "2019-12-01", "2019-12-02").head()
    assert gen.count_of_claims == gen.total_nigo_count == 0
    assert gen.avg_tat is gen.percent_tat_over_5_days is gen.avg_nigo_follow_up_days is None
    assert agg_tat(claims, "2019-12-01", "2019-12-02", ["geo"]).count() == 0


def test_period_includes_both_ends(claims_of):
    claims = claims_of({"decided_2_date": date("2020-01-01")}, {"decided_2_date": date("2020-01-31")},
                       {"decided_2_date": date("2020-02-01")})
    assert agg_tat(claims, "2020-01-01", "2020-01-31").head().count_of_claims == 2


def test_percentages_round_in_tat_and_are_cut_in_gen(claims_of):
    claims = claims_of({}, {}, {"over_five_biz_days": 0, "over_ten_biz_days": 0})
    assert agg_tat(claims, *PERIOD).head().percent_tat_over_5_days == 66.67
    assert agg_gen(claims, *PERIOD).head().percent_tat_over_5_days == 66


def test_null_group_key_counts_no_nigo(claims_of):
    claims = claims_of({"diagnosis": None}, {"diagnosis": None}, {"diagnosis": "Nervous"})
    rows = {r.diagnosis: r for r in agg_gen(claims, *PERIOD, ["diagnosis"]).collect()}
    assert rows[None].total_nigo_count == 0
    assert rows[None].avg_nigo_follow_up_days == 6000.0
    assert rows["Nervous"].total_nigo_count == 1
    assert rows["Nervous"].avg_nigo_follow_up_days == 3.0
    assert agg_gen(claims, *PERIOD).head().total_nigo_count == 3


def test_hours(claims_of):
    claims = claims_of({}, {"total_claims_analyst_hours": None}, {"total_claims_analyst_hours": 1.25})
    row = agg_gen(claims, *PERIOD).head()
    assert (row.total_analyst_hours, row.avg_analyst_hours) == (3.75, 1.88)


def test_arguments(claims_of):
    claims = claims_of({})
    for query in (agg_tat, agg_gen, agg_tat_drilldown):
        with pytest.raises(ValueError, match="before it starts"):
            query(claims, "2020-02-02", "2020-02-01")
        with pytest.raises(ValueError, match="cannot group by salary"):
            query(claims, *PERIOD, ["salary"])
        with pytest.raises(ValueError, match="not between"):
            query(claims, *PERIOD, allowed=("2020-01-02", "2020-03-01"))
