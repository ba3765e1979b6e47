"""Tables by open interval: what a question about a day reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimspan.constants import MILESTONES
from claimspan.plans import aggregates, counts
from claimspan.plans.inventory import inventory, inventory_by
from claimspan.schemas import CLAIMS_WITH_DURATIONS
from claimspan.sources.tables import (
    OPEN_BLOCK, OPEN_LEVEL, conform, dated_between, decided_from, open_interval, open_on,
    read_stage, write_stage,
)
from harness import derived
from harness.registry import CLAIMS_QUERIES, shared_path
from support import SF

DATES = (*MILESTONES, "return_to_work_date")
MONTHS = 96


@pytest.fixture(scope="module")
def eight_years(spark):
    """The derived claims, moved by whole months to lie all over eight years."""
    claims = conform(derived.claims_with_durations(spark, SF, dims=False).withColumns(
        {c: F.lit(None).cast("string") for c in ("geo", "industry")}), CLAIMS_WITH_DURATIONS)
    months = F.col("claim_num").cast("int") % MONTHS - MONTHS // 2
    claims = claims.where("claim_num < 1000000").withColumns(
        {c: F.add_months(c, months) for c in DATES})
    path = shared_path(spark, "plain")
    claims.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def by_block(spark, eight_years):
    path = shared_path(spark, "by_block")
    write_stage(eight_years, path, CLAIMS_WITH_DURATIONS, by_open_interval=True)
    return read_stage(spark, path, CLAIMS_WITH_DURATIONS)


def partitions_read(spark, df):
    """By the scan's own metric, after the query ran."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df._jdf.collectToPython()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return [leaves.apply(i).metrics().apply("numPartitions").value()
                for i in range(leaves.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def day_after(months):
    return dt.date(2015 + (10 + months) // 12, (10 + months) % 12 + 1, 15)


@pytest.mark.parametrize("months", [1, 24, 49, 70, 92])
def test_a_day_reads_a_block_a_level(spark, by_block, eight_years, months):
    day = day_after(months)
    every = by_block.select(OPEN_LEVEL, OPEN_BLOCK).distinct()
    levels = every.select(OPEN_LEVEL).distinct().count()
    read = partitions_read(spark, inventory(by_block, day))
    assert len(read) == 1 and read[0] <= levels <= 9 and every.count() > 100
    assert inventory(by_block, day).collect() == inventory(eight_years, day).collect()
    rows = by_block.where(open_on(by_block, day)).count()
    assert rows < eight_years.count() / 3


def test_a_period_reads_what_overlaps_it(spark, by_block, eight_years):
    start, end = day_after(40), day_after(42)
    df = aggregates.agg_tat(by_block, start, end, ["claims_analyst"])
    assert partitions_read(spark, df)[0] < 30
    assert df.collect() == aggregates.agg_tat(eight_years, start, end,
                                              ["claims_analyst"]).collect()


@pytest.mark.parametrize("key", [k for k in CLAIMS_QUERIES if "geo" not in k])
def test_every_query_agrees(spark, by_block, eight_years, key):
    query = CLAIMS_QUERIES[key]
    assert query(by_block).collect() == query(eight_years).collect()


def test_blocks_hold_their_claims(by_block):
    """Each claim's months lie in its block, and not in one half of it."""
    first, last = (12 * F.year(f(*DATES)) + F.month(f(*DATES)) - 1
                   for f in (F.least, F.greatest))
    size = F.pow(F.lit(2), OPEN_LEVEL).cast("long")
    inside = (F.floor(first / size) == F.col(OPEN_BLOCK)) & (
        F.floor(last / size) == F.col(OPEN_BLOCK))
    half = F.floor(size / 2)
    least = F.when(F.col(OPEN_LEVEL) == 0, True).otherwise(
        F.floor(first / half) != F.floor(last / half))
    assert by_block.where(~(inside & least)).isEmpty()
    assert by_block.count() > 0


def test_irregular_claims(spark, claims_of):
    """Dates out of order, missing dates, one month, no date: no condition loses a claim."""
    day = dt.date.fromisoformat
    none = {name: None for name in DATES}
    odd = claims_of(
        {}, none, {**none, "received_date": day("2020-01-05")},
        {"decided_1_date": day("2021-01-01")}, {"decided_2_date": day("2019-12-01")},
        {"received_date": day("1969-12-31"), "return_to_work_date": day("2040-02-29")},
        {"nurse_reviewed_date": day("2020-12-31"), "decided_2_date": None})
    path = shared_path(spark, "odd")
    write_stage(odd, path, CLAIMS_WITH_DURATIONS, by_open_interval=True)
    stored = read_stage(spark, path, CLAIMS_WITH_DURATIONS)
    assert stored.count() == 7
    assert stored.where("open_level is null").count() == 1
    for when in ("1969-12-31", "2019-12-01", "2020-01-07", "2020-02-15", "2021-03-01"):
        assert inventory(stored, when).collect() == inventory(odd, when).collect()
        assert inventory_by(stored, when, ["igo_nigo"]).collect() == inventory_by(
            odd, when, ["igo_nigo"]).collect()
        assert counts._count(stored, F.col("decided_2_date") >= when, decided_from(
            stored, when)).collect() == counts._count(odd, F.col("decided_2_date") >= when).collect()
        any_date = F.greatest(*(F.col(c).between(when, "2021-12-31").cast("int") for c in DATES))
        assert stored.where(any_date == 1).count() == stored.where(
            (any_date == 1) & dated_between(stored, when, "2021-12-31")).count()


def test_blocks_of_known_months(spark):
    rows = spark.createDataFrame(
        [("2020-01-31", "2020-01-01"), ("2020-01-31", "2020-02-01"), ("2019-12-31", "2020-01-01"),
         ("0001-01-01", "9999-12-31")], "a string, b string")
    dated = rows.select(*[F.col("a" if i else "b").cast("date").alias(c)
                          for i, c in enumerate(DATES)])
    got = [tuple(r) for r in dated.select(*[c.alias(n) for n, c in open_interval().items()])
           .collect()]
    month = 2020 * 12
    assert got == [(0, month), (1, month // 2), (5, (month - 1) // 32), (17, 0)]


def test_one_layout_only(claims_of):
    with pytest.raises(ValueError, match="one layout"):
        write_stage(claims_of({}), "/nowhere", CLAIMS_WITH_DURATIONS, by_decided_month=True,
                    by_open_interval=True)
