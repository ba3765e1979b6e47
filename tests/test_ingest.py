import pytest
from pyspark.sql import functions as F

from claimspan.constants import ANALYST_PARAMETERS, DIAGNOSIS_PARAMETERS
from claimspan.operators.cleaning import clean_name, clean_names, drop_recomputed, fill_missing
from claimspan.operators.decisioning import extend_claims
from claimspan.operators.replication import replicate_claims
from claimspan.schemas import ANALYST_PARAMS, CLAIMS_EXTENDED, DIAGNOSIS_PARAMS
from claimspan.sources.csv_inputs import (
    analyst_parameters, diagnosis_parameters, read_claims_export, read_parameters,
)
from claimspan.sources.tables import conform
from support import SF
from harness import derived


@pytest.mark.parametrize("header, name", [
    ("Claim #", "claim_num"),
    ("TAT > 7 days", "tat_gt_7_days"),
    ("Nurse/No nurse", "nurse__no_nurse"),
    ("$ Cost per hour", "dollar_cost_per_hour"),
    ("Total $", "totaldollar"),
    (" Follow-up", "follow_up"),
    ("Cases'", "cases"),
    ("Ends   ", "ends"),
    ("Ends    ", "ends_"),
    ("Customer srevice - for", "customer_service__for"),
    ("_c8", "unnamed:_8"),
])
def test_clean_name(header, name):
    assert clean_name(header) == name


def test_canonical_names_ignore_missing_columns(spark):
    frame = spark.createDataFrame([(1, "a")], ["Date Received", "Other"])
    assert clean_names(frame).columns == ["received_date", "other"]


def test_dropping_requires_all_columns(spark):
    with pytest.raises(ValueError, match="loss_ratio"):
        drop_recomputed(spark.createDataFrame([(1,)], ["total"]))


def test_header_without_a_name(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text("Claim #,,Total\n1,x,2\n")
    assert clean_names(read_claims_export(spark, str(path))).columns == [
        "claim_num", "unnamed:_1", "total"]


def test_fill_missing_keeps_nurse_hours_null(spark):
    schema = ("nigo_following_up_hours double, deciding_1_hours double, "
              "nurse_reviewing_hours double, deciding_2_hours double, accurate_decision int, "
              "wrongly_approved int, wrongly_declined int, nigo_followed_up_mode string, "
              "dollar_cost_per_hour string")
    rows = [(None,) * 8 + (" $42 ",), (1.0, 2.0, 3.0, 4.0, 1, 0, 0, "Call", "17")]
    got = fill_missing(spark.createDataFrame(rows, schema)).collect()
    assert tuple(got[0]) == (0.0, 0.0, None, 0.0, 0, 0, 0, "N/A", 42.0)
    assert tuple(got[1]) == (1.0, 2.0, 3.0, 4.0, 1, 0, 0, "Call", 17.0)


def test_other_cost_spellings_fail(spark):
    frame = derived.raw_claims(spark, SF, dims=False).limit(1)
    odd = frame.withColumn("dollar_cost_per_hour", F.lit("$42"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        fill_missing(odd).select("dollar_cost_per_hour").collect()


def test_parameter_files_with_byte_order_mark(spark, tmp_path):
    def write(name, schema, rows):
        lines = [",".join(schema.names)]
        lines += [",".join("" if cell is None else str(cell) for cell in row) for row in rows]
        path = tmp_path / name
        path.write_text("\n".join(lines), encoding="utf-8-sig")
        return str(path)

    analysts = write("analysts.csv", ANALYST_PARAMS, ANALYST_PARAMETERS)
    diagnoses = write("diagnoses.csv", DIAGNOSIS_PARAMS, DIAGNOSIS_PARAMETERS)
    for path, schema, literal in ((analysts, ANALYST_PARAMS, analyst_parameters(spark)),
                                  (diagnoses, DIAGNOSIS_PARAMS, diagnosis_parameters(spark))):
        read = read_parameters(spark, path, schema)
        assert sorted(read.collect()) == sorted(literal.collect())
        assert read.columns == schema.names


def test_null_hours_make_total_hours_null(spark, calendar):
    extended = derived.claims_extended(spark, SF, dims=False)
    nulls = extended.where("nurse_reviewing_hours is null")
    assert nulls.count() > 0
    assert nulls.where("total_hours is not null or total_claims_analyst_hours is null").count() == 0


def test_late_flags_start_after_five_and_ten_days(spark):
    got = derived.claims_extended(spark, SF, dims=False).groupBy("total_biz_days").agg(
        F.collect_set("over_five_biz_days"), F.collect_set("over_ten_biz_days")).collect()
    assert {5, 6, 10, 11} <= {days for days, *_ in got}
    for days, five, ten in got:
        assert (five, ten) == ([int(days > 5)], [int(days > 10)])


def test_replication_keeps_durations_and_shifts_dates(spark, calendar):
    extended = derived.claims_extended(spark, SF)
    copies = replicate_claims(extended, calendar, copies=2, key_stride=100_000)
    assert copies.count() == 3 * extended.count()
    raw = copies.drop("received_date").withColumnRenamed("intake_decided_date", "received_date")
    again = conform(extend_claims(raw, calendar), CLAIMS_EXTENDED)
    assert conform(copies, CLAIMS_EXTENDED).exceptAll(again).isEmpty()
    moved = copies.where("claim_num = 200007").head()
    first = extended.where("claim_num = 7").head()
    assert moved.decided_2_date == calendar.offset_date(first.decided_2_date, 30)
    assert moved.customer_num == first.customer_num + 200_000
    assert moved.diagnosis == first.diagnosis


def test_originals_off_business_days_are_not_rolled(spark, calendar, claims_of):
    from support import date
    saturday = claims_of({"received_date": date("2020-01-04"), "customer_num": 5})
    got = {r.claim_num: r.received_date
           for r in replicate_claims(saturday, calendar, copies=1).collect()}
    assert got == {1: date("2020-01-04"), 100_001: calendar.offset_date("2020-01-04", 15)}
