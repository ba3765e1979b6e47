"""What writes cost: batches read alone, key lookups by range and in one job, files one by one."""

import threading

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from claimspan.schemas import CLAIMS_WITH_DURATIONS
from claimspan.sources import key_digests, tables, versions
from claimspan.sources.tables import append_stage, has_value, read_stage, write_stage
from harness.registry import shared_path


def batch(claims_of, *keys):
    return claims_of(*({"claim_num": key} for key in keys))


def test_a_table_by_column_reads_one_value_alone(spark, claims_of):
    path = shared_path(spark, "by_column")
    claims = claims_of(*({"claim_num": n, "total_biz_days": n % 3 or None} for n in range(30)))
    write_stage(claims, path, CLAIMS_WITH_DURATIONS, by_column="total_biz_days")
    stored = read_stage(spark, path, CLAIMS_WITH_DURATIONS)
    assert stored.drop("total_biz_days_part").exceptAll(claims).isEmpty() and stored.count() == 30
    for n in (1, 2):
        found = stored.where(has_value(stored, "total_biz_days", n))
        assert {r.claim_num % 3 for r in found.collect()} == {n} and found.count() == 10
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "(total_biz_days_part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert claims.where(has_value(claims, "total_biz_days", 2)).count() == 10
    for wrong in ({"by_column": "geo"}, {"by_column": "claim_num", "by_open_interval": True}):
        with pytest.raises(ValueError):
            write_stage(claims, path, CLAIMS_WITH_DURATIONS, **wrong)


def test_keys_out_of_range_are_not_looked_up(spark):
    """Of so many keys a filter holds some by mistake; the ends of a partition's keys tell."""
    folder = shared_path(spark, "digest")
    rows = spark.range(3_000).selectExpr("int(id % 3) as copy", "id * 7 as k", "int(id % 2) as half")
    key_digests.write_digest(rows, ("copy", "k"), ["half"], folder)

    def found(keys):
        return key_digests.colliding_parts(
            spark, keys.selectExpr("int(copy) as copy", "k"), ("copy", "k"), {"s": folder}, ["half"])

    assert found(rows.withColumn("copy", F.lit(3))) == {}
    assert found(spark.range(30_000).selectExpr("1 as copy", "id + 30000 as k")) == {}
    assert found(rows.limit(0)) == {}
    assert sorted(found(rows)["s"]) == [("0",), ("1",)]
    for one in rows.where("k in (0, 21, 20993)").collect():
        assert (str(one.half),) in found(spark.createDataFrame([one]))["s"]


def test_an_append_looks_up_keys_in_one_job_for_all_segments(spark, claims_of, monkeypatch):
    path, tracker = shared_path(spark, "segments"), spark.sparkContext.statusTracker()
    write_stage(batch(claims_of, 0), path, CLAIMS_WITH_DURATIONS, key="claim_num",
                by_open_interval=True)
    part = tuple(str(read_stage(spark, path, CLAIMS_WITH_DURATIONS).first()[name])
                 for name in ("open_level", "open_block"))
    # At size every partition seems to hold one of a batch's keys.
    monkeypatch.setattr(tables, "colliding_parts", lambda _spark, _keys, _key, digests, _parts: {
        data: [part] for data in digests})

    def jobs(*keys):
        group = f"append {keys}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            append_stage(batch(claims_of, *keys), path, CLAIMS_WITH_DURATIONS, "claim_num")
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    counted = [jobs(n) for n in range(1, 5)]
    assert counted[0] > 0 and max(counted[1:]) == counted[1] <= counted[0] + 1
    for n in (0, 2, 4):
        with pytest.raises(ValueError, match=f"duplicate key claim_num, for example .*{n}"):
            jobs(10, n)
    assert read_stage(spark, path, CLAIMS_WITH_DURATIONS).count() == 5


def test_months_are_written_file_by_file(spark, claims_of, monkeypatch):
    """Rows that go to another of dozens of open files each take several times as long."""
    setting, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before, write = spark.conf.get(setting), DataFrameWriter.parquet

    def spy(writer, *args, **options):
        seen.append(spark.conf.get(setting))
        return write(writer, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    days = F.expr("date_add(date '2020-01-01', int(claim_num * 37 % 900))")
    claims = batch(claims_of, *range(120)).withColumn("decided_2_date", days).coalesce(1)
    for layout, told in (("by_decided_month", "0"), ("by_open_interval", str(tables.OPEN_FILES))):
        path = shared_path(spark, layout)
        write_stage(claims, path, CLAIMS_WITH_DURATIONS, **{layout: True})
        assert seen.pop() == told and not seen and spark.conf.get(setting) == before
        stored = read_stage(spark, path, CLAIMS_WITH_DURATIONS)
        parts = [c for c in stored.columns if c not in claims.columns]
        assert stored.drop(*parts).exceptAll(claims).isEmpty() and stored.count() == 120
        assert len(stored.inputFiles()) == stored.select(parts).distinct().count()


def test_only_one_of_two_writers_makes_a_pointer(spark, tmp_path):
    """Many races, as Hadoop looked for a file on a local disk before it made it."""
    for n in range(40):
        start, made = threading.Barrier(2), []

        def make(i, name=f"{tmp_path}/{n}/pointer", start=start, made=made):
            start.wait()
            try:
                versions._create(spark, name, f"writer {i}\n")
                made.append(i)
            except Exception:
                pass

        threads = [threading.Thread(target=make, args=(i,)) for i in range(2)]
        for thread in threads:
            thread.start()
        for thread in threads:
            thread.join()
        assert len(made) == 1
        assert (tmp_path / str(n) / "pointer").read_text() == f"writer {made[0]}\n"
