"""Replacing and appending: what is seen when a writer stops, fails or loses a race."""

import threading

import pytest
from pyspark.sql import functions as F

from claimspan.schemas import CLAIMS_WITH_DURATIONS
from claimspan.sources import key_digests, tables, versions
from claimspan.sources.tables import append_stage, read_stage, write_stage
from harness.registry import shared_path


@pytest.fixture()
def path(spark):
    return shared_path(spark, "versions")


def numbers(spark, path):
    rows = read_stage(spark, path, CLAIMS_WITH_DURATIONS).select("claim_num").collect()
    return sorted(r.claim_num for r in rows)


def batch(claims_of, *keys):
    return claims_of(*({"claim_num": key} for key in keys))


class Stopped(BaseException):
    """A writer that is gone, not one that fails and cleans up."""


@pytest.mark.parametrize("append,step", [(False, "rows"), (False, "half a pointer"),
                                         (True, "keys"), (True, "pointer")])
def test_a_writer_that_stops_leaves_the_table(spark, claims_of, path, monkeypatch, step, append):
    def change(*keys):
        if append:
            append_stage(batch(claims_of, *keys), path, CLAIMS_WITH_DURATIONS, "claim_num")
        else:
            write_stage(batch(claims_of, *keys), path, CLAIMS_WITH_DURATIONS, key="claim_num")

    def stop(*_args, **_kwargs):
        raise Stopped

    def half(spark, name, text):
        create(spark, name, text[:len(text) // 2])
        raise Stopped

    write_stage(batch(claims_of, 1, 2), path, CLAIMS_WITH_DURATIONS, key="claim_num")
    create = versions._create
    with monkeypatch.context() as m:
        m.setattr(tables, "delete", lambda *_: None)  # nobody is left to clean up
        if step == "rows":
            m.setattr(tables, "_require_keys" if append else "require_unique", stop)
        elif step == "keys":
            m.setattr(tables, "write_digest", stop)
        else:
            m.setattr(versions, "_create", stop if step == "pointer" else half)
        with pytest.raises(Stopped):
            change(3, 4)
    assert numbers(spark, path) == [1, 2]
    change(3, 4)  # the next writer isn't in the way of what is left
    assert numbers(spark, path) == ([1, 2, 3, 4] if append else [3, 4])


def test_readers_keep_what_they_resolved(spark, claims_of, path):
    write_stage(batch(claims_of, 1, 2), path, CLAIMS_WITH_DURATIONS, key="claim_num")
    before = read_stage(spark, path, CLAIMS_WITH_DURATIONS)
    append_stage(batch(claims_of, 3), path, CLAIMS_WITH_DURATIONS, "claim_num")
    write_stage(batch(claims_of, 9), path, CLAIMS_WITH_DURATIONS)
    assert before.count() == 2 and numbers(spark, path) == [9]


def test_the_second_of_two_writers_fails(spark, claims_of, path):
    write_stage(batch(claims_of, 1), path, CLAIMS_WITH_DURATIONS, key="claim_num")
    base, won, lost = versions.current(spark, path), [], []

    def race(i):
        try:
            versions.publish(spark, path, base, "", (*base.segments, versions.Segment(f"data-{i}")))
            won.append(i)
        except RuntimeError as error:
            lost.append(str(error))

    threads = [threading.Thread(target=race, args=(i,)) for i in range(2)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(won) == 1 and "another writer" in lost[0]


def test_old_versions_expire(spark, claims_of, path):
    for i in range(4):
        write_stage(batch(claims_of, i), path, CLAIMS_WITH_DURATIONS, key="claim_num")
    append_stage(batch(claims_of, 9), path, CLAIMS_WITH_DURATIONS, "claim_num")
    assert [v.number for v in versions.versions(spark, path)] == [5, 4, 3, 2, 1]
    gone = versions.expire(spark, path, keep=2)
    assert len(gone) == 6  # rows and keys of three versions; the last one's are in the newest
    assert [v.number for v in versions.versions(spark, path)] == [5, 4]
    assert numbers(spark, path) == [3, 9] and versions.expire(spark, path) == []
    with pytest.raises(ValueError):
        versions.expire(spark, path, keep=0)


LAYOUTS = [{}, {"by_open_interval": True}]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_append_aligns_by_name_and_fills(spark, claims_of, path, layout):
    write_stage(batch(claims_of, 1), path, CLAIMS_WITH_DURATIONS, key="claim_num", **layout)
    more = claims_of({"claim_num": 2, "geo": "ASIA"}, {"claim_num": 3, "decided_2_date": None})
    turned = more.select(*reversed(more.columns)).drop("industry", "diagnosis")
    append_stage(turned, path, CLAIMS_WITH_DURATIONS, "claim_num")
    rows = {r.claim_num: r for r in read_stage(spark, path, CLAIMS_WITH_DURATIONS).collect()}
    assert sorted(rows) == [1, 2, 3]
    assert (rows[2].geo, rows[2].diagnosis, rows[1].diagnosis) == ("ASIA", None, "Nervous")
    assert rows[2].received_date == rows[1].received_date and rows[3].decided_2_date is None


@pytest.mark.parametrize("layout", LAYOUTS)
def test_append_refuses_what_it_must(spark, claims_of, path, layout):
    write_stage(batch(claims_of, 1, 2), path, CLAIMS_WITH_DURATIONS, key="claim_num", **layout)
    append_stage(batch(claims_of, 3), path, CLAIMS_WITH_DURATIONS, "claim_num")
    other = claims_of({"claim_num": 4}, {"claim_num": 2}).withColumn(  # in another month
        "decided_2_date", F.lit("2021-05-05").cast("date"))
    for bad, message in ((other, "duplicate key claim_num, for example .*2"),
                         (batch(claims_of, 5, 3), "duplicate key"),
                         (batch(claims_of, 6, 6), "duplicate key"),
                         (batch(claims_of, 7, None), "must not be null"),
                         (batch(claims_of, 8).drop("claim_num"), "missing columns: claim_num"),
                         (batch(claims_of, 8).withColumn("x", F.lit(1)), "unknown columns: x")):
        with pytest.raises(ValueError, match=message):
            append_stage(bad, path, CLAIMS_WITH_DURATIONS, "claim_num")
        assert numbers(spark, path) == [1, 2, 3]
    append_stage(batch(claims_of, 9).where("false"), path, CLAIMS_WITH_DURATIONS, "claim_num")
    assert numbers(spark, path) == [1, 2, 3]


def test_append_needs_a_table_with_keys(spark, claims_of, path):
    with pytest.raises(ValueError, match="no table"):
        append_stage(batch(claims_of, 1), path, CLAIMS_WITH_DURATIONS, "claim_num")
    with pytest.raises(ValueError, match="no table"):
        read_stage(spark, path, CLAIMS_WITH_DURATIONS)
    write_stage(batch(claims_of, 1), path, CLAIMS_WITH_DURATIONS)
    with pytest.raises(ValueError, match="without a key"):
        append_stage(batch(claims_of, 2), path, CLAIMS_WITH_DURATIONS, "claim_num")


def test_digests_find_the_partitions_of_a_key(spark):
    """No key is missed; few partitions are named that don't hold one."""
    folder = shared_path(spark, "digests")
    rows = spark.range(40_000).selectExpr("id * 3 as k", "date_add(date '2020-01-01', "
                                          "int(id % 40) * 31) as month", "int(id % 2) as half")
    rows = rows.withColumn("month", F.when(F.col("k") % 7 > 0, F.col("month")))
    key_digests.write_digest(rows, "k", ["month", "half"], folder)
    told = {(r[0], r[1]): (r.n_keys, r.hash_sum)
            for r in key_digests.summaries(spark, folder).collect()}
    counts = {(None if r.month is None else str(r.month), str(r.half)): r["count"]
              for r in rows.groupBy("month", "half").count().collect()}
    assert {part: n for part, (n, _) in told.items()} == counts
    for k in (0, 21, 300, 119_997):
        found = key_digests.colliding_parts(
            spark, spark.createDataFrame([(k,)], "k long"), "k", {"s": folder}, ["month", "half"])
        row = rows.where(F.col("k") == k).first()
        assert (None if row.month is None else str(row.month), str(row.half)) in found["s"]
        assert len(found["s"]) <= 8
    new = spark.range(2_000).selectExpr("id * 3 + 1 as k")
    hits = sum(len(key_digests.colliding_parts(
        spark, new.where(F.col("k") == k), "k", {"s": folder}, ["month", "half"]).get("s", []))
        for k in (1, 301, 1501))
    assert hits <= 12


def test_append_reads_only_partitions_that_may_hold_a_key(spark, claims_of, path, monkeypatch):
    days = [f"20{y}-{m:02d}-15" for y in (18, 19, 20, 21) for m in range(1, 13)]
    old = claims_of(*({"claim_num": n} for n in range(len(days)))).withColumn(
        "decided_2_date", F.element_at(F.array(*[F.lit(d).cast("date") for d in days]),
                                       F.col("claim_num").cast("int") + 1))
    write_stage(old, path, CLAIMS_WITH_DURATIONS, key="claim_num", by_decided_month=True)
    asked = {}

    def spy(*args):
        asked.update(key_digests.colliding_parts(*args))
        return asked

    monkeypatch.setattr(tables, "colliding_parts", spy)
    append_stage(batch(claims_of, 1_000_001), path, CLAIMS_WITH_DURATIONS, "claim_num")
    assert sum(map(len, asked.values())) <= 5  # of 48
    with pytest.raises(ValueError, match="duplicate key"):
        append_stage(batch(claims_of, 17), path, CLAIMS_WITH_DURATIONS, "claim_num")
    assert 1 <= sum(map(len, asked.values())) <= 6
