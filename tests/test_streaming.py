"""Streams equal their batch twins, and late data is dropped after the watermark."""

from __future__ import annotations

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.latest import latest
from ledgerloom.sources.lake import Lake
from ledgerloom.sources.landing import SCHEMAS
from ledgerloom.streaming.jobs import Merged, arriving, cdc_latest, dq_monitor, fraud_tumbling, instant, sessions, velocity_sliding, wall


def drop_file(spark, folder, n, rows):
    """One landing file, older files first."""
    df = spark.createDataFrame(rows, SCHEMAS["events"]).coalesce(1).toPandas()
    os.makedirs(f"{folder}/events.parquet", exist_ok=True)
    path = f"{folder}/events.parquet/part-{n}.parquet"
    df.to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
    os.utime(path, (time.time() - 1000 + n, time.time() - 1000 + n))


def event(i, ts, kind="error"):
    return (i, ts, i % 3, kind, float(i), '{"k": 1}')


def test_late_rows_are_dropped(spark, tmp_path):
    day = datetime(2024, 1, 1)
    drop_file(spark, tmp_path, 0, [event(8, day + timedelta(hours=1)), event(16, day + timedelta(hours=2))])
    drop_file(spark, tmp_path, 1, [event(24, day + timedelta(days=2))])
    # late rows are judged by the watermark of the batch before, so it takes one more batch to close the day
    drop_file(spark, tmp_path, 2, [event(48, day + timedelta(days=2, minutes=5))])
    drop_file(spark, tmp_path, 3, [event(32, day + timedelta(hours=3)), event(40, day + timedelta(days=5))])
    lake = Lake(spark, str(tmp_path))
    stream = arriving(lake, "events", files_per_trigger=1)
    got = {r.day_start: r.alerts for r in fraud_tumbling(lake, stream).collect()}
    # event 32 belongs to the first day but comes after the watermark has passed it
    assert got == {day: 2, day + timedelta(days=2): 2}


def test_micro_batches_equal_one_batch(spark, lake, tmp_path):
    rows = [tuple(r) for r in lake.raw("events").orderBy("ts").collect()]
    step = len(rows) // 4
    for n in range(4):
        drop_file(spark, tmp_path, n, rows[n * step: (n + 1) * step])
    split = Lake(spark, str(tmp_path))
    stream = arriving(split, "events", files_per_trigger=1)
    once = {tuple(r) for r in dq_monitor(lake).collect()}
    assert {tuple(r) for r in dq_monitor(split, stream).collect()} == once


def test_cdc_over_many_batches_equals_latest(spark, lake, tmp_path):
    raw = lake.raw("lineitem")
    raw.repartition(5, "l_partkey").write.parquet(f"{tmp_path}/feed")
    feed = spark.readStream.schema(SCHEMAS["lineitem"]).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    expected = latest(raw, ["l_orderkey", "l_linenumber"], "l_shipdate", ("l_partkey", "l_suppkey"))
    got = cdc_latest(lake, feed)
    assert got.count() == expected.count()
    assert got.exceptAll(expected).isEmpty()


def test_file_and_folder_landings_give_the_same(spark, lake, tmp_path):
    lake.raw("events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    folder = Lake(spark, str(tmp_path))
    for job in (dq_monitor, velocity_sliding, sessions, fraud_tumbling):
        assert sorted(map(str, job(folder).collect())) == sorted(map(str, job(lake).collect())) != []


def test_missing_landing_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        dq_monitor(Lake(spark, str(tmp_path)))


def test_later_run_processes_new_files_only(spark, tmp_path):
    day = datetime(2024, 1, 1)
    at = str(tmp_path / "job")
    lake = Lake(spark, str(tmp_path))
    drop_file(spark, tmp_path, 0, [event(8, day), event(16, day + timedelta(days=2))])
    assert {r.day_start for r in dq_monitor(lake, folder=at).collect()} == {day}
    assert dq_monitor(lake, folder=at).count() == 1
    drop_file(spark, tmp_path, 1, [event(24, day + timedelta(days=4))])
    assert sorted(r.day_start for r in dq_monitor(lake, folder=at).collect()) == [day, day + timedelta(days=2)]


def test_cdc_merges_into_one_table(spark, lake, tmp_path):
    raw = lake.raw("lineitem")
    parts = raw.randomSplit([0.5, 0.3, 0.2], seed=1)
    target = f"{tmp_path}/lineitem.parquet"
    fed = Lake(spark, str(tmp_path))
    for n, part in enumerate(parts):
        part.write.mode("append").parquet(target)
        rows = cdc_latest(fed, folder=f"{tmp_path}/job")
        expected = latest(spark.read.schema(SCHEMAS["lineitem"]).parquet(target), ["l_orderkey", "l_linenumber"], "l_shipdate", ("l_partkey", "l_suppkey"))
        assert rows.count() == expected.count() and rows.exceptAll(expected).isEmpty()


def test_a_registered_run_reads_what_lies_there_now(spark, tmp_path):
    day = datetime(2024, 1, 1)
    lake = Lake(spark, str(tmp_path))
    drop_file(spark, tmp_path, 0, [event(8, day), event(16, day + timedelta(days=2))])
    first = dq_monitor(lake).collect()
    assert [tuple(r) for r in dq_monitor(lake).collect()] == [tuple(r) for r in first] != []
    drop_file(spark, tmp_path, 0, [event(8, day), event(24, day), event(16, day + timedelta(days=2))])
    assert [r.rows_evaluated for r in dq_monitor(lake).collect()] == [2]


def test_a_merge_writes_what_a_batch_brings(spark, lake, tmp_path):
    def newest(rows):
        return latest(rows, ["l_orderkey", "l_linenumber"], "l_shipdate", ("l_partkey", "l_suppkey"))

    raw = lake.raw("lineitem").limit(4000).cache()
    table = Merged(lake, str(tmp_path), raw.schema, newest)
    table.merge(raw.where("l_orderkey % 2 = 0"), 0)
    table.merge(raw.where("l_orderkey % 2 = 1"), 1)
    assert table.parts() == (1, [])  # deltas beyond the base made a new one

    def written(name):
        return sum(os.path.getsize(f"{tmp_path}/current/{name}/{f}") for f in os.listdir(f"{tmp_path}/current/{name}"))

    for n in (2, 3, 4):
        table.merge(raw.limit(5).withColumn("l_shipdate", F.expr("timestamp_ntz '2030-01-01' + make_interval(0, 0, 0, " + str(n) + ")")), n)
        table.merge(raw.limit(5).withColumn("l_shipdate", F.expr("timestamp_ntz '2030-01-01' + make_interval(0, 0, 0, " + str(n) + ")")), n)  # again
        assert written(f"delta={n}") < written("base=1") / 10
    assert table.parts() == (1, [2, 3, 4])
    assert table.current().count() == newest(raw).count()
    assert table.current().where("l_shipdate > timestamp_ntz '2029-01-01'").select(F.dayofmonth("l_shipdate")).distinct().collect()[0][0] == 5


def test_instant_and_wall_do_not_depend_on_the_session_zone(spark):
    t = datetime(2024, 3, 10, 2, 30, 0, 123456)
    df = spark.createDataFrame([(t,)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            row = df.select(instant("t").alias("i")).select(wall("i").alias("t"), F.unix_micros("i").alias("u")).first()
            assert row.t == t
            assert row.u == 1710037800123456
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
