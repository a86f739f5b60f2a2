"""Streams of several batches: state and versions carry over from one to the next."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from quillon.streaming import jobs

SCHEMA = "k long, ts timestamp, v double"


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


BATCHES = [[(1, at(5), 1.0), (1, at(3), 9.0), (2, at(1), 2.0)], [(1, at(8), 3.0), (3, at(200), 4.0)], [(2, at(0), 7.0), (4, at(300), None)], [(2, at(0), 8.0)]]


@pytest.fixture
def stream(spark, tmp_path):
    for rows in BATCHES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are taken by age
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_upsert_keeps_newest_over_batches(stream):
    got = {r["k"]: r["v"] for r in jobs.upsert_stream(stream, ["k"], [F.desc("ts")], "latest").collect()}
    assert got == {1: 3.0, 2: 2.0, 3: 4.0, 4: None}


def test_a_job_goes_on_in_its_folder(spark, tmp_path):
    def latest():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        return {r["k"]: r["v"] for r in jobs.upsert_stream(stream, ["k"], [F.desc("ts")], "latest", str(tmp_path / "job")).collect()}

    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(BATCHES[0])
    assert latest() == {1: 1.0, 2: 2.0}
    assert latest() == {1: 1.0, 2: 2.0}  # nothing new
    add(BATCHES[1])
    assert latest() == {1: 3.0, 2: 2.0, 3: 4.0}


def test_state_counts_over_batches(stream):
    rows = jobs.run(jobs.count_and_last(stream.where("v IS NOT NULL"), "k", "ts", F.col("v")), "last").collect()
    got = {}
    for r in rows:
        got[r["k"]] = max(got.get(r["k"], (0, None)), (r["n"], r["last"]))
    assert got == {1: (3, 3.0), 2: (3, 2.0), 3: (1, 4.0)}


def test_late_rows_miss_closed_windows(stream):
    got = {(r["window_start"], r["k"]): r["n"] for r in jobs.run(jobs.window_counts(stream, "ts", "k", "1 hour", "10 minutes"), "windows").collect()}
    assert sorted(n for (_, k), n in got.items() if k == 1) == [3]
    assert sorted(n for (_, k), n in got.items() if k == 2) == [2]  # a batch's watermark drops rows from the batch after next on: the fourth's is late
    assert not [k for _, k in got if k == 4]  # its window is open


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none"))
    assert jobs.upsert_stream(stream, ["k"], [F.desc("ts")], "latest").count() == 0
    assert jobs.run(jobs.count_and_last(stream, "k", "ts", F.col("v")), "last").count() == 0


@pytest.mark.parametrize("name", ["stream_latest", "stream_window_counts", "stream_first_within", "stream_count_and_last"])
def test_table_of_part_files_gives_what_one_file_gives(spark, tmp_path, name):
    from quillon.plans.registry import QUERIES

    one = "/root/testdata/sf0.001"
    spark.read.parquet(f"{one}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want = sorted(map(str, QUERIES[name](spark, one).collect()))
    assert want and sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect())) == want
