"""Streams with timers against their batch twins, with late and tied rows."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorops.operators import logs, records
from floorops.streaming import timers

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def ran(spark, tmp_path, ddl, batches, job, name):
    """All rows that a stream gives for files that come one after the other."""
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
        part.rename(src / f"{i}.parquet")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name).collect()


CHAT = "channel string, user string, ts timestamp, tie long, closes boolean"


def test_a_good_rating_ends_the_session(spark):
    rows = [("c", "u", at(0), 1, False), ("c", "u", at(60), 2, True), ("c", "u", at(90), 3, False), ("c", "u", at(100), 4, None), ("c", "v", at(0), 5, False), ("c", "v", at(9), 6, False)]
    rows += [("d", "u", at(0), 7, True), ("d", "u", at(0), 8, False), ("d", "u", at(700), 9, True), ("d", "u", at(701), 10, False), ("d", "u", at(701), 11, True), ("d", "u", at(701), 12, True)]
    got = logs.sessionize(spark.createDataFrame(rows, CHAT), 600, "tie", F.col("closes")).select("channel", "user", "start", "last", "n", "closed").collect()
    want = [("c", "u", at(0), at(0), 1, True), ("c", "u", at(90), at(100), 2, False), ("c", "v", at(0), at(9), 2, False), ("d", "u", at(0), at(0), 1, False), ("d", "u", at(701), at(701), 1, True)]
    assert sorted(map(tuple, got)) == want


def test_rated_sessions_stream_equals_batch(rocks, tmp_path):
    rng = np.random.default_rng(7)
    rows = [("c", f"u{rng.integers(0, 3)}", at(float(rng.integers(0, 40)) * 150), i, bool(rng.random() < 0.25)) for i in range(150)]
    late = sorted(range(150), key=lambda i: rows[i][2].timestamp() + float(rng.integers(0, 3000)))  # up to 50 minutes late
    batches = [[rows[i] for i in late[k : k + 30]] for k in range(0, 150, 30)] + [[("end", "x", at(90_000), 999, False)], [("end", "x", at(200_000), 1000, False)]]
    got = sorted(tuple(r) for r in ran(rocks, tmp_path, CHAT, batches, timers.stream_rated_sessions, "rated") if r["channel"] == "c")
    batch = logs.sessionize(rocks.createDataFrame(rows, CHAT), 600, "tie", F.col("closes"))
    assert got == sorted(map(tuple, batch.select("channel", "user", "start", "last", "n", "closed").collect()))
    assert {r[5] for r in got} == {True, False} and len(got) > 20


TASKS = "task_id long, status string, updated_at timestamp, created_at timestamp"


def test_both_deadlines_report_once(rocks, tmp_path):
    minute = lambda m: at(60 * m)
    batches = [
        [(1, "in_progress", minute(0), None), (2, "in_progress", minute(0), None), (3, "in_progress", None, minute(1)), (4, "pending", minute(0), None), (5, "in_progress", minute(0), None)],
        [(2, "done", minute(5), None), (5, "in_progress", minute(14), None)],
        [(9, "done", minute(20), None)],
        [(5, "in_progress", minute(21), None)],
        [(9, "done", minute(90), None)],
        [(1, "done", minute(95), None), (9, "done", minute(96), None)],
        [(9, "done", minute(200), None)],
        [(9, "done", minute(201), None)],
    ]
    got = sorted((r.task_id, r.since, r.minutes, r.idle_hours) for r in ran(rocks, tmp_path, TASKS, batches, timers.stream_stalled, "deadlines"))
    assert got == [(1, minute(0), 15, 0), (3, minute(1), 15, 0), (3, minute(1), 120, 3), (5, minute(21), 15, 1), (5, minute(21), 120, 2)]


def test_stalled_stream_equals_batch_at_the_watermark(rocks, tmp_path):
    rng = np.random.default_rng(1)
    tasks = [(i, str(rng.choice(["in_progress", "in_progress", "done", "pending"])), at(float(rng.integers(0, 7 * 3600))) if rng.random() < 0.8 else None, at(float(rng.integers(0, 3600)))) for i in range(40)]
    end = at(8 * 3600)
    batches = [tasks, [(99, "done", end + dt.timedelta(minutes=1), None)], [(99, "done", end + dt.timedelta(minutes=1), None)]]
    got = ran(rocks, tmp_path, TASKS, batches, lambda s: timers.stream_stalled(s, delay="1 minute"), "due")
    df = rocks.createDataFrame(tasks, TASKS)
    passed = [max(u or c for _, _, u, c in tasks) - dt.timedelta(minutes=1), end]  # the watermarks
    for m in (15, 120):
        want = {}
        for as_of in passed:
            for r in records.stalled(df, str(as_of), m).collect():
                want.setdefault(r["task_id"], r["idle_hours"])
        assert {r.task_id: r.idle_hours for r in got if r.minutes == m} == want and want
