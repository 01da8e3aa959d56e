"""Streams in several batches: late rows, ends that stand, and polling."""

import time

from sitelens.streaming import state

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def put(spark, path, rows):
    spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}L, timestamp'{ts}', {u}L, '{kind}', 1.0D)" for i, ts, u, kind in rows) + " AS t(event_id, ts, user_id, event_type, value)").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def test_rows_later_than_a_day_are_dropped_and_days_are_seen_once(spark, tmp_path):
    path = f"{tmp_path}/events"
    for rows in ([(1, "2024-01-10 01:00:00", 1, "view"), (2, "2024-01-10 05:00:00", 1, "view")], [(3, "2024-01-15 00:00:00", 2, "view")], [(6, "2024-01-15 03:00:00", 2, "view")], [(4, "2024-01-10 02:00:00", 3, "view"), (5, "2024-01-15 09:00:00", 2, "view")]):
        put(spark, path, rows)
        time.sleep(1.1)  # files are taken in the order of their times
    # A batch goes by the watermark of the batch before the last.
    got = {(r.user_id, str(r.day)[:10]) for r in state.appended(spark, state.first_requests(stream(spark, path))).collect()}
    assert got == {(1, "2024-01-10"), (2, "2024-01-15")}


def test_an_end_stands_over_later_steps_and_batches_merge(spark, tmp_path):
    path = f"{tmp_path}/events"
    put(spark, path, [(1, "2024-01-01 00:00:00", 1, "view"), (2, "2024-01-01 00:01:00", 2, "view")])
    time.sleep(1.1)
    put(spark, path, [(3, "2024-01-01 00:02:00", 1, "error"), (4, "2024-01-01 00:03:00", 1, "click")])
    got = {r.user_id: (r.status, str(r.seen)) for r in state.merged(spark, state.status(stream(spark, path)), ["user_id"]).collect()}
    assert got == {1: ("failed", "2024-01-01 00:03:00"), 2: ("pending", "2024-01-01 00:01:00")}


def test_polling_sees_new_rows(spark, tmp_path):
    path, seen = f"{tmp_path}/events", []
    put(spark, path, [(1, "2024-01-01 00:00:00", 1, "view")])
    query = state.polled(state.status(stream(spark, path)), lambda batch, number: seen.extend(r.user_id for r in batch.collect()), f"{tmp_path}/at", "1 second")
    try:
        query.processAllAvailable()
        put(spark, path, [(2, "2024-01-01 00:01:00", 2, "view")])
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [1, 2]
