"""Streams with timers: several batches, restarts, gaps and late rows; a read model over many batches."""

import time

from pyspark.sql import functions as F

from sitelens.streaming import state, timers

from test_streaming import put, stream


def fed(spark, path, rows):
    put(spark, path, rows)
    time.sleep(1.1)  # files are taken in the order of their times


def test_work_turns_stale_by_itself_over_batches_and_a_restart(spark, tmp_path):
    path, at = f"{tmp_path}/events", f"{tmp_path}/run"
    fed(spark, path, [(1, "2024-01-01 10:00:00", 1, "view"), (2, "2024-01-01 10:01:00", 1, "click"), (3, "2024-01-01 10:00:00", 2, "view"), (4, "2024-01-01 10:02:00", 2, "purchase"), (5, "2024-01-01 10:00:00", 3, "view")])
    run = lambda: {(r.key, r.event_id, r.status, str(r.at)[11:], r.stale) for r in state.appended(spark, timers.work(stream(spark, path)), at).collect()}
    first = {(1, 1, "pending", "10:00:00", False), (1, 2, "processing", "10:01:00", False), (2, 3, "pending", "10:00:00", False), (2, 4, "completed", "10:02:00", False), (3, 5, "pending", "10:00:00", False)}
    assert run() == first
    # In one later batch: a step of the third in time, none of the first, and the watermark moves to 10:20.
    fed(spark, path, [(6, "2024-01-01 10:04:00", 3, "click"), (7, "2024-01-01 10:30:00", 4, "view")])
    second = first | {(3, 6, "processing", "10:04:00", False), (4, 7, "pending", "10:30:00", False), (1, 2, "processing", "10:06:00", True), (3, 6, "processing", "10:09:00", True)}
    assert run() == second
    # Nothing new: nothing fires twice. Then a gap inside one batch, an end, and a new beginning after staleness.
    assert run() == second
    fed(spark, path, [(8, "2024-01-01 10:34:59", 4, "view"), (9, "2024-01-01 10:40:01", 4, "view"), (10, "2024-01-01 10:41:00", 4, "error"), (11, "2024-01-01 10:42:00", 4, "view"), (12, "2024-01-01 10:59:00", 1, "click")])
    third = second | {(4, 8, "pending", "10:39:59", True), (4, 9, "pending", "10:40:01", False), (4, 10, "failed", "10:41:00", False), (4, 11, "pending", "10:42:00", False), (4, 11, "pending", "10:47:00", True), (1, 12, "processing", "10:59:00", False)}
    assert run() == third


def test_a_step_in_time_moves_the_timer(spark, tmp_path):
    path = f"{tmp_path}/events"
    for rows in ([(1, "2024-01-01 10:00:00", 1, "view")], [(2, "2024-01-01 10:04:00", 1, "view")], [(3, "2024-01-01 10:16:00", 2, "view")], [(4, "2024-01-01 10:08:00", 1, "purchase")], [(5, "2024-01-01 11:00:00", 2, "purchase")]):
        fed(spark, path, rows)
    # The watermark is at 10:06 when the last step comes: later than 10:05, at which the first step would have been stale.
    rows = state.appended(spark, timers.work(stream(spark, path))).filter("key = 1").collect()
    assert {(r.event_id, r.status, r.stale) for r in rows} == {(1, "pending", False), (4, "completed", False)}


def test_a_fetch_serves_for_a_day(spark, tmp_path):
    path, at = f"{tmp_path}/events", f"{tmp_path}/run"
    run = lambda: {r.event_id: (r.fetched, str(r.stored_at)) for r in state.appended(spark, timers.requests(stream(spark, path)), at).collect()}
    fed(spark, path, [(1, "2024-01-01 10:00:00", 1, "view"), (2, "2024-01-02 09:59:00", 1, "view"), (3, "2024-01-02 10:01:00", 1, "view")])
    one, two = "2024-01-01 10:00:00", "2024-01-02 10:01:00"
    assert run() == {1: (True, one), 2: (False, one), 3: (True, two)}
    # From one run to the next: served to the second, over the day's end; counted from the fetch, not from the last request.
    fed(spark, path, [(4, "2024-01-03 10:01:00", 1, "view"), (5, "2024-01-02 23:00:00", 2, "view")])
    assert {k: v for k, v in run().items() if k > 3} == {4: (False, two), 5: (True, "2024-01-02 23:00:00")}
    fed(spark, path, [(6, "2024-01-03 10:01:01", 1, "view"), (7, "2024-01-09 00:00:00", 2, "view")])
    got = run()
    assert (got[6], got[7]) == ((True, "2024-01-03 10:01:01"), (True, "2024-01-09 00:00:00"))
    # A row later than the watermark of the batches before it takes no part.
    fed(spark, path, [(8, "2024-01-03 10:02:00", 1, "view"), (9, "2024-01-09 00:01:00", 2, "view")])
    got = run()
    assert 8 not in got and got[9] == (False, "2024-01-09 00:00:00")


def test_rows_without_a_key_a_time_or_an_id_take_no_part(spark, tmp_path):
    path = f"{tmp_path}/events"
    spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01', NULL, 'view'), (2L, NULL, 1L, 'view'), (NULL, timestamp'2024-01-01', 1L, 'view'), (3L, timestamp'2024-01-01', 1L, NULL) AS t(event_id, ts, user_id, event_type)").coalesce(1).write.parquet(path)
    rows = state.appended(spark, timers.work(stream(spark, path))).collect()
    assert [(r.key, r.event_id, r.status) for r in rows] == [(1, 3, "pending")]


def test_a_read_model_keeps_few_files_over_many_batches(spark, tmp_path):
    every, most, want = 8, 0, {}
    schema = spark.createDataFrame([], "k long, v long, name string").schema
    model = state.ReadModel(spark, f"{tmp_path}/model", ["k"], schema, every)
    assert model.rows().count() == 0
    for n in range(100):
        batch = [(n % 7, n, None if n % 3 else f"b{n}"), (n + 1000, n, "x")]
        want |= {k: (v, name) for k, v, name in batch}
        model.put(spark.createDataFrame(batch, schema).coalesce(1), n)
        if n in (17, 40):  # a batch that is repeated, the second time after its merge
            model.put(spark.createDataFrame(batch, schema).coalesce(1), n)
        most = max(most, len(list((tmp_path / "model").iterdir())))
    assert {r.k: (r.v, r.name) for r in model.rows().collect()} == want
    assert most <= 2 * every + 2 and len(model.numbers("base")) == 2


def test_a_merge_that_was_broken_off_does_not_count(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    model = state.ReadModel(spark, f"{tmp_path}/model", ["k"], schema, 2)
    for n in range(4):
        model.put(spark.createDataFrame([(1, n)], schema), n)
    (tmp_path / "model" / "base-000000000003" / "_SUCCESS").unlink()
    assert model.rows().collect() == [(1, 3)]
    model.compact(3)
    assert model.rows().collect() == [(1, 3)]


def test_polled_batches_merge_into_the_read_model(spark, tmp_path):
    path = f"{tmp_path}/events"
    fed(spark, path, [(1, "2024-01-01 00:00:00", 1, "view"), (2, "2024-01-01 00:00:00", 2, "view")])
    rows = state.status(stream(spark, path))
    model = state.ReadModel(spark, f"{tmp_path}/model", ["user_id"], rows.schema, 2)
    query = state.polled(rows, model.put, f"{tmp_path}/at", "1 second")
    try:
        query.processAllAvailable()
        assert {(r.user_id, r.status) for r in model.rows().collect()} == {(1, "pending"), (2, "pending")}
        for n, kind in enumerate(("click", "purchase", "view")):
            fed(spark, path, [(3 + n, f"2024-01-01 00:0{n + 1}:00", 1, kind)])
            query.processAllAvailable()
    finally:
        query.stop()
    assert {(r.user_id, r.status) for r in model.rows().collect()} == {(1, "completed"), (2, "pending")}
    assert model.rows().agg(F.count("*")).first()[0] == 2
