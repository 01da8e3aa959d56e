"""Nested first rows: two levels, pages, cursors, parents without rows, ties and hot parents."""

from pyspark.sql import functions as F

from sitelens.operators import nested


def tables(spark):
    parents = spark.createDataFrame([(1, 30, "a"), (2, 20, "b"), (3, None, "c"), (4, 20, "d"), (None, 5, "e")], "id long, at int, name string")
    runs = [(10, 1, 5), (11, 1, 7), (12, 1, 7), (13, 1, 1), (20, 2, 3), (30, 9, 9), (None, 1, 0), (40, None, 1)] + [(1000 + k, 4, 1) for k in range(3000)]
    logs = [(r, n) for r in (10, 11, 12, 13, 20, 30) for n in (3, 1, 2)] + [(None, 9)]
    return parents, spark.createDataFrame(runs, "run long, owner long, at int"), spark.createDataFrame(logs, "of_run long, n int")


def relations(runs, logs, k=3, of_logs=2):
    below = nested.Relation("logs", logs, "of_run", [F.asc("n")], ["n"], of_logs)
    return [nested.Relation("runs", runs, "owner", [F.desc("at"), F.desc("run")], ["run", "at"], k, "run", [below])]


def test_two_levels(spark):
    parents, runs, logs = tables(spark)
    for filtered in (True, False):
        got = {r.name: [(x.run, x.at, [y.n for y in x.logs]) for x in r.runs] for r in nested.nested(parents, "id", relations(runs, logs), filtered).collect()}
        assert got == {"a": [(12, 7, [1, 2]), (11, 7, [1, 2]), (10, 5, [1, 2])], "b": [(20, 3, [1, 2])], "c": [], "d": [(3999, 1, []), (3998, 1, []), (3997, 1, [])], "e": []}


def test_relations_are_read_for_the_page_only(spark, tmp_path):
    parents, runs, logs = tables(spark)
    runs.write.parquet(f"{tmp_path}/runs")
    logs.write.parquet(f"{tmp_path}/logs")
    page = nested.cursor_list(parents, "at", "id", None, 2, relations(spark.read.parquet(f"{tmp_path}/runs"), spark.read.parquet(f"{tmp_path}/logs"), 1))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "In(owner, [" in plan and "of_run" in plan and "PushedFilters: []" not in plan
    assert [(r.name, [x.run for x in r.runs]) for r in page.orderBy("place").collect()] == [("c", []), ("a", [12])]


def test_more_keys_than_literals(spark, monkeypatch):
    parents, runs, logs = tables(spark)
    want = sorted(map(str, nested.nested(parents, "id", relations(runs, logs)).collect()))
    monkeypatch.setattr(nested, "MOST_KEYS", 1)
    assert sorted(map(str, nested.nested(parents, "id", relations(runs, logs)).collect())) == want


def test_pages_follow_each_other(spark):
    parents, runs, logs = tables(spark)
    parents = parents.filter("id IS NOT NULL")
    names, after = [], None
    for _ in range(4):
        rows = nested.cursor_list(parents, "at", "id", after, 1, relations(runs, logs)).collect()
        names += [r.name for r in rows]
        assert rows[0].has_more == (len(names) < 4) and rows[0].next_cursor == (rows[0].id if rows[0].has_more else None)
        after = (rows[0].at, rows[0].id)
    assert names == ["c", "a", "d", "b"]
    assert nested.cursor_list(parents, "at", "id", after, 1, relations(runs, logs)).count() == 0
    assert nested.cursor_list(parents, "at", "id", None, 1000, []).count() == 4


def test_empty_tables(spark):
    parents, runs, logs = tables(spark)
    assert nested.nested(parents.limit(0), "id", relations(runs, logs)).count() == 0
    assert all(r.runs == [] for r in nested.nested(parents, "id", relations(runs.limit(0), logs)).collect())
