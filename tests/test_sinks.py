"""Sinks: logs grow, histories tell the latest, a run replaces its own rows only, and an empty one none."""

import pytest

from sitelens import plans

from sitelens.operators import datapoints, sinks


def test_sinks(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "run int, id int, v string")
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(2, 2, "c")], []):
        sinks.append_log(df(rows), f"{tmp_path}/log")
        sinks.upsert(df(rows), f"{tmp_path}/history")
        sinks.replace_run(df(rows), f"{tmp_path}/runs", "run")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3
    assert {tuple(r) for r in sinks.latest(spark, f"{tmp_path}/history", ["run"], "id", "v").select("run", "id", "v").collect()} == {(1, 1, "a"), (2, 2, "c")}
    assert {(r.run, r.id) for r in spark.read.parquet(f"{tmp_path}/runs").collect()} == {(1, 1), (2, 2)}


def test_kinds_are_registered_once():
    plans.catalogue()
    with pytest.raises(ValueError):
        datapoints.register("contact_details", "again", None)
    assert {"contact_details", "domain_risk_assessment"} <= {k.key for k in datapoints.kinds()}


def test_runs_of_one_partition_are_replaced_alone(spark, tmp_path):
    path = f"{tmp_path}/runs"
    put = lambda *rows: sinks.replace_runs(spark.createDataFrame([(r % 2, r, x) for r, x in rows], "part int, run int, x string"), path, "part", "run")
    held = lambda: sorted((r.run, r.x) for r in spark.read.parquet(path).collect())
    put((1, "a"), (1, "b"), (3, "c"), (2, "d"))
    put((3, "new"))
    assert held() == [(1, "a"), (1, "b"), (2, "d"), (3, "new")]
    put()
    put((4, "e"), (1, "f"))
    assert held() == [(1, "f"), (2, "d"), (3, "new"), (4, "e")]
