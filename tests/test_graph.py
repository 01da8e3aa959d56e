"""Deletes over a graph of foreign keys: chains, two parents, references that become null, cycles."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators import graph
from sitelens.operators.graph import Edge

EDGES = [Edge("b", "a_id", "a", "id"), Edge("c", "b_id", "b", "id"), Edge("c", "a_id", "a", "id"), Edge("d", "c_id", "c", "id", graph.SET_NULL), Edge("e", "d_id", "d", "id")]


def tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "a": make([(1,), (2,), (None,)], "id long"), "b": make([(10, 1), (11, 2), (12, None)], "id long, a_id long"),
        "c": make([(20, 10, 2), (21, 11, 1), (22, 10, 1), (23, 11, 2), (24, None, None), (22, 10, 1)], "id long, b_id long, a_id long"),
        "d": make([(30, 20), (31, 23), (32, None)], "id long, c_id long"), "e": make([(40, 30)], "id long, d_id long"), "f": make([(1,)], "id long"),
    }


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_chains_two_parents_and_nulls(spark):
    t = tables(spark)
    got = graph.deleted(t, EDGES, "a", t["a"].filter("id = 1"))
    assert [(k, *map(rows, v)) for k, v in got.items()] == [
        ("a", [(2,), (None,)], [(1,)]), ("b", [(11, 2), (12, None)], [(10, 1)]),
        ("c", [(23, 11, 2), (24, None, None)], [(20, 10, 2), (21, 11, 1), (22, 10, 1), (22, 10, 1)]),  # each once, repeated rows included
        ("d", [(30, None), (31, 23), (32, None)], []), ("e", [(40, 30)], []),
    ]


def test_one_join_an_edge(spark):
    t = tables(spark)
    c, _ = graph.deleted(t, EDGES, "a", t["a"].filter("id = 1"))["c"]
    assert c._jdf.queryExecution().analyzed().toString().count("LeftAnti") == 2


def test_cycles_unknown_tables_and_actions_are_refused(spark):
    t = tables(spark)
    with pytest.raises(ValueError, match="circle"):
        graph.deleted(t, [*EDGES, Edge("a", "id", "c", "id")], "a", t["a"])
    with pytest.raises(ValueError, match="circle"):
        graph.in_order([Edge("a", "parent", "a", "id")])
    with pytest.raises(ValueError, match="nowhere"):
        graph.deleted(t, [*EDGES, Edge("nowhere", "id", "a", "id")], "a", t["a"])
    with pytest.raises(ValueError, match="action"):
        graph.in_order([Edge("b", "a_id", "a", "id", "refuse")])


def test_nothing_goes_and_all_goes(spark):
    t = tables(spark)
    none = graph.deleted(t, EDGES, "a", t["a"].limit(0))
    assert all(v[1].count() == 0 and rows(v[0]) == rows(t[k]) for k, v in none.items())
    every = graph.deleted(t, EDGES, "a", t["a"])
    assert rows(every["a"][0]) == [] and rows(every["b"][0]) == [(12, None)] and rows(every["c"][0]) == [(24, None, None)]
    middle = graph.deleted(t, EDGES, "b", t["b"].filter(F.col("id") == 10))
    assert rows(middle["a"][0]) == rows(t["a"]) and rows(middle["c"][1]) == [(20, 10, 2), (22, 10, 1), (22, 10, 1)]
