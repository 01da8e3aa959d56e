"""Requests against their schemas; what is expected is worked out from the schemas by hand."""

import json

import pytest
from pyspark.sql import functions as F

from sitelens.functions import requests as R


def checked(spark, schema, bodies):
    texts = [x if x is None or isinstance(x, str) else json.dumps(x) for x in bodies]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, x string").select("n", R.body(F.col("x"), schema).alias("r")).orderBy("n").collect()
    return [(r.r.value.asDict() if r.r.ok else None, [(e.path, e.code) for e in r.r.errors]) for r in rows]


def asked(spark, schema, maps):
    rows = spark.createDataFrame(list(enumerate(maps)), "n int, x map<string,string>").select("n", R.parameters(F.col("x"), schema).alias("r")).orderBy("n").collect()
    return [(r.r.value.asDict() if r.r.ok else None, [(e.path, e.code) for e in r.r.errors]) for r in rows]


def test_new_scan(spark):
    value = {"url": "https://a.example/x", "source": "search", "background": True}
    cases = [
        ({"url": "https://a.example/x"}, value, []), ({"url": "https://a.example/x", "source": "api", "background": False, "more": 1}, value | {"source": "api", "background": False}, []),
        ({"url": "a.example"}, None, [("url", R.FORMAT)]), ({"url": "https://"}, None, [("url", R.FORMAT)]), ({"url": "mailto:a@b.example"}, value | {"url": "mailto:a@b.example"}, []),
        ({}, None, [("url", R.TYPE)]), ({"url": None, "source": "web", "background": "yes"}, None, [("url", R.TYPE), ("source", R.VALUE), ("background", R.TYPE)]), ({"url": 5}, None, [("url", R.TYPE)]),
        ({"url": "https://a.example/x", "source": None}, None, [("source", R.VALUE)]), ([1], None, [("", R.TYPE)]), ("not json", None, [("", R.TYPE)]), (None, None, [("", R.TYPE)]), ('"text"', None, [("", R.TYPE)]),
    ]
    assert checked(spark, R.NEW_SCAN, [c[0] for c in cases]) == [c[1:] for c in cases]


def test_notes(spark):
    note = {"content": "x", "type": "note", "riskDecision": None}
    cases = [
        ({"content": "x"}, note, []), ({"content": "", "type": "note"}, None, [("", R.CUSTOM)]), ({}, None, [("", R.CUSTOM)]), ({"type": "review"}, None, [("", R.CUSTOM)]),
        ({"type": "review", "riskDecision": "risky"}, {"content": None, "type": "review", "riskDecision": "risky"}, []), ({"type": "review", "riskDecision": "maybe"}, None, [("riskDecision", R.VALUE)]),
        ({"content": "x" * 5000}, note | {"content": "x" * 5000}, []), ({"content": "é" * 5001}, None, [("content", R.BIG)]), ({"content": 1, "type": 2}, None, [("content", R.TYPE), ("type", R.VALUE)]), ({"content": None}, None, [("content", R.TYPE)]),
    ]
    assert checked(spark, R.NEW_NOTE, [c[0] for c in cases]) == [c[1:] for c in cases]
    assert [e for _, e in checked(spark, R.NOTE_CHANGE, [{"content": ""}, {}, {"content": "x"}])] == [[("content", R.SMALL)], [("content", R.TYPE)], []]


def test_flags_and_comparisons(spark):
    assert [e for _, e in checked(spark, R.RISK_FLAG, [{"isRisky": True}, {"isRisky": "true"}, {"isRisky": 1, "note": "n" * 1001}, {"note": "n"}])] == [[], [("isRisky", R.TYPE)], [("isRisky", R.TYPE), ("note", R.BIG)], [("isRisky", R.TYPE)]]
    assert [e for _, e in checked(spark, R.COMPARISON, [{"urlA": "a", "urlB": "b"}, {"urlA": "", "urlB": "b"}, {"urlB": {}}])] == [[], [("urlA", R.SMALL)], [("urlA", R.TYPE), ("urlB", R.TYPE)]]


def test_query_parameters(spark):
    base = {"page": 1, "pageSize": 50, "search": None, "hasPrice": None, "minConfidence": None, "sortBy": "confidence", "sortDir": "desc"}
    cases = [
        ({}, base, []), (None, base, []), ({"page": " 3 ", "pageSize": "1e2", "search": "", "sortBy": ""}, base | {"page": 3, "pageSize": 100}, []), ({"page": "0x10"}, base | {"page": 16}, []),
        ({"page": "0"}, None, [("page", R.SMALL)]), ({"page": "1.5"}, None, [("page", R.TYPE)]), ({"page": "two", "pageSize": "101"}, None, [("page", R.TYPE), ("pageSize", R.BIG)]), ({"page": "9" * 20}, None, [("page", R.TYPE)]),
        ({"minConfidence": ""}, base | {"minConfidence": 0}, []), ({"minConfidence": "-1", "sortDir": "up"}, None, [("minConfidence", R.SMALL), ("sortDir", R.VALUE)]), ({"hasPrice": "yes"}, None, [("hasPrice", R.VALUE)]), ({"hasPrice": ""}, None, [("hasPrice", R.VALUE)]),
    ]
    assert asked(spark, R.OFFERS, [c[0] for c in cases]) == [c[1:] for c in cases]
    assert asked(spark, R.DOMAINS, [{"limit": "2.5"}, {"limit": "500", "cursor": "c"}, {}]) == [({"limit": 2.5, "cursor": None}, []), (None, [("limit", R.BIG)]), ({"limit": 50.0, "cursor": None}, [])]


@pytest.mark.parametrize("kind, coerce, value, want", [
    ("number", True, True, 1.0), ("number", True, None, 0.0), ("number", True, " ", 0.0), ("number", True, [], None), ("number", False, "1", None), ("integer", False, 2.0, 2), ("integer", False, 2.5, None), ("integer", False, 1e300, None), ("number", False, -0.5, -0.5),
])
def test_numbers(spark, kind, coerce, value, want):
    [(got, errors)] = checked(spark, R.Schema((R.Field("x", kind, coerce=coerce),)), [{"x": value}])
    assert (got, errors) == (({"x": want}, []) if want is not None else (None, [("x", R.TYPE)]))


def test_no_python_and_no_shuffle(spark):
    plan = spark.range(5).select(R.body(F.to_json(F.struct("id")), R.NEW_NOTE).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
