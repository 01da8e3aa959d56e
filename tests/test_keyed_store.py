"""Get or create by key: a second run computes nothing, equal content is computed once, and the store is never shuffled."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators.keyed_store import KeyedStore


@pytest.fixture()
def counted(spark):
    """(compute, the number of keys that it was called for)."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def size(x):
        calls.add(1)
        return len(x)

    return lambda df: df.select("k", size("text").alias("size")), calls


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id int, k string, text string").repartition(3)


def test_only_unknown_keys_are_computed(spark, tmp_path, counted):
    compute, calls = counted
    store = KeyedStore(spark, "kept_a", f"{tmp_path}/store", "k", "size INT", 4)
    first = store.get_or_create(rows(spark, (1, "a", "one"), (2, "a", "one"), (3, "b", "three"), (4, None, "none")), ["text"], compute)
    assert sorted((r.id, r.size, r.reused) for r in first.collect()) == [(1, 3, False), (2, 3, False), (3, 5, False), (4, None, None)]
    assert calls.value == 2
    again = store.get_or_create(rows(spark, (1, "a", "one"), (3, "b", "three")), ["text"], compute)
    assert sorted((r.id, r.size, r.reused) for r in again.collect()) == [(1, 3, True), (3, 5, True)] and calls.value == 2
    more = store.get_or_create(rows(spark, (1, "a", "another text, the same key"), (5, "c", "")), ["text"], compute)
    assert sorted((r.id, r.size, r.reused) for r in more.collect()) == [(1, 3, True), (5, 0, False)] and calls.value == 3
    assert store.table().count() == 3


def test_a_new_session_of_the_table_finds_what_is_stored(spark, tmp_path, counted):
    compute, calls = counted
    KeyedStore(spark, "kept_b", f"{tmp_path}/store", "k", "size INT", 4).ensure(rows(spark, (1, "a", "one")), compute)
    spark.sql("DROP TABLE kept_b")  # of an external table, so its files stay
    store = KeyedStore(spark, "kept_b2", f"{tmp_path}/store", "k", "size INT", 4)
    assert store.get_or_create(rows(spark, (1, "a", "one")), ["text"], compute).first().reused and calls.value == 1
    compact = store.compact(f"{tmp_path}/compact")
    assert [tuple(r) for r in compact.table().collect()] == [tuple(r) for r in store.table().collect()]


def test_empty_requests(spark, tmp_path, counted):
    compute, calls = counted
    store = KeyedStore(spark, "kept_c", f"{tmp_path}/store", "k", "size INT", 4)
    assert store.get_or_create(rows(spark, (1, "a", "x")).limit(0), ["text"], compute).count() == 0
    assert store.table().count() == 0 and calls.value == 0


def test_the_stored_side_is_not_shuffled(spark, tmp_path, counted):
    store = KeyedStore(spark, "kept_d", f"{tmp_path}/store", "k", "size INT", 16)
    store.ensure(rows(spark, *((k, f"k{k}", "x" * k) for k in range(50))), counted[0])
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.range(100).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("x").alias("text"))
        plan = store.unknown(wanted)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "Bucketed: true" in plan and "Exchange" not in plan[plan.rindex("   +- ") :] and "Exchange" not in plan[: plan.index("FileScan")].rpartition("\n   +- ")[2]
