"""The labelled sample: every language whatever the ids, within its bound."""

import pytest
from pyspark.sql import functions as F

from sitelens.llm import language_id

SF = "/root/testdata/sf0.001"
TEXTS = {"en": "the weather of that house with them", "de": "nicht über schönes wetter und häuser", "fr": "où être français pour les garçons", "es": "niño mañana español está aquí"}


def docs(spark, doc_id, copies=400):
    rows = [(lang, f"{text} {'x' * (k % 7)}") for lang, text in TEXTS.items() for k in range(copies)]
    return spark.createDataFrame(rows, "lang string, text string").withColumn("doc_id", doc_id).repartition(4)


@pytest.mark.parametrize("doc_id", [lambda: F.lit(7), lambda: F.lit(None).cast("long"), F.monotonically_increasing_id])
def test_every_language_is_drawn_and_bounded(spark, monkeypatch, doc_id):
    monkeypatch.setattr(language_id, "SAMPLE", 100)
    got = {r.lang: r.n for r in language_id.sample(spark, docs(spark, doc_id())).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert got == dict.fromkeys(TEXTS, 100)
    assert language_id.fit(spark, docs(spark, doc_id())).classes == sorted(TEXTS)


def test_identical_rows_are_rows_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 50)
    same = docs(spark, F.lit(1)).withColumn("text", F.lit("one text")).withColumn("lang", F.lit("en"))
    assert language_id.sample(spark, same).count() == 50


def test_many_languages_share_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST", 120)
    monkeypatch.setattr(language_id, "SENT", 3)  # and their counts are joined
    many = docs(spark, F.lit(1)).withColumn("lang", F.concat("lang", F.length("text") % 5))
    languages = many.select("lang").distinct().count()
    got = [r.n for r in language_id.sample(spark, many).groupBy("lang").agg(F.count("*").alias("n")).collect()]
    assert len(got) == languages and max(got) == 120 // languages


def test_texts_without_a_letter_teach_nothing(spark):
    rows = spark.createDataFrame([(1, "12 34", "en"), (2, None, "en"), (3, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.sample(spark, rows).count() == 0
    assert language_id.fit(spark, rows).classes == []
