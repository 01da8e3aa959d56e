"""Queries over pages: features, signals, risk, likelihoods, entities and similarity.

Each is a chain of projections; the text of a page is computed once, in an inner projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions.dialect import DUCK, SPARK
from ..sources import views


def named(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in columns.items()]


def project(df: DataFrame, columns: dict[str, str], keep=("page_id",)) -> DataFrame:
    return df.selectExpr(*keep, *named(columns))


def select(columns: dict[str, str], source: str, keep=("page_id",)) -> str:
    return f"SELECT {', '.join([*keep, *named(columns)])} FROM ({source})"


def with_text(q, text=P.plain) -> str:
    return f"SELECT page_id, url, h, {text(q)} AS t FROM ({views.pages_sql()})"


def texts(spark: SparkSession, sf_dir: str, text=P.plain) -> DataFrame:
    return views.pages(spark, sf_dir).selectExpr("page_id", "url", "h", f"{text(SPARK)} AS t")


def page_query(columns, text=P.plain):
    """(Spark query, DuckDB SQL) of a projection over a page's html, text and url."""
    return lambda spark, sf: project(texts(spark, sf, text), columns(SPARK)), select(columns(DUCK), with_text(DUCK, text))


PRICE_TEXTS = ["concat('$', p_retailprice)", "concat('US$ ', p_size)", "concat('EUR ', p_size, '.50')", "concat(p_size, ' USD')", "concat('£1,', 100 + p_size, '.25')", "p_name"]


def price_texts() -> str:
    return "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(PRICE_TEXTS)) + " END"


def price_parse(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", f"{price_texts()} AS c").selectExpr("*", f"{P.priced(SPARK, 'c')} AS k")
    return project(df, P.price(SPARK, "c", "k"), ("p_partkey",))


def text_queries(spark, sf):
    return texts(spark, sf).selectExpr("page_id", "t AS plain", f"{P.compared(SPARK)} AS compared")


def url_normalize(spark, sf):
    return project(spark.read.parquet(f"{sf}/pages.parquet"), P.urls(SPARK))


def domain_rollup(spark, sf):
    df = texts(spark, sf).selectExpr(f"{P.host(SPARK)} AS host", f"{P.words(SPARK, 't')} AS n", "length(h) AS size")
    return df.groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").cast("long").alias("words"), F.max("size").cast("long").alias("longest"))


def catalogue() -> dict:
    """name -> (query, SQL)."""
    return {
        "page_features": (lambda spark, sf: project(project(texts(spark, sf, P.compared), P.features(SPARK)), P.flat_features(SPARK)), select(P.flat_features(DUCK), select(P.features(DUCK), with_text(DUCK, P.compared)))),
        "page_text_extract": (text_queries, f"SELECT page_id, t AS plain, {P.compared(DUCK)} AS compared FROM ({with_text(DUCK)})"),
        "url_normalize": (url_normalize, select(P.urls(DUCK), "SELECT * FROM pages")),
        "domain_rollup": (domain_rollup, f"SELECT host, count(*) AS pages, CAST(sum(n) AS BIGINT) AS words, CAST(max(size) AS BIGINT) AS longest FROM (SELECT {P.host(DUCK)} AS host, {P.words(DUCK, 't')} AS n, length(h) AS size FROM ({with_text(DUCK)})) GROUP BY host"),
        "page_signals": page_query(P.signals),
        "price_parse": (price_parse, select(P.price(DUCK, "c", "k"), f"SELECT *, {P.priced(DUCK, 'c')} AS k FROM (SELECT p_partkey, {price_texts()} AS c FROM part)", ("p_partkey",))),
    }
