"""Derived inputs, each defined once for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

def pages_sql() -> str:
    return "SELECT page_id, url, html AS h FROM pages"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "url", "html AS h")


#: Events as scans: (scan_id, domain_id, status, created_at).
SCANS = "SELECT event_id AS scan_id, user_id AS domain_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status, ts AS created_at FROM events"
#: Events as fetch logs: (log_id, domain_id, status_code, created_at).
LOGS = "SELECT event_id AS log_id, user_id AS domain_id, CASE event_type WHEN 'purchase' THEN 200 WHEN 'signup' THEN 301 WHEN 'error' THEN 503 WHEN 'click' THEN 404 END AS status_code, ts AS created_at FROM events"
#: Line items as offers: (order_id, pos, title, currency, amount, original, on_sale).
OFFERS = "SELECT l_orderkey AS order_id, l_linenumber AS pos, p_name AS title, CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'N' THEN 'EUR' ELSE 'GBP' END AS currency, p_retailprice * (1 - l_discount) AS amount, p_retailprice AS original, l_discount > 0 AS on_sale FROM lineitem JOIN part ON l_partkey = p_partkey"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the definitions above over the tables that it names."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "lineitem", "part") if f" {t}" in sql}
    for name in frames:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(sql, **frames)
