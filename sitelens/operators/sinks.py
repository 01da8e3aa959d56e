"""Where results are kept: logs that only grow, histories with their latest values, and runs that replace the one before.

Tables are Parquet in folders that the caller names. A run's rows lie in a partition of its key, so that replacing it
rewrites its own files only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relational as R
from .shared import written


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log; what is there stays."""
    rows.write.mode("append").parquet(path)


def upsert(rows: DataFrame, path: str) -> None:
    """Adds values to a history; latest() tells which of them hold."""
    rows.write.mode("append").parquet(path)


def latest(spark: SparkSession, path: str, keys: list[str], at: str, unique: str) -> DataFrame:
    return R.latest_per_key(spark.read.parquet(path), keys, at, unique)


def replace_run(rows: DataFrame, path: str, key: str) -> None:
    """Replaces the rows of every run that rows has; a run without rows keeps its old ones."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def replace_runs(rows: DataFrame, path: str, part: str, run: str) -> None:
    """Replaces the rows of every run that rows has, where a partition of the store holds many runs; a run without rows keeps its old
    ones. Only partitions that have a new run are written again, each with the runs of it that stay."""
    spark = rows.sparkSession
    rows = written(rows)
    try:
        old = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException:  # there is no store yet
        old = rows.limit(0)
    old = old.join(rows.select(part).distinct(), part, "left_semi").join(rows.select(run).distinct(), run, "left_anti")
    # What stays is read from the files that are replaced, so it is written aside first.
    whole = written(old.select(*rows.columns).unionByName(rows))
    whole.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def artifact(html: str, text: str, most_html: int, most_text: int) -> list:
    """Columns of a stored page: html and text cut to what is kept, and the hashes of both in whole."""
    return [F.substring(html, 1, most_html).alias("html_snippet"), F.substring(text, 1, most_text).alias("text_snippet"), F.sha2(html, 256).alias("html_sha256"), F.sha2(text, 256).alias("text_sha256")]
