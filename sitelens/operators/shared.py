"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..streaming.state import folder


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read again, for what several branches of a plan read."""
    path = f"{folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
