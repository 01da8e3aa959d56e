"""Kinds of data that can be extracted from a scan: a registry of builders, each a DataFrame of (page_id, value)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    key: str
    label: str
    build: Callable[[SparkSession, str], DataFrame]


_kinds: dict[str, Kind] = {}


def register(key: str, label: str, build: Callable[[SparkSession, str], DataFrame]) -> None:
    """Adds a kind; a key is taken once."""
    if key in _kinds:
        raise ValueError(f"{key} is registered")
    _kinds[key] = Kind(key, label, build)


def kinds() -> list[Kind]:
    return list(_kinds.values())


def extracted(spark: SparkSession, sf_dir: str, keys: list[str] | None = None) -> DataFrame:
    """(page_id, key, label, value) of the kinds with these keys, or of all; an unknown key is an error."""
    wanted = [_kinds[k] for k in (keys if keys is not None else _kinds)]
    out = None
    for kind in wanted:
        rows = kind.build(spark, sf_dir)
        value = F.to_json(F.struct(*(c for c in rows.columns if c != "page_id")))
        rows = rows.select("page_id", F.lit(kind.key).alias("key"), F.lit(kind.label).alias("label"), value.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "page_id long, key string, label string, value string")
