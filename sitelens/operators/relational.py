"""Building blocks of the read models: latest rows, pages of results, resolution and sets.

All take and return DataFrames. Ties are broken by a unique column that the caller names, nulls are
placed explicitly, and times come in as parameters, so results are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_parent(df: DataFrame, parent, order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each parent; the limit is applied before the shuffle too."""
    parent = [parent] if isinstance(parent, str) else parent
    n = F.row_number().over(W.partitionBy(*parent).orderBy(*order))
    return df.withColumn("rank", n).filter(F.col("rank") <= k)


def latest_per_key(df: DataFrame, keys: list[str], at: str, unique: str) -> DataFrame:
    """The latest row of each key; equal times go to the greatest unique value. Aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, unique)).alias("x"))
    return best.select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def offset_page(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page of a result; size is held to 1..100 and the order must end with a unique column."""
    size = max(1, min(100, size))
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def cursor_page(df: DataFrame, key: str, unique: str, after: tuple | None, size: int = 20) -> DataFrame:
    """Rows after a cursor (key descending, then unique descending), and whether more follow.

    Reads one row beyond the page, so no count of the whole is needed."""
    if after is not None:
        df = df.filter((F.col(key) < after[0]) | ((F.col(key) == after[0]) & (F.col(unique) < after[1])))
    rows = df.orderBy(F.col(key).desc_nulls_first(), F.col(unique).desc()).limit(size + 1)
    n = F.row_number().over(W.orderBy(F.col(key).desc_nulls_first(), F.col(unique).desc()))
    rows = rows.withColumns({"n": n, "has_more": F.count("*").over(W.partitionBy()) > size})
    return rows.filter(F.col("n") <= size).drop("n")


def search(df: DataFrame, columns: list[str], text: str, case: bool = False, least: int = 2) -> DataFrame:
    """Rows in which a column contains the text literally; a text of under `least` letters finds none."""
    if len(text) < least:
        return df.limit(0)
    found = F.lit(False)
    for c in columns:
        found = found | (F.col(c).contains(text) if case else F.lower(c).contains(text.lower()))
    return df.filter(found)


def mode_first_seen(df: DataFrame, parent: str, value: str, pos: str) -> DataFrame:
    """The most frequent value of a parent; of equally frequent ones that seen first, then the greatest."""
    counts = df.groupBy(parent, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(parent).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"), F.col(value))).alias(value), F.max("n").alias("n"))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    return {name: df.join(gone.select(F.col(key).alias(own)), own, "left_anti") for name, (df, own) in tables.items()}


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key is not in new, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def resolve(ids: DataFrame, first: DataFrame, second: DataFrame, key: str, first_key: str, second_key: str, found: str) -> DataFrame:
    """Looks an id up by one key, else by another."""
    a = first.select(F.col(first_key).alias(key), F.col(found).alias("a"))
    b = second.select(F.col(second_key).alias(key), F.col(found).alias("b"))
    return ids.join(a, key, "left").join(b, key, "left").withColumn(found, F.coalesce("a", "b")).drop("a", "b")
