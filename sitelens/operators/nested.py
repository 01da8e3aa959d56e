"""Parents with the first rows of their relations as arrays of structs, to any depth.

A relation keeps the first k rows of each parent. The limit is applied within each task before the shuffle, so
at most k rows of a parent leave a task, however many it has; the rows that are left are numbered and gathered by the same
partitioning. Where the parents are a page of bounded size, their keys are literals of the scan's filter: relations read
only what the page shows, and theirs only what these show.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational

#: Keys that may be literals of a filter; a relation of more parents is joined.
MOST_KEYS = 10_000


@dataclass(frozen=True)
class Relation:
    """name: of the array; rows; parent: the column that holds the parent's key; key: the rows' own key, for relations below;
    order: ends with a unique column; k: rows of a parent, None for all; shown: columns of the structs."""

    name: str
    rows: DataFrame
    parent: str
    order: list[Column]
    shown: list[str]
    k: int | None = None
    key: str | None = None
    below: list["Relation"] = field(default_factory=list)


def keys_of(rows: DataFrame, key: str) -> list | None:
    """The distinct keys of a page, None where they are more than MOST_KEYS. Reads one more than that at most."""
    found = [r[0] for r in rows.select(key).filter(F.col(key).isNotNull()).distinct().limit(MOST_KEYS + 1).collect()]
    return found if len(found) <= MOST_KEYS else None


def first_rows(relation: Relation, parents: DataFrame | None, key: str | None) -> DataFrame:
    rows = relation.rows
    if parents is not None:
        known = keys_of(parents, key)
        if known is None:
            rows = rows.join(parents.select(F.col(key).alias(relation.parent)).distinct(), relation.parent, "left_semi")
        else:
            rows = rows.filter(F.col(relation.parent).isin(known))
    number = F.row_number().over(relational.W.partitionBy(relation.parent).orderBy(*relation.order))
    rows = rows.filter(F.col(relation.parent).isNotNull()).withColumn("nested_place", number)
    return rows.filter(F.col("nested_place") <= relation.k) if relation.k is not None else rows


def gathered(relation: Relation, parents: DataFrame | None, key: str | None) -> DataFrame:
    """(parent's key, array of structs in order) of one relation with all below it."""
    rows = first_rows(relation, parents, key)
    if relation.below:
        rows = nested(rows, relation.key, relation.below, filtered=parents is not None)
    shown = [*relation.shown, *(b.name for b in relation.below)]
    items = F.array_sort(F.collect_list(F.struct("nested_place", *shown)))
    return rows.groupBy(relation.parent).agg(F.transform(items, lambda x: F.struct(*(x[c].alias(c) for c in shown))).alias(relation.name))


def nested(parents: DataFrame, key: str, relations: list[Relation], filtered: bool = True) -> DataFrame:
    """parents, with an array column for each relation; a parent without rows has an empty one. filtered: the parents are a
    page, and relations are read for its keys only."""
    out = parents
    for relation in relations:
        lists = gathered(relation, parents if filtered else None, key).withColumnRenamed(relation.parent, "nested_key")
        out = out.join(lists, out[key] == F.col("nested_key"), "left").drop("nested_key")
        out = out.withColumn(relation.name, F.coalesce(relation.name, F.array().cast(lists.schema[relation.name].dataType)))
    return out


def cursor_list(parents: DataFrame, order: str, key: str, after: tuple | None, size: int, relations: list[Relation]) -> DataFrame:
    """A page of parents after a cursor (order descending, nulls first, then key descending) with their relations,
    `has_more`, and `next_cursor`: the last row's key where more follow. size is held to 1..100."""
    size = max(1, min(100, size))
    if after is not None:
        at, last = after
        later = (F.col(order) < F.lit(at)) | (F.col(order) == F.lit(at)) & (F.col(key) < F.lit(last)) if at is not None else F.col(order).isNotNull() | (F.col(key) < F.lit(last))
        parents = parents.filter(later)
    rows = parents.orderBy(F.col(order).desc_nulls_first(), F.col(key).desc()).limit(size + 1)
    number = F.row_number().over(relational.W.orderBy(F.col(order).desc_nulls_first(), F.col(key).desc()))  # size + 1 rows
    rows = rows.withColumns({"place": number, "has_more": F.count("*").over(relational.W.partitionBy()) > size}).filter(F.col("place") <= size)
    rows = rows.withColumn("next_cursor", F.when(F.col("has_more"), F.last(key).over(relational.W.orderBy("place").rowsBetween(relational.W.unboundedPreceding, relational.W.unboundedFollowing))))
    return nested(rows, key, relations)
