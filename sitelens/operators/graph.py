"""Deletes that follow a declared graph of foreign keys: what goes from each table, and what stays.

Edges are data: which column of a child refers to which column of a parent, and whether a deleted parent takes the
child's rows along or leaves them without the reference. Tables are visited parents first; each edge is one semi join that
finds the rows that go, over keys alone, and one anti join, or left join, for those that stay. A null reference refers to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASCADE, SET_NULL = "cascade", "set null"


@dataclass(frozen=True)
class Edge:
    """child.column refers to parent.key."""

    child: str
    column: str
    parent: str
    key: str
    action: str = CASCADE


def in_order(edges: list[Edge]) -> list[str]:
    """Tables, parents first; a cycle is refused with its tables."""
    sorter = TopologicalSorter()
    for e in edges:
        if e.action not in (CASCADE, SET_NULL):
            raise ValueError(f"{e.child}.{e.column}: no action {e.action}")
        sorter.add(e.child, e.parent)
    try:
        return list(sorter.static_order())
    except CycleError as error:
        raise ValueError(f"the tables refer to each other in a circle: {' -> '.join(error.args[1])}") from error


def deleted(tables: dict[str, DataFrame], edges: list[Edge], root: str, gone: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """table -> (rows that stay, rows that go), when the rows `gone` of table `root` are deleted; gone has the columns of root that
    edges refer to. Tables that nothing reaches stay whole."""
    order = in_order(edges)
    if missing := [t for t in order if t not in tables]:
        raise ValueError(f"no such tables: {missing}")
    keys = sorted({e.key for e in edges if e.parent == root})
    going: dict[str, DataFrame] = {root: gone.select(*keys).distinct() if keys else gone}
    match = reduce(lambda a, b: a & b, (F.col(f"kept.{k}").eqNullSafe(F.col(f"gone.{k}")) for k in keys)) if keys else F.lit(False)
    side = lambda how: tables[root].alias("kept").join(going[root].alias("gone"), match, how)
    out = {root: (side("left_anti"), side("left_semi"))}
    for name in order:
        own = [e for e in edges if e.child == name and e.parent in going and name != root]
        if not own:
            out.setdefault(name, (tables[name], tables[name].limit(0)))
            continue
        # A row that goes by two parents goes once: an edge looks only at what the edges before it have left.
        stay, parts, columns = tables[name], [], tables[name].columns
        for e in sorted(own, key=lambda e: e.action == SET_NULL):
            parents = going[e.parent].select(F.col(e.key).alias(e.column)).filter(F.col(e.column).isNotNull()).distinct()
            if e.action == CASCADE:
                parts.append(stay.join(parents, e.column, "left_semi").select(*columns))
                stay = stay.join(parents, e.column, "left_anti").select(*columns)
            else:
                marked = stay.join(parents.withColumn("parent_went", F.lit(True)), e.column, "left")
                stay = marked.withColumn(e.column, F.when(F.col("parent_went").isNull(), F.col(e.column))).select(*columns)
        went = reduce(DataFrame.unionByName, parts) if parts else tables[name].limit(0)
        out[name] = (stay, went)
        below = sorted({e.key for e in edges if e.parent == name})
        if parts and below:
            going[name] = went.select(*below)
    return out
