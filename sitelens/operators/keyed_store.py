"""Get or create by content key: what was once computed for a key is kept, and only unknown keys are computed.

The store is a table bucketed by its key, so a run shuffles what it asks for and never what is stored: the anti join that finds unknown
keys and the join that reads values take the stored buckets as they lie. A run asks for each key once, however many rows have
it, computes the unknown ones and appends them with the run's number; a row's value is `reused` where its number is an
earlier one. One run writes at a time; a run that breaks off leaves the keys that it committed, and the next computes the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """columns: of the values, as in a schema's text; path: a folder that all executors share; name: of the table in this session;
    buckets: as many as shuffle partitions at least, or Spark shuffles the store to their number."""

    def __init__(self, spark: SparkSession, name: str, path: str, key: str, columns: str, buckets: int = 16):
        self.spark, self.name, self.path, self.key, self.columns, self.buckets = spark, name, path, key, columns, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({key} STRING, {columns}, run INT) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, wanted: DataFrame) -> DataFrame:
        """wanted (key, what values are made of) -> one row of each key that is not stored; rows without a key are left out."""
        rest = [c for c in wanted.columns if c != self.key]
        one = wanted.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(*(F.first(c).alias(c) for c in rest))
        return one.join(self.table().select(self.key), self.key, "left_anti")

    def ensure(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Computes and stores the unknown keys of wanted; returns the number of this run. compute: rows of unknown() -> key and columns."""
        run = (self.table().agg(F.max("run")).first()[0] or 0) + 1
        names = self.table().columns
        new = compute(self.unknown(wanted)).withColumn("run", F.lit(run)).select(*names)
        new.repartition(self.buckets, self.key).sortWithinPartitions(self.key).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return run

    def get_or_create(self, rows: DataFrame, made_of: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows with their values and `reused`; rows without a key have nulls. made_of: the columns that compute reads."""
        run = self.ensure(rows.select(self.key, *made_of), compute)
        return rows.join(self.table().withColumn("reused", F.col("run") < run).drop("run"), self.key, "left")

    def compact(self, path: str) -> "KeyedStore":
        """The same rows in a new store at path, a file a bucket."""
        new = KeyedStore(self.spark, f"{self.name}_c", path, self.key, self.columns, self.buckets)
        self.table().select(*new.table().columns).repartition(self.buckets, self.key).sortWithinPartitions(self.key).write.insertInto(new.name)
        self.spark.catalog.refreshTable(new.name)
        return new
