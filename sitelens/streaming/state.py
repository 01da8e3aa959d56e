"""Streams over append-only tables. Each result is also what the batch form gives on the same rows."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet" if _is_folder(spark, f"{sf_dir}/{name}.parquet") else f"{sf_dir}/{name}*.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share; one of this machine only where the session runs on it alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='sitelens-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def appended(spark: SparkSession, stream: DataFrame, at: str | None = None) -> DataFrame:
    """Runs a stream of final rows over what is there now and returns all so far; with the folder of an earlier run it goes on
    from there."""
    at = at or folder(spark)
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").format("parquet").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class ReadModel:
    """Rows by key that batches of changed rows keep up to date: the last batch of a key holds.

    A batch is written to a folder of its own, whose number a repeated batch overwrites. After every `every` batches all that came before is
    merged into one base by a shuffle on the keys; a base of number n holds the batches up to n, and what the base before it
    replaced is deleted then, so a reader of the last base still finds its files. A folder counts once Spark has put
    its success mark, so a merge that was broken off is as if it had not begun. There are at most two bases and twice
    `every` batches at any time.
    """

    def __init__(self, spark: SparkSession, at: str, keys: list[str], schema, every: int = 10):
        self.spark, self.at, self.keys, self.schema, self.every = spark, at.rstrip("/"), keys, schema, every

    def numbers(self, kind: str) -> list[int]:
        """Numbers of the whole folders of a kind, in order."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        whole = [n for n in names if n.startswith(f"{kind}-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{n}/_SUCCESS"))]
        return sorted(int(n.rpartition("-")[2]) for n in whole)

    def path(self, kind: str, number: int) -> str:
        return f"{self.at}/{kind}-{number:012d}"

    def put(self, batch: DataFrame, number: int) -> None:
        """Takes a batch; the function that foreachBatch calls."""
        batch.write.mode("overwrite").parquet(self.path("batch", number))
        if (number + 1) % self.every == 0:
            self.compact(number)

    def rows(self, upto: int | None = None, before: int | None = None) -> DataFrame:
        """One row a key, of the last base under `before` and the batches since, up to a number."""
        base = max((n for n in self.numbers("base") if before is None or n < before), default=-1)
        since = [n for n in self.numbers("batch") if n > base and (upto is None or n <= upto)]
        read = lambda kind, n: self.spark.read.schema(self.schema).parquet(self.path(kind, n)).withColumn("batch_number", F.lit(n).cast("long"))
        frames = [read("base", n) for n in [base] if n >= 0] + [read("batch", n) for n in since]
        if not frames:
            return self.spark.createDataFrame([], self.schema)
        names = self.schema.names
        rest = [c for c in names if c not in self.keys]
        best = reduce(DataFrame.unionByName, frames).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch_number").alias("kept_row"))
        return best.select(*self.keys, *(F.col("kept_row")[c].alias(c) for c in rest)).select(*names)

    def compact(self, number: int) -> None:
        older = [n for n in self.numbers("base") if n < number]
        self.rows(number, number).write.mode("overwrite").parquet(self.path("base", number))
        last = max(older, default=-1)
        for kind, numbers in (("base", [n for n in older if n < last]), ("batch", [n for n in self.numbers("batch") if n <= last])):
            for n in numbers:
                _delete(self.spark, self.path(kind, n))


def merged(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream of changing rows over what is there now into a read model, and returns its rows."""
    at = folder(spark)
    model = ReadModel(spark, f"{at}/out", keys, stream.schema)
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(model.put).trigger(availableNow=True).start().awaitTermination()
    return model.rows()


def polled(stream: DataFrame, put, at: str, every: str = "3 seconds"):
    """A running query that looks for new rows at an interval and hands each batch of changed ones to put(batch, number)."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(processingTime=every).start()


def latest(events: DataFrame) -> DataFrame:
    """The latest value of each user and type, by time and then id: state of one row a key."""
    best = F.max_by(F.struct("value", "ts", "event_id"), F.struct("ts", "event_id")).alias("x")
    return events.groupBy("user_id", "event_type").agg(best).select("user_id", "event_type", "x.value", "x.ts", "x.event_id")


def first_requests(events: DataFrame, ttl: str = "1 day") -> DataFrame:
    """Days on which a user is seen, each once; state older than the time to live is dropped."""
    return events.withColumn("day", F.date_trunc("day", "ts")).withWatermark("day", ttl).dropDuplicates(["user_id", "day"]).select("user_id", "day")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events of each type by hour, with a watermark for late rows."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def status(events: DataFrame) -> DataFrame:
    """The state of each user's work: an end (completed or failed) stands, by the latest one; before it the latest step."""
    step = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "processing").otherwise("pending")
    ended = F.col("event_type").isin("purchase", "error")
    return events.groupBy("user_id").agg(F.max_by(step, F.struct(ended, "ts", "event_id")).alias("status"), F.max("ts").alias("seen"))
