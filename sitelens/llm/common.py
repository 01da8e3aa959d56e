"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an Arrow batch may hold, so that batches of long texts or large groups stay small.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: The ASCII white space that separates words.
WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of this machine is
    set only where the setting is absent, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sitelens-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def keyed(docs: DataFrame, row: str) -> DataFrame:
    """docs with a number of its own for each row, that stays the same whenever docs is read.

    Files give the same rows in the same order each time; anything else is written first."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return stored(docs.withColumn(row, F.monotonically_increasing_id()))
    return docs.withColumn(row, F.monotonically_increasing_id())


#: What stored() has written and release() has not deleted.
_stored: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all that stored() has written; for when everything made of it is written."""
    while _stored:
        delete(spark, _stored.pop())


def forget(df: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing reads any more."""
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        delete(df.sparkSession, file.get())


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again, so that its rows no longer change."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], n: int) -> list[str]:
    """n names that no column has, in any case."""
    taken, names = {c.lower() for c in columns}, (f"own_{k}" for k in itertools.count())
    return list(itertools.islice((x for x in names if x not in taken), n))


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def white_words(text: Column) -> Column:
    """The words between ASCII white space, as an array without empty strings."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """How many such words there are, without building them: each run becomes one character."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{WHITE}]+", "x")
    return F.length(F.regexp_replace(marks, f"[{WHITE}]+", "")).cast("long")
