"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import bpe, language_id, mixing, near_dedup, quality_classifier
from sitelens.llm.common import delete, release, shared_folder, table

#: (name, function); a function takes (spark, docs, sf_dir).
STAGES = [
    ("language", language_id.stage),
    ("quality", quality_classifier.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]
#: Trained and iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again, and deleted once the
    next one is written. The last one's files stay, as the result reads them."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        release(spark)
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
