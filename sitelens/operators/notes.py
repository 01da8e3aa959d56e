"""Notes that are created, edited and deleted by a batch of requests, in order: answers, the notes afterwards, and the flags that reviews set.

A request is answered as if those before it had been carried out: what a note's requests do to each other is a window over the
note, so there is no loop over requests. An unsound body is answered before it is asked whether what it names exists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import requests as R

CREATE, EDIT, DELETE = "create", "edit", "delete"
CREATED, DONE, UNSOUND, UNKNOWN = 201, 200, 400, 404


@dataclass(frozen=True)
class Outcome:
    """answers: request_id, status; notes: as they were given, after the requests; flags: domain_id, risky, of the last review of each."""

    answers: DataFrame
    notes: DataFrame
    flags: DataFrame


def answered(notes: DataFrame, domains: DataFrame, asked: DataFrame) -> Outcome:
    """notes (note_id, domain_id, content, type, decision), domains (domain_id), asked (request_id, at, kind, domain_id, note_id, body).
    Requests go by at, then request_id; a created note has the request's id, with `new-` before it, as its own. Note ids are texts."""
    rows = asked.withColumns({"made": R.body(F.col("body"), R.NEW_NOTE), "change": R.body(F.col("body"), R.NOTE_CHANGE)})
    sound = F.when(F.col("kind") == CREATE, F.col("made.ok")).when(F.col("kind") == EDIT, F.col("change.ok")).otherwise(F.col("kind") == DELETE)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    creates, others = rows.filter(F.col("kind") == CREATE), rows.filter(~F.col("kind").eqNullSafe(F.lit(CREATE)))
    known = domains.select("domain_id").distinct().withColumn("known", F.lit(True))
    creates = creates.join(known, "domain_id", "left").withColumn("status", F.when(~F.col("sound"), UNSOUND).when(F.col("known"), CREATED).otherwise(UNKNOWN))
    held = notes.select("note_id", F.col("domain_id").alias("of_domain")).withColumn("there", F.lit(True))
    others = others.join(held, "note_id", "left").withColumn("there", F.coalesce(F.col("there") & (F.col("of_domain") == F.col("domain_id")), F.lit(False)))
    deletes = F.col("there") & F.col("sound") & (F.col("kind") == DELETE)
    earlier = W.partitionBy("note_id").orderBy("at", "request_id").rowsBetween(W.unboundedPreceding, -1)
    others = others.withColumn("gone", F.coalesce(F.max(deletes).over(earlier), F.lit(False)))
    others = others.withColumn("status", F.when(~F.col("sound"), UNSOUND).when(F.col("there") & ~F.col("gone"), DONE).otherwise(UNKNOWN))
    done = others.filter(F.col("status") == DONE).groupBy("note_id").agg(
        F.max(F.col("kind") == DELETE).alias("deleted"), F.max_by(F.when(F.col("kind") == EDIT, F.col("change.value.content")), F.when(F.col("kind") == EDIT, F.struct("at", "request_id"))).alias("edited"))
    columns = ["note_id", "domain_id", "content", "type", "decision"]
    left = notes.join(done, "note_id", "left").filter(~F.coalesce("deleted", F.lit(False))).withColumn("content", F.coalesce("edited", "content")).select(*columns)
    new = creates.filter(F.col("status") == CREATED).select(F.concat(F.lit("new-"), "request_id").alias("note_id"), "domain_id", F.coalesce("made.value.content", F.lit("")).alias("content"), F.col("made.value.type").alias("type"), F.col("made.value.riskDecision").alias("decision"))
    reviews = creates.filter((F.col("status") == CREATED) & (F.col("made.value.type") == "review"))
    flags = reviews.groupBy("domain_id").agg(F.max_by(F.col("made.value.riskDecision") == "risky", F.struct("at", "request_id")).alias("risky"))
    return Outcome(creates.select("request_id", "status").unionAll(others.select("request_id", "status")), left.unionByName(new), flags)
