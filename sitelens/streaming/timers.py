"""Streams whose state has event-time timers: work that turns stale by itself, and a cache whose entries end.

Both processors keep one small value a key and set one timer; when the watermark passes it, the value is removed. So state holds
only keys with open work or a live entry, however long the stream runs. Rows of a key are taken in order of time
and id within a batch; a gap inside a batch ends what the timer would have ended between batches, so the
result does not depend on how rows fall into batches, as long as none is later than the watermark. Later rows are dropped
by Spark, as in any stream with a watermark. Rows without a key, a time or an id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: How long a step counts as in progress and how long a stored fetch serves, in microseconds, and how late rows may come.
FRESH, KEPT, LATE = 5 * 60 * 1_000_000, 24 * 3600 * 1_000_000, "10 minutes"
ENDS = ("completed", "failed")
#: The state store that processors with timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds inside: a time that comes back from state has a zone, one of a row has none.
STEP = "key long, event_id long, at long, status string, stale boolean"
REQUEST = "key long, event_id long, at long, stored_at long, fetched boolean"


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r["micros"], r["event_id"]))


class Work(StatefulProcessor):
    """Steps of a key's work -> its changes of status, and `stale` when no step follows within FRESH of one that is no end.

    An end (ENDS) or staleness removes the value; the next step begins anew. The value is the open step: its
    status, id and time.
    """

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "status string, event_id long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.open.get() if self.open.exists() else None
        was = before
        for row in in_order(rows):
            if before is not None and row["micros"] - before[2] > FRESH:
                yield self.stale(key, before)
                before = None
            if before is None or row["status"] != before[0]:
                yield Row(key=key[0], event_id=row["event_id"], at=row["micros"], status=row["status"], stale=False)
            before = None if row["status"] in ENDS else (row["status"], row["event_id"], row["micros"])
        if was is not None:
            self.handle.deleteTimer((was[2] + FRESH) // 1000)
        if before is None:
            self.open.clear()
        else:
            self.open.update(before)
            self.handle.registerTimer((before[2] + FRESH) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            yield self.stale(key, self.open.get())
            self.open.clear()

    @staticmethod
    def stale(key, before) -> Row:
        return Row(key=key[0], event_id=before[1], at=before[2] + FRESH, status=before[0], stale=True)

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """Requests of a key -> each request with the time of the fetch that serves it, and whether it was that fetch.

    A stored fetch serves for KEPT, counted from the fetch and not from the last request. Spark's own time to live counts
    processing time, so a replay of old rows would serve what had long ended; here the timer is in event time.
    """

    def init(self, handle) -> None:
        self.handle, self.stored = handle, handle.getValueState("stored", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.stored.get()[0] if self.stored.exists() else None
        was = stored
        for row in in_order(rows):
            fetched = stored is None or row["micros"] - stored > KEPT
            stored = row["micros"] if fetched else stored
            yield Row(key=key[0], event_id=row["event_id"], at=row["micros"], stored_at=stored, fetched=fetched)
        if stored != was:
            if was is not None:
                self.handle.deleteTimer((was + KEPT) // 1000)
            self.stored.update((stored,))
            self.handle.registerTimer((stored + KEPT) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.stored.clear()
        return iter(())

    def close(self) -> None:
        pass


def processed(stream: DataFrame, processor: StatefulProcessor, schema: str, late: str = LATE) -> DataFrame:
    """stream (key long, event_id long, at timestamp, ...) through a processor, by key and event time."""
    spark: SparkSession = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.filter("key IS NOT NULL AND event_id IS NOT NULL AND at IS NOT NULL").withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    out = rows.groupBy("key").transformWithState(processor, schema, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "stored_at") if c in out.columns})


def work(events: DataFrame, late: str = LATE) -> DataFrame:
    """Scans of events (event_id, user_id, event_type, ts) as changes of status of each user's work."""
    kind = F.col("event_type")
    status = F.when(kind.isin("purchase", "signup"), "completed").when(kind == "error", "failed").when(kind == "click", "processing").otherwise("pending")
    steps = events.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("at"), status.alias("status"))
    return processed(steps, Work(), STEP, late)


def requests(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events (event_id, user_id, ts) as requests for each user's page."""
    asked = events.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("at"))
    return processed(asked, Cache(), REQUEST, late)
