"""State of live sessions that ends: errors since the last turn, and sessions discovered.

Both keep their state in Spark's state store (RocksDB) with a time to live: a
session that is silent for ``idle`` is forgotten, and is new when it speaks
again.  Batches may bring events in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 7 * 24 * 3600 * 1000


def use_rocks(spark: SparkSession) -> None:
    """State with several variables needs this store; queries that are started later use it, those with a checkpoint keep their own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Errors(StatefulProcessor):
    """The place where a session's last turn began, and the places of failed results behind it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.began = handle.getValueState("began", "seq long", self.idle_ms)
        self.failed = handle.getListState("failed", "seq long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        began = self.began.get()[0] if self.began.exists() else -1
        new = []
        for r in rows:
            if r["opens"]:
                began = max(began, r["seq"])
            elif r["seq"] > began:
                new.append(r["seq"])
        held = [s for (s,) in self.failed.get()] if self.failed.exists() else []
        held = [s for s in (*held, *new) if s > began]
        self.began.update((began,))
        if held:
            self.failed.put([(s,) for s in held])
        else:
            self.failed.clear()
        yield Row(session_id=key[0], error_count=len(held))

    def close(self) -> None:
        pass


def live_errors(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Per session, failed results of its main stream since its last turn began; rows (session_id, error_count) as a micro-batch touches them, for update mode."""
    use_rocks(events.sparkSession)
    opens = F.col("type").isin("user", "slash_command")
    failed = (F.col("type") == "tool_result") & F.col("is_error")
    rows = events.where("stream = 'main'").select("session_id", "seq", opens.alias("opens"), F.coalesce(failed, F.lit(False)).alias("failed"))
    # Events that neither open a turn nor fail say that the session is alive, and no more: they come as an opening before all places.
    rows = rows.select("session_id", F.when(F.col("opens") | F.col("failed"), F.col("seq")).otherwise(-1).alias("seq"), (~F.col("failed")).alias("opens"))
    return rows.groupBy("session_id").transformWithState(Errors(idle_ms), "session_id string, error_count long", "update", "ProcessingTime")


def by_session(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events to one row a session of each batch of rows, so that state is asked about sessions and not about events."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by("session_id").aggregate(
            [("provider", "max"), ("ts", "min"), ("ts", "max"), ("chunk_time", "max"), ([], "count_all")])
        columns = ("session_id", "provider_max", "ts_min", "ts_max", "chunk_time_max", "count_all")
        yield from pa.table([t[c] for c in columns], names=["session_id", "provider", "first", "last", "modified", "events"]).to_batches()


def _of(choose: Callable, *values: int | None) -> int | None:
    return choose((v for v in values if v is not None), default=None)


class Discovery(StatefulProcessor):
    """What is known of a session, with times in microseconds, and when it was heard of last.

    A timer is set when a session is new, and again when it ends and the session
    has spoken since: a batch moves no timers."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "first long, last long, events long")
        self.seen = handle.getValueState("seen", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, now = self.known.get(), timerValues.getCurrentProcessingTimeInMs()
        first, last, n = (None, None, 0) if known is None else known
        modified, provider = None, None
        for r in rows:
            first, last, modified = _of(min, first, r["first"]), _of(max, last, r["last"]), _of(max, modified, r["modified"])
            provider, n = r["provider"], n + r["events"]
        self.known.update((first, last, n))
        if known is None:
            self.handle.registerTimer(now + self.idle_ms)
        else:
            self.seen.update((now,))
        yield Row(session_id=key[0], provider=provider, is_new=known is None, modified=modified, first_activity=first, last_activity=last, event_count=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen = self.seen.get()  # none if it has not spoken again
        until = 0 if seen is None else seen[0] + self.idle_ms
        if until > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(until)
        else:
            self.known.clear()
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def discovery(events: DataFrame, sessions: DataFrame | None = None, project: str | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """A row for each session that a micro-batch touches: provider, ``is_new`` (not known before), when its newest chunk was written, first and last activity and events so far.

    Sidechains alone don't make a session known.  With ``project`` (a hash) only
    sessions that ``sessions`` (session_id, project_hash) tells to be that
    project's are reported; those that it doesn't know are passed over."""
    use_rocks(events.sparkSession)
    micros = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("ts", "chunk_time")]
    main = events.where("stream = 'main'").select("session_id", "provider", *micros)
    if project is not None:
        main = main.join(sessions.where(F.col("project_hash") == project).select("session_id").distinct(), "session_id")
    rows = main.mapInArrow(by_session, "session_id string, provider string, first long, last long, modified long, events long")
    told = rows.groupBy("session_id").transformWithState(
        Discovery(idle_ms), "session_id string, provider string, is_new boolean, modified long, first_activity long, last_activity long, event_count long", "update", "ProcessingTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("modified", "first_activity", "last_activity")})
