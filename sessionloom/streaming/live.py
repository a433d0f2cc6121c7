"""Live sessions with Structured Streaming.

Logs arrive as immutable chunks in a landing folder (files that grow are in
:mod:`tail`).  Running state is a streaming aggregation in update mode; state
that ends is in :mod:`state`, and whole sessions, assembled again by the same
plan as in batch, are in :mod:`store`.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one on a local master where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(rows: DataFrame) -> DataFrame:
    """The same rows read from a table, for plans that ask for them more than once."""
    folder = f"{shared_dir(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def landing(spark: SparkSession, folder: str, schema: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of event rows from Parquet chunks that land in ``folder``, with the chunk's name and time."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(folder)
    return rows.select("*", F.col("_metadata.file_path").alias("chunk"), F.col("_metadata.file_modification_time").alias("chunk_time"))


def watch(events: DataFrame, provider: str | None = None, session: str | None = None) -> DataFrame:
    """The stream of one provider's events, or of the sessions whose id is or starts with ``session``; all of them by default."""
    if provider is not None:
        events = events.where(F.col("provider") == provider)
    return events if session is None else events.where(F.col("session_id").startswith(session))


def landing_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of raw log lines (path, value) from text chunks that land in ``folder``."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("path"), "value")


def live_state(events: DataFrame) -> DataFrame:
    """Per session, of its main stream: last activity, events, turns so far, and the latest usage, model and context limit.  For update mode."""
    e = events.where("stream = 'main'")
    opens = F.col("type").isin("user", "slash_command")
    usage = F.when(F.col("type") == "token_usage", F.col("seq"))
    latest = {n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in ("model", "context_limit") if n in events.columns}
    return e.groupBy("session_id").agg(
        F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("event_count"), F.count_if(opens).alias("turn_count"),
        F.max_by("tok_uncached", usage).alias("fresh_input"), F.max_by("tok_cached", usage).alias("cache_read"), F.max_by("tok_generated", usage).alias("output"), *latest.values())


def token_rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """An addition: tokens by tumbling window of event time, for append mode."""
    return events.withWatermark("ts", late).where("type = 'token_usage'").groupBy(F.window("ts", window).alias("w"), "provider").agg(
        F.sum(F.col("tok_uncached") + F.col("tok_generated")).alias("tokens")).select(F.col("w.start").alias("start"), "provider", "tokens")


def activity_bursts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An addition: bursts of a session's events without a gap of that length, for append mode."""
    return events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        "session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_once(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """One run over what has arrived, from the checkpoint in ``folder`` on; ``write`` gets each batch and its number.

    State with timers or a time to live asks for batches without data for ever,
    so that these are off here: it ends in the next batch that has data."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
    query.awaitTermination()
    return query


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what has arrived, and gives its last result (complete mode) or all its rows by ``batch``, written to the folder that all executors share."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # by number, so that a batch that is run again replaces itself
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

    schema = stream.schema
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/out")
    return out.drop("batch") if mode == "complete" else out


def latest(drained: DataFrame, *keys: str) -> DataFrame:
    """Of a stream drained in update mode, the last row of each key."""
    values = [c for c in drained.columns if c not in (*keys, "batch")]
    return drained.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")
