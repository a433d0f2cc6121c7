"""Queries on streams of several chunks, each run begun again from the checkpoint, and on growing files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..streaming import live, state, tail
from ..streaming.store import SessionStore
from . import oracle as O
from . import render
from .registry import query

CHUNKS = 4


def scratch(spark: SparkSession, name: str) -> str:
    return f"{live.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def into(folder: str, number: int) -> Callable[[DataFrame, int], None]:
    """Writes the rows of a run, by run and batch; a batch that is run again replaces itself."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/run={number}/batch={n}")


def drained(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema.add("run", "integer").add("batch", "long")).parquet(f"{folder}/out")


def user() -> Column:
    return F.substring("session_id", 2, 20).cast("long")


def chunk() -> Column:
    """The chunk in which an event arrives: a session's events arrive in no order, and some sessions late."""
    return (F.floor(F.col("seq") / 3) + user()) % CHUNKS


_CHUNK = f"(seq // 3 + user_id) % {CHUNKS}"


def arriving(events: DataFrame, folder: str) -> Iterator[int]:
    """Lands the chunks in ``folder``/in, one at each step; the events are made once, and held by chunk until then."""
    held = f"{folder}/held"
    events.withColumn("arrives", chunk()).write.partitionBy("arrives").parquet(held)
    rows = events.sparkSession.read.schema(events.withColumn("arrives", F.lit(0)).schema).parquet(held)
    for k in range(CHUNKS):
        rows.where(F.col("arrives") == k).select(*events.columns).write.mode("append").parquet(f"{folder}/in")
        yield k


def in_chunks(events: DataFrame, operator: Callable[[DataFrame], DataFrame], mode: str = "update") -> DataFrame:
    """What a stream gives, by run, when chunk after chunk lands."""
    spark, folder = events.sparkSession, scratch(events.sparkSession, "chunks")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    for k in arriving(events, folder):
        out = operator(live.landing(spark, f"{folder}/in", schema))
        live.run_once(out, folder, into(folder, k), mode)
    return drained(spark, folder, out.schema)


_FOUND = f"""cu AS (SELECT *, {_CHUNK} AS chunk FROM ev WHERE stream = 'main'),
fd AS (SELECT session_id, any_value(user_id) AS user_id, any_value(provider) AS provider, chunk, count(*) AS n FROM cu GROUP BY session_id, chunk)"""
_FOUND_ROWS = """SELECT session_id, provider, chunk::INT AS run, row_number() OVER w = 1 AS is_new, (sum(n) OVER w)::BIGINT AS event_count, true AS dated FROM fd {} WINDOW w AS (PARTITION BY session_id ORDER BY chunk)"""
_SHOWN = ("session_id", "provider", "run", "is_new", "event_count", "modified is not null as dated")


@query(O.on_events(_FOUND_ROWS.format(""), _FOUND), on="events")
def discovery_stream(e: DataFrame):
    return in_chunks(e, state.discovery).selectExpr(*_SHOWN)


@query(O.on_events(_FOUND_ROWS.format("WHERE user_id % 3 = 1 AND user_id % 7 <> 0"), _FOUND), on="events")
def discovery_of_project(e: DataFrame):
    known = e.where(user() % 7 != 0).select("session_id", F.concat(F.lit("p"), user() % 3).alias("project_hash")).distinct()
    return in_chunks(e, lambda s: state.discovery(s, known, "p1")).selectExpr(*_SHOWN)


@query(O.on_events("""SELECT session_id, run::INT AS run, count(*) FILTER (type = 'tool_result' AND is_error AND seq > began) AS error_count FROM
  (SELECT b.session_id, r.run, v.type, v.is_error, v.seq, coalesce(max(v.seq) FILTER (v.type IN ('user', 'slash_command')) OVER (PARTITION BY b.session_id, r.run), -1) AS began
   FROM (SELECT DISTINCT session_id, chunk FROM cu) b JOIN (SELECT DISTINCT chunk AS run FROM cu) r ON b.chunk = r.run JOIN cu v ON v.session_id = b.session_id AND v.chunk <= r.run) GROUP BY ALL""", _FOUND), on="events")
def live_errors(e: DataFrame):
    return in_chunks(e, state.live_errors).select("session_id", "run", "error_count")


@query(O.on_tables("SELECT session_id, stream, turn_index, step_index, status, tokens FROM steps"), on="events")
def live_sessions(e: DataFrame):
    """Sessions assembled again as chunks arrive, from a store that is read and replaced by bucket."""
    spark, folder = e.sparkSession, scratch(e.sparkSession, "live")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    store = SessionStore(spark, f"{folder}/store", schema, buckets=16)
    for _ in arriving(e, folder):
        live.run_once(live.landing(spark, f"{folder}/in", schema).select(*e.columns), folder, store.writer(), "append")
    return store.read("steps").select("session_id", "stream", "turn_index", "step_index", "status", "tokens")


_LINES = """ln AS (SELECT session_id, event_id, user_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY session_id) AS c FROM ev WHERE type <> 'token_usage')"""


@query(O.on_events("""SELECT session_id, event_id, 1 AS run FROM ln WHERE 2 * n <= c + 1
  UNION ALL SELECT session_id, event_id, 2 FROM ln WHERE CASE WHEN user_id % 5 = 0 AND c >= 10 THEN n = c ELSE 2 * n > c + 1 END""", _LINES), on="events")
def tail_source(e: DataFrame):
    """Files that hold their first half and a piece of the next line, then grow or are replaced by shorter ones, then stay: each line comes once, in the run that ends it."""
    spark, folder = e.sparkSession, scratch(e.sparkSession, "tail")
    by_file = render.in_order("path", "line_no")
    lines = render.claude_lines(e).withColumn("n", F.row_number().over(by_file)).withColumn("c", F.count(F.lit(1)).over(by_file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    half, users = F.floor((F.col("c") + 1) / 2), F.substring("path", 2, 20).cast("long")
    whole = F.col("n") <= half
    begun = lines.where(F.col("n") <= half + 1).select("path", "line_no", F.when(whole, F.col("value")).otherwise(F.expr("left(value, length(value) div 2)")).alias("value"), F.when(whole, "\n").otherwise("").alias("end"))
    later = lines.where(~((users % 5 == 0) & (F.col("c") >= 10)) | (F.col("n") == F.col("c")))
    for number, content in ((1, begun), (2, later), (3, None)):
        if content is not None:
            render.write_files(content, f"{folder}/logs")
        stream = tail.tail_lines(spark, f"{folder}/logs", "*.jsonl", bytes_per_task=4096)
        live.run_once(stream, folder, into(folder, number), "append")
    rows = drained(spark, folder, stream.schema)
    return rows.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_id"), F.get_json_object("value", "$.uuid").alias("event_id"), "run")
