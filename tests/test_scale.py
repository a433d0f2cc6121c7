"""Work that must not grow faster than the input: what is made how often, and how much state, code and listing it takes."""

import datetime
import re
from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import analyze
from sessionloom.operators.assemble import assemble
from sessionloom.plans import index_queries, live_queries, log_queries, render
from sessionloom.plans.bridge import bridged
from sessionloom.sources import ingest
from sessionloom.streaming import live, state, store

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def counted(spark):
    """A function that gives events, and the number of rows that were made of them since."""
    def of(events):
        made = spark.sparkContext.accumulator(0)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made.add(batch.num_rows)
                yield batch
        return events.mapInArrow(count, events.schema), made
    return of


def test_chunks_are_made_once(spark, tmp_path, counted):
    events = bridged(spark, SF)
    rows, made = counted(events)
    landed = []
    for k in live_queries.arriving(rows, str(tmp_path)):
        landed.append(spark.read.parquet(f"{tmp_path}/in").count())
    n = events.count()
    assert made.value == n == landed[-1] and landed == sorted(landed)
    assert spark.read.parquet(f"{tmp_path}/in").select(*events.columns).exceptAll(events).count() == 0


def test_state_is_asked_by_session(spark):
    """The rows that a batch brings to the state are its sessions, each with its events' count and bounds."""
    rows = [("a", "codex", 5, 9), ("b", "gemini", 7, 9), ("a", "codex", 3, 8), ("a", "codex", None, None)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("session_id", "provider", "ts", "chunk_time"), r)) for r in rows],
                                       pa.schema([("session_id", pa.string()), ("provider", pa.string()), ("ts", pa.int64()), ("chunk_time", pa.int64())]))
    out = sorted((tuple(r.values()) for b in state.by_session(iter([batch])) for r in b.to_pylist()), key=str)
    assert out == [("a", "codex", 3, 5, 9, 3), ("b", "gemini", 7, 7, 9, 1)]


def test_silent_sessions_are_forgotten_by_their_last_word(spark, tmp_path):
    """A session that speaks again before its time is over stays known; one that doesn't is new when it speaks later."""
    import time
    schema = "session_id string, provider string, stream string, ts timestamp"
    at, told = datetime.datetime(2024, 1, 1), []

    def lands(*sessions):
        spark.createDataFrame([(s, "codex", "main", at) for s in sessions], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = []
        live.run_once(state.discovery(live.landing(spark, f"{tmp_path}/in", schema), idle_ms=60_000), str(tmp_path), lambda b, n: got.extend(b.collect()))
        told.append({(r["session_id"], r["is_new"], r["event_count"]) for r in got})

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        began = time.time()
        lands("a", "b")
        time.sleep(max(0, 35 - (time.time() - began)))
        lands("a")
        time.sleep(max(0, 65 - (time.time() - began)))
        lands("c")  # ends b, not a
        lands("a", "b")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert told[0] == {("a", True, 1), ("b", True, 1)} and told[1] == {("a", False, 2)}
    assert told[3] == {("a", False, 3), ("b", True, 1)}


def test_batch_is_stored_from_one_read(spark, tmp_path, counted):
    events = bridged(spark, SF)
    rows, made = counted(events)
    s = store.SessionStore(spark, str(tmp_path), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema), buckets=8)
    touched = s.add(rows, 0)
    assert made.value == events.count()
    assert touched == sorted(r[0] for r in events.select(s.bucket()).distinct().collect())


def test_globs_list_folders(spark, tmp_path):
    """A glob of file names is one listing of its folder, not one of each file, and means the same files as before."""
    for name in ("a/s1.jsonl", "a/s2.jsonl", "a/x.txt", "a/below/s3.jsonl", "b/s4.jsonl", "b/s7.jsonl", "b/y.txt", "p/s5.jsonl", "p/day=1/s6.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('{"n":1}\n')

    def names(frame):
        return sorted(r[0].rpartition("/")[2] for r in frame.select("path").collect())

    def roots(frame):
        return frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    one, two = ingest.read_lines(spark, f"{tmp_path}/b/*.jsonl"), ingest.read_documents(spark, f"{tmp_path}/a/*.jsonl", f"{tmp_path}/b/*.jsonl")
    assert names(one) == ["s4.jsonl", "s7.jsonl"] and "b/s4.jsonl" not in roots(one)
    assert names(two) == ["s1.jsonl", "s2.jsonl", "s4.jsonl", "s7.jsonl"]
    assert names(ingest.read_lines(spark, f"{tmp_path}/?/*.jsonl")) == ["s1.jsonl", "s2.jsonl", "s4.jsonl", "s5.jsonl", "s7.jsonl"]
    assert names(ingest.read_lines(spark, f"{tmp_path}/p/*.jsonl")) == ["s5.jsonl"]
    assert names(ingest.read_lines(spark, f"{tmp_path}/p/d*")) == ["s6.jsonl"] and names(ingest.read_lines(spark, f"{tmp_path}/a/b*")) == ["s3.jsonl"]


@pytest.mark.parametrize("lines", [render.claude_lines, render.codex_lines, log_queries.broken_lines])
def test_code_of_rendered_lines_is_compiled(spark, lines):
    """No method of a row's code is over the 8,000 bytes beyond which the JVM only interprets."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lines(bridged(spark, SF))._jdf.queryExecution().executedPlan()
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sizes and max(sizes) < 8000, sizes


def test_checked_lines_are_made_once(spark, counted):
    events = bridged(spark, SF)
    rows, made = counted(events)
    assert log_queries.check_file(rows).count() > 0
    assert made.value == events.count()


def test_headers_are_made_once(spark, counted):
    """Both catalogues that write_index stores, with three tables each, come from one reading of the events."""
    events = bridged(spark, SF)
    rows, made = counted(events)
    assert index_queries.write_index(rows).count() == 1
    assert made.value == events.count()


def test_insights_put_events_in_order_once(spark):
    """All checks look at one row of a turn: the events are read once, and the checks are no frames of their own."""
    a = assemble(bridged(spark, SF))
    plan = analyze.insights(a)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Union" not in plan
    found = analyze.insights(a)
    for name, check in (("failures", analyze.analyze_failures), ("loops", analyze.analyze_loops), ("bottlenecks", analyze.analyze_bottlenecks)):
        alone = sorted(map(str, check(a).collect()))
        assert alone == sorted(map(str, found.where(F.col("diagnostic") == name).collect()))


def test_third_format_documents(spark):
    """Documents are put together of messages that are JSON already, and only what an event is made of is exploded, not an array of whole events."""
    rows = [("s0", 1, "user", 'say "a, b"\n]}', "m1"), (None, 2, "message", "no session", "m1"), ("s0", 3, "message", "", "m1")]
    one = spark.createDataFrame(rows, "session_id string, seq long, type string, text string, model string")
    events = bridged(spark, SF)
    one = one.select(F.col("seq").cast("string").alias("event_id"), F.current_timestamp().alias("ts"), "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name not in (*one.columns, "event_id", "ts")])
    docs = render.gemini_documents(one)
    assert not re.search("parse_?json", docs._jdf.queryExecution().optimizedPlan().toString(), re.I)
    made = {r.path: r.d for r in docs.select("path", F.from_json("value", "sessionId string, messages array<struct<type: string, id: string, content: string>>").alias("d")).collect()}
    assert [tuple(m) for m in made["s0"].messages] == [("user", "m1", 'say "a, b"\n]}'), ("gemini", "m3", "")] and made["s0"].sessionId == "s0"
    assert made[None].sessionId is None and [m.content for m in made[None].messages] == ["no session"]
    plan = ingest.gemini_events(render.gemini_documents(events))._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert len(exploded) == 2 and not any("slash_name" in line or "tok_cached" in line for line in exploded)
