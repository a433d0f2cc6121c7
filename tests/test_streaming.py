"""Streams against the same operators in batch."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from sessionloom.operators.assemble import assemble
from sessionloom.plans import render
from sessionloom.plans.bridge import bridged
from sessionloom.sources import ingest
from sessionloom.streaming import live, state, store, tail


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("land") / "events")
    events = bridged(spark, "/root/testdata/sf0.001")
    for k in range(3):  # chunks in order of time
        events.where(F.floor(F.col("seq") / 8) % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    return folder, events


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_live_state_equals_batch(spark, landed):
    folder, events = landed
    stream = live.landing(spark, folder, events.schema.simpleString()[7:-1].replace(":", " "), 1)
    rows = run(spark, live.live_state(stream), "state", "complete").collect()
    want = live.live_state(events).collect()
    assert sorted(map(str, rows)) == sorted(map(str, want)) and want


def chunks(spark, folder, schema, operator, frames, path):
    """Rows that an operator gives, chunk by chunk."""
    out = []
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(folder)
        run = []
        stream = operator(live.landing(spark, folder, schema))
        q = live.run_once(stream, str(path), lambda b, n: run.extend(b.collect()))
        out.append((run, q.lastProgress))
    return out


def test_store_by_bucket(spark, landed, tmp_path):
    """Steps of each batch are those of a batch plan over what has arrived; untouched buckets aren't read or written, and a repeated batch changes nothing."""
    folder, events = landed
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    kept = store.SessionStore(spark, str(tmp_path / "store"), schema, buckets=8)
    each = kept.writer(("steps", "turns"))

    def steps(df):
        return sorted(map(str, df.select("session_id", "stream", "turn_index", "step_index", "status", "tokens", "tool_count").collect()))

    some = [r.session_id for r in events.select("session_id").distinct().orderBy("session_id").limit(2).collect()]
    parts = [events.where(F.col("seq") % 2 == 0), events.where((F.col("seq") % 2 == 1) & F.col("session_id").isin(some)), events.where((F.col("seq") % 2 == 1) & ~F.col("session_id").isin(some))]
    upto = events.where("false")
    for n, part in enumerate(parts):
        before = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/store/steps/*/*.parquet")}
        each(part, n)
        upto = upto.unionByName(part)
        assert steps(kept.read("steps")) == steps(assemble(upto).steps)
        if n == 1:  # two sessions: two buckets at most are written
            touched = {os.path.dirname(f) for f in glob.glob(f"{tmp_path}/store/steps/*/*.parquet") if f not in before}
            assert 1 <= len(touched) <= 2
            buckets = sorted(int(t.rpartition("=")[2]) for t in touched)
            read = kept.events(buckets).inputFiles()
            assert read and all(any(f"/bucket={b}/" in f for b in buckets) for f in read)
    each(parts[2], 2)  # the same batch again
    assert steps(kept.read("steps")) == steps(assemble(events).steps) and kept.events().count() == events.count()
    small = kept.compact(str(tmp_path / "compact"))
    small.rebuild()
    assert steps(small.read("steps")) == steps(assemble(events).steps) and len(small.events().inputFiles()) <= 8
    assert kept.events([]).count() == 0


SCHEMA = "session_id string, stream string, seq long, type string, is_error boolean, provider string, ts timestamp"


def told(spark, *rows):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, stream, seq, kind, bad, "p", at + datetime.timedelta(seconds=seq)) for s, stream, seq, kind, bad in rows], SCHEMA)


def test_errors_arriving_late(spark, tmp_path):
    """Batches in the wrong order give what one batch gives."""
    rows = [("s", "main", 1, "user", None), ("s", "main", 2, "tool_result", True), ("s", "main", 3, "user", None), ("s", "main", 4, "tool_result", True), ("s", "main", 5, "tool_result", False), ("s", "main", 6, "tool_result", True)]
    got = chunks(spark, str(tmp_path / "in"), SCHEMA, state.live_errors, [told(spark, rows[k]) for k in (5, 0, 3, 1, 2, 4)], tmp_path)
    assert [r[0].error_count for r, _ in got] == [1, 1, 2, 3, 2, 2]


def test_state_of_errors_ends(spark, tmp_path):
    """A session that is silent is forgotten: its old failures don't count, and its state is gone."""
    first, second = told(spark, ("s", "main", 2, "tool_result", True), ("s", "main", 3, "tool_result", True)), told(spark, ("t", "main", 1, "user", None))
    again = told(spark, ("s", "main", 4, "tool_result", True))
    kept = chunks(spark, str(tmp_path / "a"), SCHEMA, state.live_errors, [first, second, again], tmp_path / "ka")
    assert [r.error_count for r in kept[2][0]] == [3]
    gone = chunks(spark, str(tmp_path / "b"), SCHEMA, lambda e: state.live_errors(e, idle_ms=1), [first, second, again], tmp_path / "kb")
    assert [r.error_count for r in gone[2][0]] == [1]


def test_discovery_of_chunks(spark, tmp_path):
    first = told(spark, ("s", "main", 5, "user", None), ("s", "sidechain:a", 6, "user", None), ("x", "sidechain:a", 1, "user", None))
    second = told(spark, ("s", "main", 2, "message", None), ("t", "main", 1, "user", None), ("x", "main", 9, "user", None))
    got = [sorted((r.session_id, r.is_new, r.event_count, r.first_activity.second, r.last_activity.second) for r in rows) for rows, _ in chunks(spark, str(tmp_path / "a"), SCHEMA, state.discovery, [first, second], tmp_path / "ka")]
    assert got == [[("s", True, 1, 5, 5)], [("s", False, 2, 2, 5), ("t", True, 1, 1, 1), ("x", True, 1, 9, 9)]]
    projects = spark.createDataFrame([("s", "p"), ("x", "q")], "session_id string, project_hash string")
    got = [sorted((r.session_id, r.is_new) for r in rows) for rows, _ in chunks(spark, str(tmp_path / "b"), SCHEMA, lambda e: state.discovery(e, projects, "p"), [first, second], tmp_path / "kb")]
    assert got == [[("s", True)], [("s", False)]]  # t isn't known, x is another project's
    short = chunks(spark, str(tmp_path / "c"), SCHEMA, lambda e: state.discovery(e, idle_ms=1), [first, told(spark, ("t", "main", 1, "user", None)), told(spark, ("s", "main", 8, "user", None))], tmp_path / "kc")
    assert [(r.session_id, r.is_new, r.event_count) for r in short[2][0]] == [("s", True, 1)]  # forgotten, and new again
    assert sum(o["numRowsTotal"] for o in short[2][1]["stateOperators"]) < sum(o["numRowsTotal"] for o in chunks(spark, str(tmp_path / "d"), SCHEMA, state.discovery, [first, second], tmp_path / "kd")[1][1]["stateOperators"]) + 3


def test_tail_of_growing_files(spark, tmp_path):
    """Lines come once, when they end; a shorter file is read anew; files and lines of any size are split between tasks; a restart repeats nothing."""
    logs, out = tmp_path / "logs" / "deep", []
    logs.mkdir(parents=True)

    def drain(task=7):
        rows = []
        stream = tail.tail_lines(spark, str(tmp_path / "logs"), "*.jsonl", task)
        live.run_once(stream, str(tmp_path), lambda b, n: rows.extend(b.collect()), "append")
        out.append(sorted((os.path.basename(r.path), r.position, r.value) for r in rows))
        return out[-1]

    (logs / "a.jsonl").write_text("one\ntw")
    (logs / "b.jsonl").write_text("é" * 40 + "\n\nlast\n")
    (logs / "c.txt").write_text("no log\n")
    assert drain() == [("a.jsonl", 0, "one"), ("b.jsonl", 0, "é" * 40), ("b.jsonl", 82, "last")]
    assert drain() == []
    with open(logs / "a.jsonl", "a") as f:
        f.write("o")
    assert drain() == []
    with open(logs / "a.jsonl", "a") as f:
        f.write("\nthree\n")
    (logs / "d.jsonl").write_text("x" * 3_000_000 + "\ny\n")
    assert drain(1_000_000) == [("a.jsonl", 4, "two"), ("a.jsonl", 8, "three"), ("d.jsonl", 0, "x" * 3_000_000), ("d.jsonl", 3_000_001, "y")]
    (logs / "b.jsonl").write_text("new\n")
    os.remove(logs / "d.jsonl")
    assert drain() == [("b.jsonl", 0, "new")]
    (logs / "b.jsonl").write_text("")
    assert drain() == []
    (logs / "b.jsonl").write_text("again\n")
    assert drain() == [("b.jsonl", 0, "again")] and drain() == []


def test_tail_shares_tasks(tmp_path):
    """Small files share a task and large ones are cut, each byte once; offsets of earlier checkpoints, with whole paths, still count."""
    reader = tail.TailReader({"path": str(tmp_path)})
    for name in ("a", "b"):
        (tmp_path / name).write_text("line\n")
    assert reader.latestOffset() == {"a": 5, "b": 5} and len(reader.partitions({}, {"a": 5, "b": 5})) == 1
    [task] = reader.partitions({f"{tmp_path}/a": 5, "b": 9}, {"a": 5, "b": 5})
    assert task.ranges == [tail.Range(f"{tmp_path}/b", 0, 5)]
    for files, size, limit in ((20_000, 17_000, 4096), (50_000, 10, 4096), (3, 1 << 30, 4096), (20_000, 17_000, tail.TASK), (2, 3 * tail.TASK, tail.TASK)):
        tasks = tail.dealt([tail.Range(str(k), 5, 5 + size) for k in range(files)], limit)
        held = [r for t in tasks for r in t.ranges]
        assert len(tasks) <= 1.1 * tail.TASKS and (limit < tail.TASK or len(tasks) <= 20)
        assert sum(r.end - r.start for r in held) == files * size and len({(r.path, r.start) for r in held}) == len(held)


def test_tail_feeds_the_normalizer(spark, tmp_path):
    """Tailed lines give the events that a read of the files gives."""
    events = bridged(spark, "/root/testdata/sf0.001").orderBy("session_id", "seq").limit(300)
    render.write_files(render.claude_lines(events), str(tmp_path / "logs"))
    tail.tail_lines(spark, str(tmp_path / "logs"), "*.jsonl", 500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()

    def shown(lines):
        return sorted(map(str, ingest.claude_events(lines).select("session_id", "event_id", "parent_id", "seq", "type", "text").collect()))

    want = shown(ingest.read_lines(spark, str(tmp_path / "logs")))
    assert shown(tail.as_places(spark.read.parquet(str(tmp_path / "out")))) == want and want


def test_windows(spark, landed):
    folder, events = landed
    stream = live.landing(spark, folder, events.schema.simpleString()[7:-1].replace(":", " "))
    assert run(spark, live.token_rates(stream), "rates", "append").count() > 0
    assert run(spark, live.activity_bursts(stream), "bursts", "append").count() > 0
