"""Queries over real files: rendered logs are written, one file a session, and read back in small splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import formats, ingest
from ..streaming.live import shared_dir
from . import oracle as O
from . import render
from .registry import query


def scratch(e: DataFrame, name: str) -> str:
    return f"{shared_dir(e.sparkSession)}/{name}-{uuid.uuid4().hex}"


#: Tasks of a read in small splits: beyond, splits share a task, so that tasks don't grow with the number of files.
SPLIT_TASKS = 400


def in_small_splits(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` as a table, made while files are split into a few kilobytes."""
    spark, keys = rows.sparkSession, {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.maxPartitionNum": str(SPLIT_TASKS)}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows.write.parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(folder)


def session_of(path: str = "path"):
    return F.regexp_extract(path, r"(s[0-9]+)\.json", 1)


_SAID = "coalesce(text, slash_name, tool_name, output)"


@query(O.on_events(f"SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS line_no, type, {_SAID} AS said FROM ev WHERE type <> 'token_usage'"), on="events")
def scan_claude(e: DataFrame):
    folder = scratch(e, "claude")
    render.write_files(render.claude_lines(e), f"{folder}/logs")
    got = ingest.claude_events(ingest.read_lines(e.sparkSession, f"{folder}/logs"))
    return in_small_splits(got.select(session_of().alias("session_id"), "line_no", "type", F.expr(_SAID).alias("said")), f"{folder}/events")


@query(O.on_events("""SELECT session_id, n AS line_no, type, coalesce(text, tool_name) AS said FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS n FROM ev WHERE type <> 'slash_command')
  WHERE type IN ('user', 'message', 'reasoning', 'tool_call')"""), on="events")
def scan_codex(e: DataFrame):
    folder = scratch(e, "codex")
    render.write_files(render.codex_lines(e).withColumn("path", F.concat(F.lit("2024/01/rollout-"), "path")), f"{folder}/logs")
    lines = ingest.read_lines(e.sparkSession, f"{folder}/logs/*/*")
    got = ingest.codex_events(lines).where("type in ('user', 'message', 'reasoning', 'tool_call')")
    return in_small_splits(got.select(session_of().alias("session_id"), "line_no", "type", F.coalesce("text", "tool_name").alias("said")), f"{folder}/events")


@query(O.on_events("""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS line_no, type, CASE type WHEN 'reasoning' THEN 'why: ' || text WHEN 'tool_call' THEN tool_name ELSE text END AS said
  FROM ev WHERE type NOT IN ('tool_result', 'slash_command') QUALIFY type <> 'token_usage'"""), on="events")
def scan_gemini(e: DataFrame):
    folder = scratch(e, "gemini")
    render.write_files(render.gemini_documents(e).select(F.concat(F.lit("session-"), "path").alias("path"), F.lit(0).alias("line_no"), "value"), f"{folder}/logs", ".json")
    got = ingest.gemini_events(ingest.read_documents(e.sparkSession, f"{folder}/logs")).where("type not in ('tool_result', 'token_usage') and (type != 'message' or text != '')")
    return got.select(session_of().alias("session_id"), "line_no", "type", F.coalesce("text", "tool_name").alias("said"))


def _spoilt_lines(lines: DataFrame) -> DataFrame:
    """Some lines that aren't JSON, and some without a time that can be read."""
    n = F.col("line_no")
    return lines.withColumn("value", F.when(n % 17 == 0, "{broken").when(n % 19 == 0, F.regexp_replace("value", '"timestamp":"[^"]*"', '"timestamp":"never"')).otherwise(F.col("value")))


@query(O.on_events("""SELECT session_id, what, count(*) AS n FROM (
    SELECT session_id, CASE WHEN seq % 17 = 0 THEN 'not JSON' WHEN seq % 19 = 0 THEN 'no time' ELSE type END AS what, type FROM ev
    WHERE provider <> 'gemini' AND type <> CASE provider WHEN 'codex' THEN 'slash_command' ELSE 'token_usage' END
    UNION ALL SELECT session_id, type, type FROM ev WHERE provider = 'gemini')
  WHERE what IN ('not JSON', 'no time', 'user', 'message') GROUP BY ALL UNION ALL SELECT '', x, 1 FROM (VALUES ('unknown path'), ('not a log')) v(x)"""), on="events")
def parse_auto(e: DataFrame):
    """Files of three formats below one folder, some of them spoilt, with a path that tells no format and one that isn't a log: events and errors counted."""
    folder = scratch(e, "auto")
    for provider, lines, path in (("claude_code", _spoilt_lines(render.claude_lines(e.where("provider = 'claude_code'"))), ".claude/projects/"),
                                  ("codex", _spoilt_lines(render.codex_lines(e.where("provider = 'codex'"))), ".codex/sessions/rollout-"),
                                  ("gemini", render.gemini_documents(e.where("provider = 'gemini'")).withColumn("line_no", F.lit(0)), ".gemini/tmp/session-")):
        render.write_files(lines.withColumn("path", F.concat(F.lit(path), "path")), folder, ".json" if provider == "gemini" else ".jsonl")
    got = formats.parse(e.sparkSession, [f"{folder}/.claude/projects/*.jsonl", f"{folder}/.codex/sessions/*.jsonl", f"{folder}/.gemini/tmp/*.json", f"{folder}/notes/a.jsonl", f"{folder}/.codex/config.toml"])
    got.write(f"{folder}/tables")
    events, errors = (e.sparkSession.read.parquet(f"{folder}/tables/{t}") for t in ("events", "errors"))
    told = events.where("type in ('user', 'message') and text != ''").select(session_of().alias("session_id"), F.col("type").alias("what"))
    return told.unionByName(errors.select(F.when(F.col("path").rlike(r"s[0-9]+\.json"), session_of()).otherwise("").alias("session_id"), F.col("reason").alias("what"))).groupBy("session_id", "what").agg(F.count(F.lit(1)).alias("n"))
