"""Queries on the catalogue: projects, sessions and log files indexed out of headers that the events give."""

from __future__ import annotations

import hashlib
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assemble import Assembled
from ..operators.query import cursor
from ..sources import catalog
from ..streaming.live import shared_dir, stored
from . import oracle as O
from .registry import query


def headers_of(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and files: each stream of a session is a file; some sessions have no folder, some are children of the one before."""
    user = F.substring("session_id", 2, 20).cast("long")
    rows = stored(e.groupBy("provider", "session_id", "stream").agg(F.min("ts").alias("_ts"), F.max("ts").alias("modificationTime"), F.count(F.lit(1)).alias("length"),
                                                                    F.min(F.when(F.col("type") == "user", F.col("text"))).alias("snippet")))  # asked for by each table of a catalogue
    child = user % 7 == 3
    heads = rows.select(
        "provider", F.concat_ws("/", "session_id", "stream").alias("path"), "session_id", F.when(user % 4 != 1, F.concat(F.lit("/root/p"), (user % 5).cast("string"))).alias("cwd"),
        F.date_format("_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start_ts"), "snippet", (F.col("stream") != "main").alias("is_sidechain"), F.lit(None).cast("string").alias("stored_hash"),
        F.when(child, F.concat(F.lit("s"), (user - 1).cast("string"))).alias("parent_session_id"), F.when(child, user % 3).cast("int").alias("spawned_by_turn"), F.when(child, user % 2).cast("int").alias("spawned_by_step"))
    return heads, rows.select(F.concat_ws("/", "session_id", "stream").alias("path"), "length", "modificationTime")


def first_index(heads: DataFrame, files: DataFrame) -> catalog.Catalog:
    """The catalogue before the last change: without a third of the sessions, and with other sizes of every fifth session's files."""
    user = F.substring("session_id", 2, 20).cast("long")
    old = F.substring(F.substring_index("path", "/", 1), 2, 20).cast("long")
    made, _ = catalog.build_index(heads.where(user % 3 != 0), files.withColumn("length", F.when(old % 5 == 0, F.col("length") + 1).otherwise(F.col("length"))))
    return catalog.Catalog(made.projects, made.sessions.withColumn("snippet", F.concat(F.lit("old "), "snippet")), made.log_files)


def repositories(e: DataFrame) -> DataFrame:
    """Folders of projects 0 and 1 are worktrees of one repository; project 4 is none."""
    n = F.substring("session_id", 2, 20).cast("long") % 5
    return e.select(n.alias("n")).distinct().where("n < 4").select(F.concat(F.lit("/root/p"), F.col("n").cast("string")).alias("root_path"), F.concat(F.lit("/git/r"), F.greatest(F.lit(1), F.col("n")).cast("string")).alias("common_dir"))


def second_index(e: DataFrame):
    heads, files = headers_of(e)
    return catalog.build_index(heads, files, old=first_index(heads, files), repositories=repositories(e))


HEADS = """hd AS (SELECT provider, session_id || '/' || stream AS path, session_id, CAST(user_id AS BIGINT) AS u, stream <> 'main' AS side, min(ts) AS ts, max(ts) AS mod_time, count(*) AS size, min(text) FILTER (type = 'user') AS snippet FROM ev GROUP BY ALL),
se0 AS (SELECT session_id AS id, any_value(provider) AS provider, any_value(u) AS u, min(path) FILTER (NOT side) AS main_file, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS start_ts, max(snippet) FILTER (NOT side) AS snip, count(*) AS files, max(mod_time) AS newest
  FROM hd GROUP BY session_id),
se AS (SELECT *, CASE WHEN u % 4 <> 1 THEN '/root/p' || (u % 5) END AS cwd, u % 3 = 0 OR u % 5 = 0 AS again FROM se0 WHERE main_file IS NOT NULL),
sx AS (SELECT id, sha256(coalesce(cwd, main_file)) AS project_hash, CASE WHEN again AND cwd IS NOT NULL AND u % 5 < 4 THEN sha256('/git/r' || greatest(1, u % 5)) END AS repository_hash, provider, start_ts,
  CASE WHEN again THEN coalesce(snip, CASE WHEN u % 3 <> 0 THEN 'old ' || snip END) ELSE 'old ' || snip END AS snippet, true AS is_valid, CASE WHEN u % 7 = 3 THEN 's' || (u - 1) END AS parent_session_id,
  CASE WHEN u % 7 = 3 THEN u % 3 END::INT AS spawned_by_turn, CASE WHEN u % 7 = 3 THEN u % 2 END::INT AS spawned_by_step, cwd, newest, files, again FROM se),
pj AS (SELECT project_hash AS hash, max(cwd) AS root_path FROM sx GROUP BY project_hash)"""
COLUMNS = "id, project_hash, repository_hash, provider, start_ts, snippet, is_valid, parent_session_id, spawned_by_turn, spawned_by_step"


@query(O.on_events(f"SELECT {COLUMNS} FROM sx", HEADS), on="events")
def upsert_session(e: DataFrame):
    return second_index(e)[0].sessions.drop("end_ts")


@query(O.on_events("SELECT hash, root_path FROM pj", HEADS), on="events")
def upsert_project(e: DataFrame):
    return second_index(e)[0].projects.drop("last_scanned_at")


@query(O.on_events("SELECT path, session_id, CASE WHEN side THEN 'sidechain' ELSE 'main' END AS role, size AS file_size FROM hd WHERE session_id IN (SELECT id FROM sx)", HEADS), on="events")
def upsert_log_file(e: DataFrame):
    return second_index(e)[0].log_files.drop("mod_time")


@query(O.on_events("SELECT count(*) FILTER (again) AS total_sessions, coalesce(sum(files) FILTER (again), 0)::BIGINT AS scanned_files, coalesce(sum(files) FILTER (NOT again), 0)::BIGINT AS skipped_files FROM sx", HEADS), on="events")
def build_index(e: DataFrame):
    return second_index(e)[1]


@query(O.on_events("SELECT count(*) FILTER (again) AS total_sessions, coalesce(sum(files) FILTER (again), 0)::BIGINT AS scanned_files, coalesce(sum(files) FILTER (NOT again), 0)::BIGINT AS skipped_files, (SELECT count(*) FROM sx) AS stored FROM sx", HEADS), on="events")
def write_index(e: DataFrame):
    """The catalogue written twice, the second time out of the first as it was stored; the counts that the second write made."""
    spark, folder = e.sparkSession, f"{shared_dir(e.sparkSession)}/index-{uuid4().hex}"
    heads, files = headers_of(e)
    first_index(heads, files).write(f"{folder}/old")
    counts = catalog.write_index(f"{folder}/new", heads, files, old=catalog.Catalog.read(spark, f"{folder}/old"))
    return catalog.Catalog.read(spark, f"{folder}/new").sessions.agg(*[F.lit(n).cast("long").alias(k) for k, n in counts.items()], F.count(F.lit(1)).alias("stored"))


_PAGE = "SELECT id, provider, start_ts, root_path, {} AS next_cursor FROM sx JOIN pj ON hash = project_hash WHERE {} ORDER BY start_ts DESC, id LIMIT 10 OFFSET {}"


def _page(rows: DataFrame) -> DataFrame:
    return rows.select("id", "provider", "start_ts", "root_path", "next_cursor")


@query(O.on_events(_PAGE.format("CASE WHEN (SELECT count(*) FROM sx WHERE parent_session_id IS NULL) > 20 THEN 'eyJvZmZzZXQiOjIwfQ==' END", "parent_session_id IS NULL", 10), HEADS), on="events")
def list_sessions_top_level(e: DataFrame):
    """The second page of sessions that no other one spawned."""
    return _page(catalog.list_sessions(second_index(e)[0], page=cursor(10)))


_OF_P2 = "project_hash = sha256('/root/p2') AND provider = 'codex' AND CAST(start_ts AS TIMESTAMP) >= TIMESTAMP '2024-01-01 00:00:30'"


@query(O.on_events(_PAGE.format(f"CASE WHEN (SELECT count(*) FROM sx WHERE {_OF_P2}) > 10 THEN 'eyJvZmZzZXQiOjEwfQ==' END", _OF_P2, 0), HEADS), on="events")
def list_sessions_of_project(e: DataFrame):
    """A project's sessions of one provider, children too; its root goes before the hash."""
    return _page(catalog.list_sessions(second_index(e)[0], provider="codex", project_root="/root/p2", project_hash="none", since="2024-01-01T00:00:30", include_children=True))


@query(O.on_events("SELECT count(*) AS total_sessions, sum(files)::BIGINT AS scanned_files, 0::BIGINT AS skipped_files FROM sx WHERE project_hash = sha256('/root/p2')", HEADS), on="events")
def filter_project_scope(e: DataFrame):
    heads, files = headers_of(e)
    return catalog.build_index(heads, files, old=first_index(heads, files), project=catalog.project_scope(cwd="/root/p2"), force=True)[1]


@query(O.on_events(f"SELECT {COLUMNS} FROM sx WHERE provider = 'codex' AND project_hash = sha256('/root/p2') AND parent_session_id IS NULL", HEADS), on="events")
def filter_sessions(e: DataFrame):
    project = hashlib.sha256(b"/root/p2").hexdigest()
    return catalog.filter_sessions(second_index(e)[0].sessions, project=project, provider="codex", top_level=True).drop("end_ts")


@query(O.on_events("SELECT id, repository_hash FROM sx WHERE repository_hash = sha256('/git/r1')", HEADS), on="events")
def filter_repository(e: DataFrame):
    return catalog.filter_sessions(second_index(e)[0].sessions, repository=hashlib.sha256(b"/git/r1").hexdigest()).select("id", "repository_hash")


@query(O.on_events("SELECT id, provider, project_hash, root_path FROM sx JOIN pj ON hash = project_hash WHERE id = (SELECT min(id) FROM sx)", HEADS), on="events")
def get_session(e: DataFrame):
    made = second_index(e)[0]
    least = made.sessions.agg(F.min("id")).first()[0]
    return catalog.get_session(made, least).select("id", "provider", "project_hash", "root_path")


@query(O.on_events("SELECT id, project_hash, root_path FROM sx JOIN pj ON hash = project_hash", HEADS), on="events")
def join_session_project(e: DataFrame):
    made = second_index(e)[0]
    return catalog.join_projects(made.sessions, made.projects).select("id", "project_hash", "root_path")


@query(O.on_events("SELECT hash, root_path, count(*) AS sessions FROM pj JOIN sx ON hash = project_hash GROUP BY ALL", HEADS), on="events")
def list_projects(e: DataFrame):
    return catalog.list_projects(second_index(e)[0]).select("hash", "root_path", "sessions")


@query(O.on_events("SELECT id, parent_session_id, CAST(row_number() OVER (PARTITION BY parent_session_id ORDER BY spawned_by_turn, spawned_by_step, id) AS INT) AS place FROM sx WHERE parent_session_id IS NOT NULL", HEADS), on="events")
def child_sessions(e: DataFrame):
    return catalog.children_of(second_index(e)[0].sessions).select("id", "parent_session_id", "place")


@query(O.on_events("SELECT path, role FROM (SELECT path, CASE WHEN side THEN 'sidechain' ELSE 'main' END AS role FROM hd WHERE session_id = (SELECT min(id) FROM sx))", HEADS), on="events")
def find_session_files(e: DataFrame):
    made = second_index(e)[0]
    return catalog.find_session_files(made.log_files, made.sessions.agg(F.min("id")).first()[0]).select("path", "role")


@query(O.on_events("SELECT path FROM hd WHERE session_id IN (SELECT id FROM sx)", HEADS), on="events")
def list_all_files(e: DataFrame):
    return catalog.list_all_files(second_index(e)[0].log_files).select("path")


@query(O.on_events("SELECT id AS session_id, CAST(floor(epoch_us(newest) / 1000) AS BIGINT) AS ms FROM sx", HEADS), on="events")
def latest_mod_time(e: DataFrame):
    files = second_index(e)[0].log_files.withColumnRenamed("mod_time", "modificationTime")
    return catalog.latest_mod_time(files, "session_id").select("session_id", F.floor(F.unix_micros("latest_mod_time") / 1000).alias("ms"))


@query(O.on_events("SELECT id, main_file, files - 1 AS sides, start_ts FROM se", HEADS), on="events")
def scan_sessions(e: DataFrame):
    heads, _ = headers_of(e)
    rows = catalog.sessions_of(heads).where("main_file is not null")
    return rows.select(F.col("session_id").alias("id"), "main_file", F.size("side_files").cast("long").alias("sides"), "start_ts")


def written(e: DataFrame) -> DataFrame:
    """Sessions with the times of their files."""
    heads, files = headers_of(e)
    return catalog.sessions_of(heads.join(files.select("path", "modificationTime"), "path"))


_NEWEST = "SELECT provider, id, newest FROM se WHERE {} QUALIFY row_number() OVER (PARTITION BY provider ORDER BY newest DESC, id DESC) = 1"


@query(O.on_events(f"SELECT provider, id, CAST(floor(epoch_us(newest) / 1000) AS BIGINT) AS ms FROM ({_NEWEST.format('true')})", HEADS), on="events")
def most_recent_by_file(e: DataFrame):
    return catalog.most_recent(written(e)).select("provider", F.col("session_id").alias("id"), F.floor(F.unix_micros("latest_mod_time") / 1000).alias("ms"))


@query(O.on_events(f"""SELECT project, provider FROM (SELECT '' AS project, * FROM ({_NEWEST.format('true')}) UNION ALL SELECT '/root/p2', * FROM ({_NEWEST.format("cwd = '/root/p2'")}) UNION ALL SELECT '/no', * FROM ({_NEWEST.format("cwd = '/no'")}))
  QUALIFY row_number() OVER (PARTITION BY project ORDER BY newest DESC, provider) = 1""", HEADS), on="events")
def most_recent_provider(e: DataFrame):
    """The provider that was used last: of all sessions, of a project's, and of one without sessions."""
    rows = [catalog.most_recent_provider(written(e), p).select(F.lit(p or "").alias("project"), "provider") for p in (None, "/root/p2", "/no")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(O.on_events("SELECT path FROM hd WHERE u % 3 = 0 OR u % 5 = 0", HEADS), on="events")
def anti_incremental(e: DataFrame):
    heads, files = headers_of(e)
    known = first_index(heads, files).log_files.withColumnsRenamed({"file_size": "length", "mod_time": "modificationTime"})
    main = files.join(heads.groupBy("session_id").agg(F.bool_or(~F.col("is_sidechain")).alias("m"), F.collect_list("path").alias("p")).where("m").select(F.explode("p").alias("path")), "path")
    return catalog.changed(main, known).select("path")


@query(O.on_events("SELECT path, provider FROM (SELECT '/h/' || CASE provider WHEN 'claude_code' THEN '.claude/' WHEN 'codex' THEN '.codex/rollout-' ELSE '.gemini/session-' END || session_id || CASE WHEN u % 2 = 0 THEN '.jsonl' ELSE '.json' END AS path, * FROM hd WHERE NOT side) WHERE provider = 'gemini' AND u % 2 = 1 OR provider <> 'gemini' AND u % 2 = 0", HEADS), on="events")
def probe_files(e: DataFrame):
    heads, files = headers_of(e)
    user = F.substring("session_id", 2, 20).cast("long")
    home = F.when(F.col("provider") == "claude_code", "/h/.claude/").when(F.col("provider") == "codex", "/h/.codex/rollout-").otherwise("/h/.gemini/session-")
    named = heads.where("not is_sidechain").join(files, "path").select(F.concat(home, "session_id", F.when(user % 2 == 0, ".jsonl").otherwise(".json")).alias("path"), "length", "modificationTime")
    return catalog.probe(named).select("path", "provider")


@query(O.on_tables("SELECT session_id FROM sessions WHERE stream = 'main' AND start_time <= TIMESTAMP '2024-01-01 02:00:00' ORDER BY start_time DESC, session_id LIMIT 10"))
def limit_sessions(a: Assembled):
    return catalog.limit_sessions(a.sessions.where("stream = 'main'"), 10, until="2024-01-01T02:00:00Z").select("session_id")
