"""The catalogue of log files and sessions: listing, headers, incremental refresh, upserts, diagnosis."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.query import page_of, sessions_between
from .ingest import at, detect_provider, first_lines, parse_auto, place_of, read_documents

SNIPPET, CLAUDE_LINES, CODEX_LINES = 200, 200, 20


def list_files(spark: SparkSession, root: str, glob: str = "*.json*") -> DataFrame:
    """path, length and modificationTime of files below ``root``; their content isn't read.  Folders in it that start with a dot are passed over."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
            .select("path", "length", "modificationTime"))


def probe(files: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """The files that belong to a format by path, name and size, with ``provider`` and ``confidence``; those in ``empty`` (path) don't."""
    name, provider = F.substring_index("path", "/", -1), detect_provider(F.col("path"))
    fits = (((provider == "claude_code") & name.endswith(".jsonl")) | ((provider == "codex") & name.startswith("rollout-") & name.endswith(".jsonl"))
            | ((provider == "gemini") & name.startswith("session-") & name.endswith(".json")))
    found = files.withColumn("provider", provider).where(fits & (F.col("length") > 0)).withColumn("confidence", F.lit(1.0))
    return found if empty is None else found.join(empty.select("path"), "path", "left_anti")


def empty_sessions(lines: DataFrame) -> DataFrame:
    """path of files of the second format without a session: two lines at most among the first, and none of a known record."""
    known = at(F.try_parse_json("value"), "$.type").isin("session_meta", "turn_context", "event_msg", "response_item")
    return first_lines(lines, CODEX_LINES).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(known), F.lit(False)).alias("known")).where(
        "n <= 2 and not known").select("path")


def latest_mod_time(files: DataFrame, *keys: str) -> DataFrame:
    """The newest modification time of each group of files."""
    return files.groupBy(*keys).agg(F.max("modificationTime").alias("latest_mod_time"))


def cwd_of(lines: DataFrame, first: int = 10) -> DataFrame:
    """path and the first working folder that its first lines tell, in the first or second format."""
    v = F.try_parse_json("value")
    cwd = F.coalesce(at(v, "$.cwd"), at(v, "$.payload.cwd"))
    return first_lines(lines, first).groupBy("path").agg(F.min_by(cwd, F.when(cwd.isNotNull(), F.col("line_no"))).alias("cwd"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that aren't known with the same size and time."""
    keys = ["path", "length", "modificationTime"]
    return files.join(known.select(keys), keys, "left_anti")


def claude_headers(lines: DataFrame, first: int = CLAUDE_LINES) -> DataFrame:
    """session_id, cwd, start, snippet, is_sidechain and agent of each file of the first format, from its first lines.

    The snippet is the first text of a user record that is neither meta nor of a
    sidechain, and none of whose forebears is meta; a snapshot of the files begins
    anew.  The first lines of a file are folded in order, up to the one with which
    session, folder, start and snippet are all known: whether it is a sidechain is
    what its last user record up to there tells (without one, its last record),
    and its agent the first that user records or their results name."""
    v = F.col("v")
    named = F.get(F.filter(F.transform(at("v", "$.message.content", "array<variant>"), lambda m: F.try_variant_get(m, "$.agentId", "string")), lambda a: a.isNotNull()), 0)
    r = first_lines(lines, first).withColumn("v", F.try_parse_json("value")).where("v is not null").select(
        "path", "line_no", at("v", "$.type").alias("t"), at("v", "$.sessionId").alias("sid"), at("v", "$.cwd").alias("cwd"), at("v", "$.timestamp").alias("ts"),
        F.coalesce(at("v", "$.isMeta", "boolean"), F.lit(False)).alias("meta"), at("v", "$.isSidechain", "boolean").alias("side"), F.when(at("v", "$.type") == "user", F.coalesce(at("v", "$.agentId"), named)).alias("agent"),
        F.coalesce(at("v", "$.uuid"), F.lit("")).alias("uuid"), at("v", "$.parentUuid").alias("parent"),
        F.coalesce(F.when(F.schema_of_variant(at("v", "$.message.content", "variant")) == "STRING", at("v", "$.message.content")), at("v", "$.message.content[0].text")).alias("text"))

    def first_of(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))

    heads = r.groupBy("path").agg(
        first_of("sid").alias("session_id"), first_of("cwd").alias("cwd"), first_of("ts").alias("start_ts"),
        F.sort_array(F.collect_list(F.struct("line_no", "t", "meta", "side", "uuid", "parent", "text", "agent", F.col("sid").isNotNull().alias("sid"), F.col("cwd").isNotNull().alias("cwd"),
                                             F.col("ts").isNotNull().alias("ts")))).alias("_r"))  # ``first`` of them at most
    none = F.lit(None)
    nothing = F.struct(F.array().cast("array<string>").alias("metas"), none.cast("string").alias("snippet"), none.cast("boolean").alias("user_side"), none.cast("boolean").alias("side"),
                       none.cast("string").alias("agent"), *[F.lit(False).alias(n) for n in ("sid", "cwd", "ts")])

    def fold(s, x):
        metas = F.when(x["t"] == "file-history-snapshot", F.array().cast("array<string>")).otherwise(s["metas"])
        under = x["meta"] | F.coalesce(F.array_contains(metas, x["parent"]), F.lit(False))
        says = (x["t"] == "user") & ~F.coalesce(x["side"], F.lit(False)) & ~under
        user = F.when(x["t"] == "user", F.coalesce(x["side"], F.lit(False)))
        seen = F.struct(F.when(under, F.array_append(metas, x["uuid"])).otherwise(metas).alias("metas"), F.coalesce(s["snippet"], F.when(says, x["text"])).alias("snippet"),
                        F.coalesce(user, s["user_side"]).alias("user_side"), F.coalesce(x["side"], s["side"]).alias("side"), F.coalesce(s["agent"], x["agent"]).alias("agent"),
                        *[(s[n] | x[n]).alias(n) for n in ("sid", "cwd", "ts")])
        return F.when(s["sid"] & s["cwd"] & s["ts"] & s["snippet"].isNotNull(), s).otherwise(seen)

    told = heads.withColumn("_s", F.aggregate("_r", nothing, fold))
    return told.select("path", "session_id", "cwd", "start_ts", F.substring("_s.snippet", 1, SNIPPET).alias("snippet"),
                       F.coalesce("_s.user_side", "_s.side", F.lit(False)).alias("is_sidechain"), F.col("_s.agent").alias("agent_id"))


def codex_headers(lines: DataFrame, first: int = CODEX_LINES) -> DataFrame:
    """session_id, cwd, start, snippet and subagent of each file of the second format, from its first lines."""
    r = first_lines(lines, first).withColumn("v", F.try_parse_json("value")).where("v is not null")
    meta = at("v", "$.type") == "session_meta"
    text = F.when((at("v", "$.payload.role") == "user") & ~F.coalesce(at("v", "$.payload.content[0].text").contains("<environment_context>"), F.lit(True)), at("v", "$.payload.content[0].text"))
    r = r.select("path", "line_no", F.when(meta, at("v", "$.payload.id")).alias("sid"), at("v", "$.payload.cwd").alias("cwd"), at("v", "$.timestamp").alias("ts"),
                 text.alias("text"), F.when(meta, at("v", "$.payload.source.subagent")).alias("agent"))
    return r.groupBy("path").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(n) for c, n in (
        ("sid", "session_id"), ("cwd", "cwd"), ("ts", "start_ts"), ("text", "snippet"), ("agent", "subagent"))]).withColumn("snippet", F.substring("snippet", 1, SNIPPET))


def gemini_headers(documents: DataFrame) -> DataFrame:
    """session_id, start and snippet of each document; the legacy array format tells them in its first entries."""
    d = F.try_parse_json("value")
    user = F.get(F.filter(at(d, "$.messages", "array<variant>"), lambda m: F.try_variant_get(m, "$.type", "string") == "user"), 0)
    return documents.select("path", at(d, "$.projectHash").alias("stored_hash"), F.coalesce(at(d, "$.sessionId"), at(d, "$[0].sessionId")).alias("session_id"),
                            F.coalesce(at(d, "$.startTime"), at(d, "$[0].timestamp")).alias("start_ts"),
                            F.substring(F.coalesce(F.try_variant_get(user, "$.content", "string"), at(d, "$[0].message")), 1, SNIPPET).alias("snippet"))


HEADER = {"provider": "string", "path": "string", "session_id": "string", "cwd": "string", "start_ts": "string", "snippet": "string", "is_sidechain": "boolean",
          "stored_hash": "string", "parent_session_id": "string", "spawned_by_turn": "int", "spawned_by_step": "int"}


def header_columns(headers: DataFrame, provider: str) -> DataFrame:
    """Headers of one format in the columns of HEADER; what the format doesn't tell is null."""
    headers = headers.withColumn("provider", F.lit(provider))
    side = F.coalesce(F.col("is_sidechain"), F.lit(False)) if "is_sidechain" in headers.columns else F.lit(False)
    return headers.select(*[side.alias(n) if n == "is_sidechain" else (F.col(n) if n in headers.columns else F.lit(None)).cast(t).alias(n) for n, t in HEADER.items()])


def sessions_of(headers: DataFrame, *others: Column) -> DataFrame:
    """Files grouped into sessions: the main file, sidechain files, first start, folder and snippet, newest modification time (and ``others``)."""
    main = ~F.col("is_sidechain")
    extra = [F.max("modificationTime").alias("latest_mod_time")] if "modificationTime" in headers.columns else []
    more = [F.max(c).alias(c) for c in ("provider", "stored_hash", "parent_session_id", "spawned_by_turn", "spawned_by_step") if c in headers.columns]
    return headers.where("session_id is not null").groupBy("session_id").agg(
        F.min(F.when(main, F.col("path"))).alias("main_file"), F.sort_array(F.collect_list(F.when(~main, F.col("path")))).alias("side_files"),
        F.min("start_ts").alias("start_ts"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("start_ts"))).alias("cwd"), F.max(F.when(main, F.col("snippet"))).alias("snippet"), *extra, *more, *others)


def most_recent(sessions: DataFrame, project: str | None = None) -> DataFrame:
    """Each provider's session whose files were written last (``session_id``, ``latest_mod_time``), of the project with that root folder if one is given.

    ``sessions`` as ``sessions_of`` gives them, with provider and latest_mod_time; sessions without a folder are no project's."""
    rows = sessions.where("main_file is not null and latest_mod_time is not null")
    if project is not None:
        rows = rows.where(project_hash(F.col("cwd")) == project_hash(F.lit(project)))
    newest = F.max_by(F.struct("session_id", "latest_mod_time"), F.struct("latest_mod_time", "session_id"))
    return rows.groupBy("provider").agg(newest.alias("_n")).select("provider", "_n.*")


def most_recent_provider(sessions: DataFrame, project: str | None = None) -> DataFrame:
    """The provider of the session that was written last, of all or of a project: one row, none without sessions; of equal times the first name."""
    return most_recent(sessions, project).orderBy(F.desc("latest_mod_time"), "provider").limit(1).select("provider")


@dataclass
class Catalog:
    """The tables of projects, sessions and log files."""

    projects: DataFrame
    sessions: DataFrame
    log_files: DataFrame

    def write(self, folder: str) -> None:
        for name, frame in vars(self).items():
            frame.write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Catalog:
        return cls(**{name: spark.read.parquet(f"{folder}/{name}") for name in cls.__dataclass_fields__})


def build_index(headers: DataFrame, files: DataFrame, old: Catalog | None = None, repositories: DataFrame | None = None, project: str | None = None,
                force: bool = False, observation: Observation | None = None) -> tuple[Catalog, DataFrame]:
    """The catalogue of the files with these headers (HEADER) and a row of counts: sessions, files scanned and files skipped.

    With an ``old`` catalogue a session all of whose files are known with the same
    size and time is passed over, unless ``force`` is set.  ``project`` takes one
    project's sessions only.  ``repositories`` (root_path, common_dir) tells which
    folders are worktrees of one repository.  Write the result to another folder
    than the old one, which it reads.  Files are marked by session in one window,
    and all three tables and the counts are taken from the marked ones; an
    ``observation`` gets the counts when log_files is written."""
    marked = headers.where("session_id is not null").join(files.select("path", "length", "modificationTime"), "path")
    new = F.lit(True)
    if old is not None and not force:
        same = old.log_files.select("path", F.col("file_size").alias("length"), F.col("mod_time").alias("modificationTime"), F.lit(True).alias("_same"))
        marked, new = marked.join(same, ["path", "length", "modificationTime"], "left"), F.col("_same").isNull()
    session = W.partitionBy("session_id")
    marked = marked.withColumns({"_new": F.max(new).over(session), "_main": F.min(F.when(~F.col("is_sidechain"), F.col("path"))).over(session),
                             "_cwd": F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("start_ts"))).over(session), "_stored": F.max("stored_hash").over(session)}).where("_main is not null")
    marked = marked.withColumn("project_hash", F.coalesce(project_hash(F.col("_cwd")), "_stored", project_hash(F.col("_main"))))
    if project is not None:
        marked = marked.where(F.col("project_hash") == project)
    seen = marked if observation is None else marked.observe(observation, *_counts())
    sessions = sessions_of(marked.where("_new"), F.max("project_hash").alias("project_hash"))
    repository = F.lit(None).cast("string")
    if repositories is not None:
        sessions = sessions.join(repositories.select(F.col("root_path").alias("cwd"), "common_dir").distinct(), "cwd", "left")
        repository = F.sha2("common_dir", 256)
    rows = sessions.select(F.col("session_id").alias("id"), "project_hash", repository.alias("repository_hash"), "provider", "start_ts", F.lit(None).cast("string").alias("end_ts"), "snippet",
                           F.lit(True).alias("is_valid"), "parent_session_id", "spawned_by_turn", "spawned_by_step")
    projects = sessions.groupBy(F.col("project_hash").alias("hash")).agg(F.max("cwd").alias("root_path"), F.max("latest_mod_time").alias("last_scanned_at"))
    logs = seen.where("_new").select("path", "session_id", F.when(F.col("is_sidechain"), "sidechain").otherwise("main").alias("role"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mod_time"))
    made = Catalog(projects, rows, logs)
    if old is not None:
        made = Catalog(upsert(old.projects, projects, ["hash"], keep=["root_path"]),
                       upsert(old.sessions, rows, ["id"], keep=["repository_hash", "start_ts", "end_ts", "snippet", "parent_session_id", "spawned_by_turn", "spawned_by_step"]),
                       upsert(old.log_files, logs, ["path"]))
    return made, marked.agg(*_counts())


def _counts() -> list[Column]:
    """What ``build_index`` counts, over the files of sessions: each session has one main file."""
    again = F.col("_new")
    return [F.count_if(again & (F.col("path") == F.col("_main"))).alias("total_sessions"), F.count_if(again).alias("scanned_files"), F.count_if(~again).alias("skipped_files")]


def write_index(folder: str, headers: DataFrame, files: DataFrame, old: Catalog | None = None, **options) -> dict[str, int]:
    """Build the catalogue and write it below ``folder``; the counts come out of the write itself, without a job of their own."""
    counted = Observation()
    made, _ = build_index(headers, files, old, observation=counted, **options)
    made.write(folder)
    return {k: int(v) for k, v in counted.get.items()}


def find_session_files(log_files: DataFrame, session: str) -> DataFrame:
    """A session's files, main ones first."""
    return log_files.where(F.col("session_id") == session).orderBy("role", "path")


def list_all_files(log_files: DataFrame) -> DataFrame:
    return log_files.orderBy("path")


def filter_sessions(sessions: DataFrame, project: str | None = None, provider: str | None = None, top_level: bool = False, repository: str | None = None) -> DataFrame:
    """Valid sessions of a project, provider or repository; ``top_level`` leaves out those that another one spawned."""
    for name, value in (("project_hash", project), ("provider", provider), ("repository_hash", repository)):
        if value is not None:
            sessions = sessions.where(F.col(name) == value)
    return sessions.where("is_valid and parent_session_id is null" if top_level else "is_valid")


def list_sessions(catalog: Catalog, size: int = 10, page: str | None = None, provider: str | None = None, project_root: str | None = None, project_hash: str | None = None,
                  since: str | None = None, until: str | None = None, include_children: bool = False) -> DataFrame:
    """A page of valid sessions, the newest first, with their project's root_path and the cursor of the next page.

    A project is told by its root folder or, without one, by its hash.  Sessions
    that others spawned are listed with ``include_children`` only; a session
    without a start comes last, and not at all if a bound holds."""
    project = project_scope(cwd=project_root) if project_root is not None else project_hash
    rows = filter_sessions(catalog.sessions, project=project, provider=provider, top_level=not include_children)
    rows = sessions_between(rows.withColumn("start_time", F.try_to_timestamp("start_ts")), since, until)
    got = page_of(rows, [F.desc_nulls_last("start_time"), F.asc("id")], size, page)
    return join_projects(got.drop("start_time"), catalog.projects)


def project_scope(project: str | None = None, everything: bool = False, cwd: str | None = None) -> str | None:
    """The hash of the project that is asked for: an explicit one, else none for all, else that of the working folder."""
    if project or everything or cwd is None:
        return project
    return hashlib.sha256(cwd.encode()).hexdigest()


def join_projects(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """Sessions with their project's root_path (null if it isn't known)."""
    return sessions.join(projects.select(F.col("hash").alias("project_hash"), "root_path"), "project_hash", "left")


def get_session(catalog: Catalog, session: str) -> DataFrame:
    """A valid session, with its project's root; no row if there is none."""
    return join_projects(catalog.sessions.where(F.col("is_valid") & (F.col("id") == session)), catalog.projects)


def list_projects(catalog: Catalog) -> DataFrame:
    """Projects with the number of their valid sessions."""
    n = catalog.sessions.where("is_valid").groupBy(F.col("project_hash").alias("hash")).agg(F.count(F.lit(1)).alias("sessions"))
    return catalog.projects.join(n, "hash", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0).cast("long")))


def children_of(sessions: DataFrame) -> DataFrame:
    """The sessions that others spawned, with their ``place`` among their parent's children, by turn and step."""
    order = W.partitionBy("parent_session_id").orderBy(F.asc_nulls_last("spawned_by_turn"), F.asc_nulls_last("spawned_by_step"), "id")
    return sessions.where("is_valid and parent_session_id is not null").withColumn("place", F.row_number().over(order))


def limit_sessions(sessions: DataFrame, limit: int, since: str | None = None, until: str | None = None, compat: bool = False) -> DataFrame:
    """The newest sessions in a span; ``compat`` limits first, so that fewer may be left."""
    def newest(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc("start_time"), "session_id").limit(limit)

    return sessions_between(newest(sessions), since, until) if compat else newest(sessions_between(sessions, since, until))


def raw_files(spark: SparkSession, log_files: DataFrame, session: str) -> DataFrame:
    """path and whole content of a session's files."""
    paths = [r["path"] for r in find_session_files(log_files, session).select("path").collect()]  # one session's files
    return read_documents(spark, *paths) if paths else spark.createDataFrame([], "path string, value string")


def load_session_events(spark: SparkSession, catalog: Catalog, session: str) -> DataFrame:
    """The events of one session, of all its files."""
    paths = [r["path"] for r in find_session_files(catalog.log_files, session).select("path").collect()]  # one session's files
    provider = catalog.sessions.where(F.col("id") == session).select("provider").first()
    if provider is None:
        raise KeyError(f"no session {session}")
    return parse_auto(spark, paths, provider[0])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` by key; columns in ``keep`` hold the old value where the new one is null."""
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns])
    here = F.lit(True)
    for k in keys:
        here = here & (F.col(k) == F.col(f"_n_{k}"))
    both = old.join(n, here, "full_outer")
    fresh = F.coalesce(*[F.col(f"_n_{k}") for k in keys]).isNotNull()
    return both.select(*[(F.coalesce(f"_n_{c}", c) if c in keys or c in keep else F.when(fresh, F.col(f"_n_{c}")).otherwise(F.col(c))).alias(c) for c in old.columns])


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by)))).where("_r = 1").drop("_r")


def project_hash(root):
    return F.sha2(root, 256)


def diagnose(lines: DataFrame) -> DataFrame:
    """Status of each file: parse_error if a line isn't JSON, missing_field if a record has no type, type_mismatch if its type isn't a string, else ok; with an example."""
    v, place = F.try_parse_json("value"), place_of(lines)
    tag = F.schema_of_variant(at(v, "$.type", "variant"))
    bad = F.when(v.isNull(), "parse_error").when(tag.isNull() | (tag == "VOID"), "missing_field").when(tag != "STRING", "type_mismatch")
    rows = lines.withColumn("_bad", bad).withColumn("_at", F.when(F.col("_bad").isNotNull(), place))
    return rows.groupBy("path").agg(
        F.coalesce(F.min_by("_bad", "_at"), F.lit("ok")).alias("status"), F.count(F.lit(1)).alias("records"), F.min_by(F.substring("value", 1, 80), "_at").alias("example"))


def diagnose_providers(lines: DataFrame, files: DataFrame) -> DataFrame:
    """For each provider: files, those that parse, and failures by type with the first one as example; ``files`` (path, provider) are those probed."""
    d = files.select("path", "provider").join(diagnose(lines), "path")
    bad = F.col("status") != "ok"
    return d.groupBy("provider").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~bad).alias("parsed"),
        *[F.count_if(F.col("status") == t).alias(t) for t in ("parse_error", "missing_field", "type_mismatch")],
        F.min_by("path", F.when(bad, F.col("path"))).alias("example_path"), F.min_by("example", F.when(bad, F.col("path"))).alias("example"))


def check_file(lines: DataFrame, events: DataFrame) -> DataFrame:
    """path, status, number of events and first bad line of each file."""
    n = events.groupBy("path").agg(F.count(F.lit(1)).alias("events"))
    return diagnose(lines).join(n, "path", "left").select("path", "status", F.coalesce("events", F.lit(0).cast("long")).alias("events"), F.col("example").alias("error"))


def categorize_error(message: Column) -> tuple[Column, Column]:
    """The failure that a parser's message tells (missing_field, type_mismatch, parse_error), and the field it names between backticks (null if none)."""
    field = F.nullif(F.regexp_extract(message, r"field `([^`]*)`", 1), F.lit(""))
    kind = (F.when(message.contains("missing field"), "missing_field").when(message.contains("expected") | message.contains("invalid type"), "type_mismatch").otherwise("parse_error"))
    return F.when(field.isNull(), "parse_error").otherwise(kind), F.when(kind != "parse_error", field)
