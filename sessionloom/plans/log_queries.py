"""Queries on raw logs: events rendered to lines or documents of each format and read back, and expressions on commands, paths and messages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tools as T
from ..operators import query as Q
from ..sources import catalog, ingest
from ..streaming.live import shared_dir, stored
from . import oracle as O
from . import render
from .registry import on_documents, query

_SAID = "coalesce(text, slash_name, tool_name, output)"


@query(O.on_events(f"""SELECT session_id AS path, seq AS line_no, type, stream, {_SAID} AS said, coalesce(is_error, false) AS is_error, file_path, command, pattern,
  lag(seq) OVER (PARTITION BY session_id, stream ORDER BY seq) AS parent_line, agent_id FROM ev WHERE type <> 'token_usage'"""), on="events")
def norm_claude(e: DataFrame):
    got = stored(ingest.claude_events(render.claude_lines(e)).select(
        "path", "line_no", "type", "stream", F.expr(_SAID).alias("said"), "is_error", "file_path", "command", "pattern", "agent_id", "event_id", "parent_id"))
    parents = got.select(F.col("event_id").alias("parent_id"), F.col("line_no").alias("parent_line"))
    return got.join(parents, "parent_id", "left").select("path", "line_no", "type", "stream", "said", F.coalesce("is_error", F.lit(False)).alias("is_error"),
                                                         "file_path", "command", "pattern", "parent_line", "agent_id")


@query(O.on_events(f"""SELECT session_id AS path, seq AS line_no, type, CASE WHEN type = 'tool_result' THEN 'Exit code: ' || CAST(is_error AS INT) || chr(10) || output ELSE {_SAID} END AS said,
  coalesce(is_error, false) AS is_error, tok_uncached, tok_cached, tok_generated FROM
  (SELECT *, lag((tok_uncached + tok_cached) || ' ' || tok_generated) OVER (PARTITION BY session_id, type ORDER BY seq) AS was FROM ev)
  WHERE type <> 'slash_command' AND NOT (type = 'token_usage' AND was IS NOT DISTINCT FROM ((tok_uncached + tok_cached) || ' ' || tok_generated))"""), on="events")
def norm_codex(e: DataFrame):
    return ingest.codex_events(render.codex_lines(e)).select("path", "line_no", "type", F.expr(_SAID).alias("said"), F.coalesce("is_error", F.lit(False)).alias("is_error"),
                                                             "tok_uncached", "tok_cached", "tok_generated")


@query(O.on_events("""SELECT session_id AS path, seq AS line_no, CASE WHEN seq % 7 = 3 OR (seq % 7 IN (1, 2) AND NOT starts_with(tool_name, 'mcp__')) THEN 'Generic' WHEN tool_name IN ('Read', 'Glob') THEN 'FileRead' WHEN tool_name = 'Edit' THEN 'FileEdit'
  WHEN tool_name = 'Bash' THEN 'Execute' WHEN tool_name = 'Grep' THEN 'Search' ELSE 'Mcp' END AS tool_variant, mcp_server, mcp_tool FROM ev WHERE type = 'tool_call'"""), on="events")
def tool_norm_claude(e: DataFrame):
    return ingest.claude_events(render.claude_lines(e, spoil=True)).where("type = 'tool_call'").select("path", "line_no", "tool_variant", "mcp_server", "mcp_tool")


UUID5 = "h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32]"


@query(O.on_events(f"""SELECT session_id AS path, seq AS line_no, {UUID5} AS event_id FROM (SELECT session_id, seq, sha1(unhex(replace(sid, '-', '')) || encode(event_id || '-content-0:' || suffix)) AS h FROM
  (SELECT *, {UUID5} AS sid FROM (SELECT session_id, seq, event_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(session_id)) AS h,
     CASE type WHEN 'slash_command' THEN 'slashcmd' WHEN 'tool_call' THEN 'call' WHEN 'tool_result' THEN 'result' ELSE type END AS suffix FROM ev WHERE type <> 'token_usage')))"""), on="events")
def event_id(e: DataFrame):
    return ingest.claude_events(render.claude_lines(e)).select("path", "line_no", "event_id")


@query(O.on_events("SELECT session_id AS path, seq AS line_no, tok_cached, tok_uncached, tok_generated, tok_reasoning::BIGINT AS tok_reasoning, tok_tool::BIGINT AS tok_tool, model FROM (SELECT *, 0 AS tok_reasoning, 0 AS tok_tool FROM ev) WHERE type = 'token_usage'"), on="events")
def tokens_claude(e: DataFrame):
    got = ingest.claude_events(render.claude_lines(e, usage=True)).where("type = 'token_usage'")
    return got.select("path", "line_no", "tok_cached", "tok_uncached", "tok_generated", "tok_reasoning", "tok_tool", "model")


@query(O.on_events("""SELECT session_id AS path, seq AS line_no, last_value(CASE WHEN type = 'slash_command' THEN model || '-' || seq END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model
  FROM ev QUALIFY type IN ('user', 'message', 'reasoning', 'tool_call', 'tool_result')"""), on="events")
def codex_model_ffill(e: DataFrame):
    return ingest.codex_events(render.codex_lines(e, models=True)).where("type != 'token_usage'").select("path", "line_no", "model")


@query(O.on_events("""SELECT session_id AS path, seq AS line_no, type, CASE type WHEN 'reasoning' THEN 'why: ' || text WHEN 'tool_call' THEN tool_name ELSE text END AS said, false AS is_error, tok_cached, tok_uncached, tok_generated,
    CASE WHEN type = 'token_usage' THEN 1 END::BIGINT AS tok_reasoning, CASE WHEN type = 'token_usage' THEN 2 END::BIGINT AS tok_tool, file_path, command FROM ev WHERE type NOT IN ('tool_result', 'slash_command')
  UNION ALL SELECT session_id, seq, 'tool_result', 'shown ' || event_id, seq % 4 = 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ev WHERE type = 'tool_call' AND seq % 2 = 0"""), on="events")
def norm_gemini(e: DataFrame):
    got = ingest.gemini_events(render.gemini_documents(e)).where("type != 'message' or text != ''")
    docs = e.where("type not in ('tool_result', 'slash_command')").select(F.col("session_id").alias("path"), F.col("seq").alias("_seq"), (F.row_number().over(render.in_order("session_id", "seq")) - 1).cast("long").alias("line_no"))
    return got.join(docs, ["path", "line_no"]).select(
        "path", F.col("_seq").alias("line_no"), "type", F.coalesce("text", "tool_name", "output").alias("said"), F.coalesce("is_error", F.lit(False)).alias("is_error"),
        "tok_cached", "tok_uncached", "tok_generated", "tok_reasoning", "tok_tool", "file_path", "command")


@query(O.on_events("""SELECT session_id AS path, seq AS line_no, ['slash_command', 'notification', 'notification', 'notification', 'notification', 'queue_operation', 'summary', 'notification'][seq % 8 + 1] AS type,
  CASE seq % 8 WHEN 0 THEN '/model' WHEN 1 THEN 'Turn duration: ' || seq || 'ms' WHEN 2 THEN 'Context compaction (trigger: ' || CASE WHEN seq % 3 = 0 THEN 'auto' ELSE 'unknown' END || ', pre_tokens: ' || seq || ')'
    WHEN 3 THEN 'Stop hooks executed (count: 2): lint, fmt' WHEN 4 THEN 'Hook: h (Stop)' WHEN 5 THEN 'enqueue' WHEN 6 THEN 'sum ' || event_id ELSE 'PR #' || seq || ' linked: http://x' END AS said,
  CASE WHEN seq % 8 IN (2, 3, 7) OR (seq % 8 = 4 AND seq % 3 = 0) THEN 'info' WHEN seq % 8 IN (1, 4) THEN 'debug' END AS level,
  CASE seq % 8 WHEN 0 THEN 'big ' || event_id WHEN 5 THEN 'task ' || event_id WHEN 6 THEN event_id END AS more FROM ev"""), on="events")
def norm_claude_records(e: DataFrame):
    return ingest.claude_events(render.other_records(e)).select(
        "path", "line_no", "type", F.coalesce("text", "slash_name", "queue_op").alias("said"), "level", F.coalesce("slash_args", "queue_content", "leaf_uuid").alias("more"))


@query(O.on_events("""SELECT session_id AS path, seq AS line_no, CASE WHEN tool_name <> 'Edit' AND (seq % 7 = 3 OR (seq % 7 = 1 AND tool_name IN ('Bash', 'Grep')) OR (seq % 7 = 2 AND tool_name IN ('Bash', 'Grep', 'Read'))) THEN 'Generic'
    WHEN seq % 7 = 1 AND tool_name = 'Read' THEN 'Execute' WHEN tool_name = 'Read' OR command IN ('ls -la src', 'cat a.txt') THEN 'FileRead' WHEN tool_name = 'Bash' THEN 'Execute' WHEN tool_name = 'Grep' THEN 'Search'
    WHEN tool_name = 'Edit' THEN CASE WHEN seq % 2 = 0 THEN 'FileWrite' ELSE 'FileEdit' END WHEN starts_with(tool_name, 'mcp__') THEN 'Mcp' ELSE 'Generic' END AS tool_variant,
  CASE WHEN tool_name = 'Edit' THEN file_path WHEN seq % 7 IN (1, 2, 3) THEN NULL WHEN tool_name = 'Read' THEN file_path WHEN tool_name = 'Grep' THEN pattern WHEN command = 'cat a.txt' THEN 'a.txt' END AS file_path,
  CASE WHEN tool_name = 'Grep' AND seq % 7 NOT IN (1, 2, 3) THEN pattern END AS pattern
  FROM ev WHERE type = 'tool_call'"""), on="events")
def tool_norm_codex(e: DataFrame):
    return ingest.codex_events(render.codex_tool_lines(e)).select("path", "line_no", "tool_variant", "file_path", "pattern")


@query(O.on_events("""SELECT session_id AS path, event_id AS call, CASE WHEN seq % 7 = 3 OR (seq % 7 IN (1, 2) AND NOT starts_with(tool_name, 'mcp__')) THEN 'Generic'
    WHEN tool_name = 'Read' THEN 'FileRead' WHEN tool_name = 'Edit' THEN 'FileEdit' WHEN tool_name = 'Bash' THEN 'Execute' WHEN tool_name = 'Grep' THEN 'Search' WHEN tool_name = 'Glob' THEN 'Generic' ELSE 'Mcp' END AS tool_variant,
  mcp_server, mcp_tool, CASE WHEN seq % 7 = 2 AND command IS NOT NULL THEN '5' WHEN seq % 7 NOT IN (1, 3) THEN command END AS command FROM ev WHERE type = 'tool_call'"""), on="events")
def tool_norm_gemini(e: DataFrame):
    got = ingest.gemini_events(render.gemini_documents(e, own_tools=True)).where("type = 'tool_call'")
    return got.select("path", F.col("provider_call_id").alias("call"), "tool_variant", "mcp_server", "mcp_tool", "command")


@query(O.on_events("""SELECT session_id AS path, seq AS line_no, seq * 10 AS context_limit FROM (SELECT *, lag((tok_uncached + tok_cached) || ' ' || tok_generated) OVER (PARTITION BY session_id ORDER BY seq) AS was FROM ev WHERE type = 'token_usage')
  WHERE was IS DISTINCT FROM ((tok_uncached + tok_cached) || ' ' || tok_generated)"""), on="events")
def extract_context_limit(e: DataFrame):
    got = ingest.codex_events(render.codex_lines(e.where("type = 'token_usage'")))
    return got.select("path", "line_no", "context_limit")


@query(O.on_events("""SELECT path, arg_min(text, seq) FILTER (says) AS snippet, min(ms) AS start_ms, bool_and(side) AS is_sidechain FROM (
  SELECT session_id || '/' || stream AS path, seq, row_number() OVER (PARTITION BY session_id, stream ORDER BY seq) AS n, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, stream <> 'main' AS side,
    CASE WHEN type = 'slash_command' THEN '<command-name>/commit</command-name>' ELSE text END AS text, type IN ('user', 'slash_command') AND stream = 'main' AS says FROM ev WHERE type <> 'token_usage') WHERE n <= 200 GROUP BY path"""), on="events")
def header_claude(e: DataFrame):
    lines = render.claude_lines(e).withColumn("path", F.concat_ws("/", "path", F.coalesce(F.concat(F.lit("sidechain:"), F.get_json_object("value", "$.agentId")), F.lit("main"))))
    rows = lines.select("path", F.col("line_no").alias("place"), "value")  # read_lines gives places, not numbers
    return catalog.claude_headers(rows).select("path", "snippet", F.floor(F.unix_micros(F.try_to_timestamp("start_ts")) / 1000).alias("start_ms"), "is_sidechain")


@query(O.on_events("""SELECT path, session_id, cwd, is_sidechain, agent_id FROM (
  SELECT session_id AS path, session_id, CASE WHEN count(*) FILTER (seq % 5 = 0) > 0 THEN '/p' END AS cwd, bool_or(stop IS NOT NULL) AS stops,
    arg_max(side, n) FILTER (says AND n <= coalesce(stop, 200)) AS by_user, arg_max(side, n) FILTER (n <= coalesce(stop, 200)) AS by_any, coalesce(by_user, by_any) AS is_sidechain,
    arg_min(agent, n) FILTER (agent IS NOT NULL AND n <= coalesce(stop, 200)) AS agent_id FROM (
    SELECT *, greatest(min(CASE WHEN seq % 5 = 0 THEN n END) OVER w, min(CASE WHEN asks THEN n END) OVER w) AS most,
      CASE WHEN min(CASE WHEN seq % 5 = 0 THEN n END) OVER w IS NOT NULL AND min(CASE WHEN asks THEN n END) OVER w IS NOT NULL THEN most END AS stop FROM (
      SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n, stream <> 'main' AS side, CASE WHEN type IN ('user', 'slash_command', 'tool_result') AND stream <> 'main' THEN split_part(stream, ':', 2) ELSE agent_id END AS agent,
        type IN ('user', 'slash_command', 'tool_result') AS says, type IN ('user', 'slash_command') AND stream = 'main' AS asks FROM ev WHERE type <> 'token_usage')
    WHERE n <= 200 WINDOW w AS (PARTITION BY session_id)) GROUP BY session_id)"""), on="events")
def header_claude_stop(e: DataFrame):
    """Files that hold several streams, whose folder is told by some lines only: what comes behind the line that completes the header isn't read."""
    lines = render.claude_lines(e).select("path", F.col("line_no").alias("place"),
                                          F.when(F.col("line_no") % 5 == 0, F.concat(F.lit('{"cwd":"/p",'), F.expr("substring(value, 2)"))).otherwise(F.col("value")).alias("value"))
    return catalog.claude_headers(lines).select("path", "session_id", "cwd", "is_sidechain", "agent_id")


_BROKEN = """bk AS (SELECT session_id AS path, provider, seq, CASE WHEN seq % 17 = 0 THEN 'parse_error' WHEN seq % 19 = 0 THEN 'missing_field' WHEN seq % 23 = 0 THEN 'type_mismatch' END AS bad FROM ev WHERE type <> 'token_usage'),
dg AS (SELECT path, any_value(provider) AS provider, coalesce(arg_min(bad, seq) FILTER (bad IS NOT NULL), 'ok') AS status, count(*) AS records FROM bk GROUP BY path)"""


def broken_lines(e: DataFrame) -> DataFrame:
    """Lines of the first format, some of which aren't JSON, lack their type or have one that isn't a string."""
    n = F.col("line_no")
    return render.claude_lines(e).withColumn("value", F.when(n % 17 == 0, "{broken").when(n % 19 == 0, '{"uuid":"u"}').when(n % 23 == 0, '{"type":5}').otherwise(F.col("value")))


@query(O.on_events("SELECT path, status, records FROM dg", _BROKEN), on="events")
def diagnose(e: DataFrame):
    return catalog.diagnose(broken_lines(e)).select("path", "status", "records")


@query(O.on_events("""SELECT provider, count(*) AS files, count(*) FILTER (status = 'ok') AS parsed, count(*) FILTER (status = 'parse_error') AS parse_error, count(*) FILTER (status = 'missing_field') AS missing_field,
  count(*) FILTER (status = 'type_mismatch') AS type_mismatch, min(path) FILTER (status <> 'ok') AS example_path FROM dg GROUP BY provider""", _BROKEN), on="events")
def diagnose_providers(e: DataFrame):
    files = e.select(F.col("session_id").alias("path"), "provider").distinct()
    return catalog.diagnose_providers(broken_lines(e), files).drop("example")


@query(O.on_events("SELECT path, status, (SELECT count(*) FROM bk WHERE bk.path = dg.path AND bad IS NULL) - coalesce((SELECT count(*) FROM lost WHERE lost.path = dg.path), 0) AS events FROM dg",
                   _BROKEN, """lost AS (SELECT x.session_id AS path, x.seq FROM ev x WHERE x.type = 'tool_result' AND NOT (x.seq % 17 = 0 OR x.seq % 19 = 0 OR x.seq % 23 = 0)
  AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.type = 'tool_call' AND c.event_id = x.tool_call_id AND c.session_id = x.session_id AND NOT (c.seq % 17 = 0 OR c.seq % 19 = 0 OR c.seq % 23 = 0)))"""), on="events")
def check_file(e: DataFrame):
    lines = stored(broken_lines(e))
    return catalog.check_file(lines, ingest.claude_events(lines)).select("path", "status", "events")


@query(O.on_events("""SELECT path, seq AS line_no, greatest(0, k - 1)::INT AS turn_index, coalesce(sum(CAST(spawns OR (NOT starts AND k > 0) AS INT)) OVER (PARTITION BY path, grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS step_index
  FROM (SELECT *, CASE WHEN first_said = 'user' AND k <= 1 THEN 0 ELSE k END AS grp FROM (SELECT session_id AS path, seq, type IN ('user', 'slash_command') AS starts, type = 'tool_result' AS spawns,
    sum(CAST(type IN ('user', 'slash_command') AS INT)) OVER w AS k, first_value(CASE WHEN type IN ('user', 'slash_command') THEN type END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_said
    FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY seq))) QUALIFY spawns"""), on="events")
def spawn_events(e: DataFrame):
    got = ingest.spawn_events(render.review_lines(e))
    return got.join(e.select(F.col("session_id").alias("path"), F.col("ts").alias("spawn_ts"), F.col("seq").alias("line_no")), ["path", "spawn_ts"]).select("path", "line_no", "turn_index", "step_index")


@query(O.on_events("SELECT session_id, event_id, seq, type, text, tool_name, output, is_error, tok_cached, model, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM ev"), on="events")
def scan_agent_events(e: DataFrame):
    folder = f"{shared_dir(e.sparkSession)}/jsonl-{uuid.uuid4().hex}"
    Q.as_jsonl(e).write.text(folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    back = ingest.scan_agent_events(e.sparkSession, folder, schema=schema)
    return back.select("session_id", "event_id", "seq", "type", "text", "tool_name", "output", "is_error", "tok_cached", "model", F.floor(F.unix_micros("ts") / 1000).alias("ms"))


@query(O.on_events("SELECT event_id, json_extract_string(payload_json, '$.type') AS type, text, tool_name, is_error FROM ev"), on="events")
def sink_jsonl(e: DataFrame):
    v = Q.as_jsonl(e).select(F.from_json("value", "event_id string, type string, text string, tool_name string, is_error boolean").alias("v"))
    return v.select("v.*")


# --- expressions, over commands, paths and messages made of the documents' words -----------------------------------------

def word() -> Column:
    return F.regexp_extract("text", "[a-z]+", 0)


_WORD = "regexp_extract(text, '[a-z]+')"


def _made(d: DataFrame) -> DataFrame:
    """A command of one of six forms for each document."""
    forms = [F.concat(F.lit("cat -n "), word(), F.lit(".txt")), F.concat(F.lit('rg -n "'), word(), F.lit(' x" src')), F.concat(F.lit("sed -n '1,20p' "), word(), F.lit(".rs")),
             F.concat(F.lit("bash -lc grep "), word(), F.lit(" lib")), F.concat(F.lit("sed -i s/a/b/ "), word()), F.concat(F.lit("make "), word())]
    return d.select("doc_id", F.element_at(F.array(*forms), (F.col("doc_id") % 6 + 1).cast("int")).alias("c"))


@on_documents("shell_intent", "SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 2) THEN 'read' WHEN doc_id % 6 IN (1, 3) THEN 'search' END AS intent FROM documents")
def _shell_intent(d):
    return _made(d).select("doc_id", T.shell_intent(F.col("c")).alias("intent"))


@on_documents("search_pattern_of", f"SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN {_WORD} || ' x' WHEN 3 THEN {_WORD} END AS pattern FROM documents WHERE {_WORD} <> ''")
def _search_pattern_of(d):
    return _made(d.where(word() != "")).select("doc_id", T.search_pattern_of(F.col("c")).alias("pattern"))


@on_documents("file_path_of", f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN {_WORD} || '.txt' WHEN 1 THEN '"' || {_WORD} WHEN 2 THEN {_WORD} || '.rs' WHEN 3 THEN 'lib' WHEN 4 THEN {_WORD} END AS path FROM documents WHERE {_WORD} <> ''""")
def _file_path_of(d):
    return _made(d.where(word() != "")).select("doc_id", T.file_path_of(F.col("c")).alias("path"))


@on_documents("patch_header", f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Add' WHEN 1 THEN 'Update' END AS op, CASE WHEN doc_id % 3 < 2 THEN 'src/' || {_WORD} || '.py' END AS path FROM documents""")
def _patch_header(d):
    head = F.element_at(F.array(*[F.lit(x) for x in ("*** Add File: ", "*** Update File: ", "*** Delete File: ")]), (F.col("doc_id") % 3 + 1).cast("int"))
    op, path = X.patch_header(F.concat(F.lit("*** Begin Patch\n"), head, F.lit("src/"), word(), F.lit(".py\n+x\n*** Update File: other\n")))
    return d.select("doc_id", F.when(F.col("doc_id") % 3 < 2, op).alias("op"), F.when(F.col("doc_id") % 3 < 2, path).alias("path"))


@on_documents("tool_summary_common", f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '(args...)' WHEN octet_length(encode(t)) > 80 THEN left(t, 77) || '...' ELSE t END AS summary FROM
  (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN left(text, 90) WHEN 1 THEN 'ls ' || {_WORD} WHEN 2 THEN {_WORD} END AS t FROM documents WHERE text IS NOT NULL)""")
def _tool_summary(d):
    n = F.col("doc_id") % 4
    args = F.when(n == 0, F.to_json(F.struct(F.substring("text", 1, 90).alias("query")))).when(n == 1, F.to_json(F.struct(F.array(F.lit("ls"), word()).alias("command")))).when(
        n == 2, F.to_json(F.struct(word().alias("path")))).otherwise('{"x":1}')
    kind = F.element_at(F.array(*[F.lit(k) for k in ("search", "execute", "read", "plan")]), (n + 1).cast("int"))
    return d.where("text is not null").select("doc_id", T.tool_summary(kind, args).alias("summary"))


@on_documents("detect_provider", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'gemini' END AS provider FROM documents")
def _detect_provider(d):
    home = F.element_at(F.array(*[F.lit(x) for x in ("/h/.claude/projects/", "/h/.codex/sessions/", "/h/.gemini/tmp/", "/h/other/")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", ingest.detect_provider(F.concat(home, F.coalesce("source", F.lit("x")))).alias("provider"))


@on_documents("categorize_error", f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'missing_field' WHEN 1 THEN 'type_mismatch' ELSE 'parse_error' END AS failure, CASE WHEN doc_id % 4 < 2 THEN {_WORD} END AS field FROM documents WHERE {_WORD} <> ''""")
def _categorize_error(d):
    forms = [F.concat(F.lit("missing field `"), word(), F.lit("` at line 1")), F.concat(F.lit("invalid type: map for field `"), word(), F.lit("`")), F.lit("missing field"), F.lit("EOF while parsing")]
    failure, field = catalog.categorize_error(F.element_at(F.array(*forms), (F.col("doc_id") % 4 + 1).cast("int")))
    return d.where(word() != "").select("doc_id", failure.alias("failure"), field.alias("field"))


@on_documents("parse_ts", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 1704067200 + doc_id % 86400 - CASE WHEN doc_id % 3 = 1 THEN 7200 ELSE 0 END END AS s FROM documents")
def _parse_ts(d):
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 86400), "yyyy-MM-dd'T'HH:mm:ss")
    form = F.when(F.col("doc_id") % 3 == 0, F.concat(at, F.lit(".000Z"))).when(F.col("doc_id") % 3 == 1, F.concat(at, F.lit("+02:00"))).otherwise("no time")
    return d.select("doc_id", F.unix_seconds(ingest.parse_ts(form)).alias("s"))
