"""Every query by name: a function of (spark, sf_dir) and, where SQL can say the same, its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tools as T
from ..operators import analyze as A
from ..operators import query as Q
from ..operators import select as S
from ..operators.assemble import KEYS, Assembled, assemble
from ..streaming import live
from . import file_queries, index_queries, live_queries, log_queries  # noqa: F401  (they register their queries)
from . import oracle as O
from .bridge import bridged, conversation_events
from .registry import ORACLE, QUERIES, ms, on_documents, query

# --- assembly -------------------------------------------------------------------------------------------------

@query(O.on_tables("SELECT session_id, stream, event_id, type, turn_index, step_index FROM r"))
def turn_segmentation(a: Assembled):
    return a.rows.select(*KEYS, "event_id", "type", "turn_index", "step_index")


@query(O.on_tables("SELECT session_id, stream, turn_index, step_index, coalesce(max(CASE WHEN type = 'reasoning' THEN event_id END), arg_min(event_id, seq) FILTER (type IN ('message', 'tool_call'))) AS step_id FROM r GROUP BY ALL HAVING count(*) FILTER (type IN ('reasoning', 'message', 'tool_call')) > 0"))
def step_id(a: Assembled):
    return a.steps.where("reasoning is not null or message is not null or tool_count > 0").select(*KEYS, "turn_index", "step_index", "step_id")


@query(O.on_tables("SELECT session_id, stream, turn_index, step_index, CAST(floor(epoch_us(step_ts) / 1000) AS BIGINT) AS step_ms, reasoning, message, tool_count, missing, failed, fresh_input, cache_read, output, status FROM steps"))
def step_build(a: Assembled):
    return a.steps.select(*KEYS, "turn_index", "step_index", ms("step_ts").alias("step_ms"), "reasoning", "message", "tool_count", "missing", "failed", "fresh_input", "cache_read", "output", "status")


@query(O.on_tables("SELECT status, count(*) AS steps FROM steps GROUP BY status"))
def step_status(a: Assembled):
    return a.steps.groupBy("status").agg(F.count(F.lit(1)).alias("steps"))


@query(O.on_tables("SELECT session_id, stream, turn_index, step_index, call_index, call_id, tool_name, tool_kind, result_id, output, duration_ms, is_error FROM tools"))
def tool_pairing(a: Assembled):
    return a.tools.select(*KEYS, "turn_index", "step_index", "call_index", "call_id", "tool_name", "tool_kind", "result_id", "output", "duration_ms", "is_error")


def repeated_calls(e: DataFrame) -> DataFrame:
    """Events in which calls share ids: each id is that of a session's calls in twelve places; results are of the last call before."""
    before = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    call = F.when(F.col("type") == "tool_call", F.concat(F.lit("c"), F.floor(F.col("seq") / 12).cast("string")))
    e = e.withColumn("_call", call).withColumn("tool_call_id", F.when(F.col("type") == "tool_result", F.last("_call", True).over(before)))
    return e.withColumn("event_id", F.coalesce("_call", "event_id")).drop("_call")


_REPEATED = O.EV.replace("ev AS (", "ev0 AS (", 1) + """,
ev1 AS (SELECT *, CASE WHEN type = 'tool_call' THEN 'c' || (seq // 12) END AS cid FROM ev0),
ev AS (SELECT * EXCLUDE (cid) REPLACE (coalesce(cid, event_id) AS event_id, CASE WHEN type = 'tool_result' THEN last_value(cid IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS tool_call_id) FROM ev1)"""


@query("WITH " + ",".join([_REPEATED, O.ROWS, O.TABLES]) + "\nSELECT session_id, stream, turn_index, step_index, call_index, call_id, call_seq, result_id FROM tools", on="events")
def dedup_calls(e: DataFrame):
    return assemble(repeated_calls(e)).tools.select(*KEYS, "turn_index", "step_index", "call_index", "call_id", "call_seq", "result_id")


@query(O.on_tables("SELECT session_id, stream, turn_index, step_index, fresh_input, 0::BIGINT AS cache_creation, cache_read, output, tokens FROM steps WHERE usages > 0"))
def usage_merge(a: Assembled):
    return a.steps.where("usages > 0").select(*KEYS, "turn_index", "step_index", "fresh_input", F.lit(0).cast("long").alias("cache_creation"), "cache_read", "output", "tokens")


@query(O.on_tables("SELECT session_id, stream, turn_index, turn_id, slash_name, user_text, origin, step_count, duration_ms, total_tokens FROM turns"))
def turn_stats(a: Assembled):
    return a.turns.select(*KEYS, "turn_index", "turn_id", "slash_name", "user_text", "origin", "step_count", "duration_ms", "total_tokens")


@query(O.on_tables("SELECT provider, session_id, stream, total_turns, duration_seconds, total_tokens FROM sessions"))
def session_stats(a: Assembled):
    return a.sessions.select("provider", *KEYS, "total_turns", "duration_seconds", "total_tokens")


@query(O.on_tables("SELECT session_id, stream, row_number() OVER (PARTITION BY session_id ORDER BY stream <> 'main', start_time, stream) AS place FROM sessions"))
def split_streams(a: Assembled):
    return Q.split_streams(a)


@query(O.on_tables("SELECT session_id, total_turns, total_tokens FROM sessions WHERE stream = 'main'"))
def assemble_main(a: Assembled):
    return a.sessions.where("stream = 'main'").select("session_id", "total_turns", "total_tokens")


@query(O.on_tables("SELECT session_id, stream, turn_index, origin FROM turns WHERE origin = 'context_compaction'"))
def turn_origin(a: Assembled):
    return a.turns.where("origin = 'context_compaction'").select(*KEYS, "turn_index", "origin")


SUMMARY = """summary AS (SELECT session_id, stream, count(DISTINCT turn_index) AS user_messages, count(message) AS assistant_messages, sum(tool_count)::BIGINT AS tool_calls,
  count(reasoning) AS reasoning_blocks, (count(DISTINCT turn_index) + count(message) + count(reasoning) + 2 * sum(tool_count) + count(*) FILTER (usages > 0))::BIGINT AS total FROM steps GROUP BY ALL)"""


@query(O.on_tables("SELECT * FROM summary", SUMMARY))
def summarize(a: Assembled):
    return A.summarize(a)


TM = """tm0 AS (SELECT *, coalesce(last_value(turn_end IGNORE NULLS) OVER (PARTITION BY session_id, stream ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cum FROM turns),
tm1 AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY session_id, stream ORDER BY turn_index), 0) AS prv FROM tm0),
tm2 AS (SELECT *, origin = 'context_compaction' OR (prv > 0 AND cum < prv // 2) AS comp FROM tm1),
tm AS (SELECT session_id, stream, turn_index, (CASE WHEN comp THEN 0 ELSE prv END)::BIGINT AS prev_total, (CASE WHEN comp THEN cum ELSE greatest(0, cum - prv) END)::BIGINT AS delta,
  CASE WHEN comp THEN cum ELSE greatest(0, cum - prv) END >= 15000 AS is_heavy, turn_index = max(turn_index) OVER (PARTITION BY session_id, stream) AS is_active, comp AS context_compacted,
  cum::BIGINT AS cumulative_total, (CASE WHEN comp THEN prv END)::BIGINT AS compaction_from FROM tm2)"""


@query(O.on_tables("SELECT * FROM tm", TM))
def turn_metrics(a: Assembled):
    return A.turn_metrics(a)


@query(O.on_tables("SELECT session_id, stream, turn_index, bool_or(status = 'in_progress') AS active FROM (SELECT *, row_number() OVER (PARTITION BY session_id, stream, turn_index ORDER BY step_index DESC) AS back FROM steps) WHERE back <= 3 GROUP BY ALL"))
def is_turn_active(a: Assembled):
    return A.is_turn_active(a)


@query(O.on_tables("""SELECT session_id, stream, turn_index, step_index, run::BIGINT AS run, tool_name, count(*) AS calls, bool_or(is_error) AS has_errors, arg_min(call_id, call_index) AS sample_call FROM
 (SELECT *, sum(CASE WHEN prev = tool_name THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, stream, turn_index, step_index ORDER BY call_index) AS run FROM
  (SELECT *, lag(tool_name) OVER (PARTITION BY session_id, stream, turn_index, step_index ORDER BY call_index) AS prev FROM tools)) GROUP BY ALL HAVING count(*) >= 2"""))
def group_consecutive_tools(a: Assembled):
    return A.group_consecutive_tools(a, least=2)


@query(O.on_tables("""SELECT session_id, stream, turn_index, step_index, run::BIGINT AS run, tool_name, count(*) AS calls, bool_or(is_error) AS has_errors, arg_min(call_id, call_index) AS sample_call FROM
 (SELECT *, sum(CASE WHEN prev = tool_name THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, stream, turn_index, step_index ORDER BY call_index) AS run FROM
  (SELECT *, lag(tool_name) OVER (PARTITION BY session_id, stream, turn_index, step_index ORDER BY call_index) AS prev FROM tools)) GROUP BY ALL HAVING count(*) >= 3"""))
def group_three_consecutive_tools(a: Assembled):
    return A.group_consecutive_tools(a)


@query(O.on_tables("SELECT session_id, stream, turn_index, sum(fresh_input)::BIGINT AS input_tokens, sum(output)::BIGINT AS output_tokens, nullif(sum(cache_read), 0)::BIGINT AS cached_tokens, (sum(tokens) * 100.0::DOUBLE / 200000) AS context_pct FROM steps GROUP BY ALL"))
def turn_token_breakdown(a: Assembled):
    b = A.turn_token_breakdown(a)
    return b.withColumn("context_pct", F.col("context_pct").cast("double"))


@query(O.on_tables("""SELECT f.session_id, f.stream, left(regexp_replace(f.stream, '^[a-z]+:', ''), 8) AS label, opening, f.turn_index, cumulative_total, active FROM
 (SELECT session_id, stream, left(arg_min(user_text, turn_index), 60) AS opening, max(turn_index) AS turn_index FROM turns WHERE stream <> 'main' GROUP BY ALL) f
 JOIN tm USING (session_id, stream, turn_index) JOIN (SELECT session_id, stream, turn_index, bool_or(usages = 0) AS active FROM steps GROUP BY ALL) USING (session_id, stream, turn_index)""", TM))
def child_stream_view(a: Assembled):
    return A.child_stream_view(a)


# --- metrics and diagnostics ------------------------------------------------------------------------------------

METRICS = """sm AS (SELECT s.*, max_e2e_ms, loop_signals, coalesce(max_tool_ms, 0) AS max_tool_ms FROM
  (SELECT provider, session_id, stream, sum(tool_count)::BIGINT AS tool_calls_total, sum(failed)::BIGINT AS tool_failures_total, sum(missing)::BIGINT AS missing_tool_pairs, max(tool_count) AS longest_chain FROM steps GROUP BY ALL) s
  JOIN (SELECT session_id, stream, greatest(max(duration_ms), 0) AS max_e2e_ms, count(*) FILTER (tool_count > 5) AS loop_signals FROM turns GROUP BY ALL) t USING (session_id, stream)
  LEFT JOIN (SELECT session_id, stream, greatest(coalesce(max(duration_ms), 0), 0) AS max_tool_ms FROM tools GROUP BY ALL) x USING (session_id, stream))"""


@query(O.on_tables("SELECT * FROM sm", METRICS))
def session_metrics(a: Assembled):
    return A.session_metrics(a)


FAILURES = "fl AS (SELECT session_id, stream, turn_index, 'failures' AS diagnostic, 'critical' AS severity, failed || ' tool execution(s) failed' AS message FROM turns WHERE failed > 0)"
LOOPS = """k0 AS (SELECT session_id, stream, turn_index, string_agg(tool_kind, ',' ORDER BY step_index, call_index) AS kinds FROM tools GROUP BY ALL),
k1 AS (SELECT t.session_id, t.stream, t.turn_index, kinds, lag(kinds) OVER (PARTITION BY t.session_id, t.stream ORDER BY t.turn_index) AS was FROM turns t LEFT JOIN k0 USING (session_id, stream, turn_index)),
k2 AS (SELECT *, sum(CASE WHEN kinds IS NOT NULL AND was = kinds THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, stream ORDER BY turn_index) AS island FROM k1),
lp AS (SELECT session_id, stream, turn_index, 'loops' AS diagnostic, 'warning' AS severity, 'Repeated tool sequence detected' AS message FROM k2 QUALIFY row_number() OVER (PARTITION BY session_id, stream, island ORDER BY turn_index) >= 3)"""
SLOW = """bn AS (SELECT session_id, stream, turn_index, 'bottlenecks' AS diagnostic, 'warning' AS severity,
  'Slow tool execution (' || upper(tool_kind[1]) || tool_kind[2:] || ' took ' || (duration_ms // 1000) || 's)' AS message FROM tools WHERE duration_ms > 10000)"""


@query(O.on_tables("SELECT * FROM fl", FAILURES))
def analyze_failures(a: Assembled):
    return A.analyze_failures(a)


@query(O.on_tables("SELECT * FROM lp", LOOPS))
def analyze_loops(a: Assembled):
    return A.analyze_loops(a)


@query(O.on_tables("SELECT * FROM bn", SLOW))
def analyze_bottlenecks(a: Assembled):
    return A.analyze_bottlenecks(a)


@query(O.on_tables("SELECT * FROM fl UNION ALL SELECT * FROM lp UNION ALL SELECT * FROM bn", FAILURES, LOOPS, SLOW))
def union_insights(a: Assembled):
    return A.insights(a)


@query(O.on_tables("SELECT s.*, coalesce(n, 0) AS insights, greatest(0, 100 - 10 * coalesce(n, 0)) AS score FROM summary s LEFT JOIN (SELECT session_id, stream, count(*) AS n FROM (SELECT * FROM fl UNION ALL SELECT * FROM lp UNION ALL SELECT * FROM bn) GROUP BY ALL) USING (session_id, stream)", SUMMARY, FAILURES, LOOPS, SLOW))
def analysis_report(a: Assembled):
    return A.analysis_report(a, ("failures", "loops", "bottlenecks"))


@query(O.on_tables("SELECT session_id, stream, greatest(0, 100 - 10 * coalesce(n, 0)) AS score FROM summary s LEFT JOIN (SELECT session_id, stream, count(*) AS n FROM fl GROUP BY ALL) USING (session_id, stream)", SUMMARY, FAILURES))
def health_score(a: Assembled):
    return A.analysis_report(a).select(*KEYS, "score")


CLASS_SQL = "CASE " + " ".join(
    f"WHEN provider = '{p}' AND tool_name IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for p, kinds in T.CLASSES.items() for kind, names in kinds.items()
) + " WHEN starts_with(tool_name, 'mcp__') THEN 'other' " + " ".join(f"WHEN regexp_matches(lower(tool_name), '{w}') THEN '{k}'" for k, w in T.COMMON) + " ELSE 'other' END"


@query(O.on_tables(f"""SELECT provider, tool_name, count(*) AS calls, CASE WHEN starts_with(tool_name, 'mcp__') THEN 'mcp' ELSE 'system' END AS origin, {CLASS_SQL} AS kind,
  min({{'s': session_id, 'q': call_seq, 'c': call_id, 'o': coalesce(output, '')}}).c AS sample_call, min({{'s': session_id, 'q': call_seq, 'c': call_id, 'o': coalesce(output, '')}}).o AS sample_output FROM tools GROUP BY provider, tool_name"""))
def tool_usage(a: Assembled):
    return A.tool_usage(a)


@query(O.on_events(f"SELECT DISTINCT provider, tool_name, CASE WHEN starts_with(tool_name, 'mcp__') THEN 'mcp' ELSE 'system' END AS origin, {CLASS_SQL} AS kind FROM ev WHERE type = 'tool_call'"), on="events")
def classify_tool(e: DataFrame):
    name = F.col("tool_name")
    return e.where("type = 'tool_call'").select("provider", "tool_name", T.origin_of(name).alias("origin"), T.classify(F.col("provider"), name).alias("kind")).distinct()


@query(O.on_tables("""SELECT provider, dimension, value, calls, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY provider, dimension ORDER BY calls DESC, value) AS INT) AS rank FROM
 (SELECT provider, dimension, value, count(*) AS calls FROM (
   SELECT provider, 'tool_kind' AS dimension, tool_kind AS value FROM tools UNION ALL SELECT provider, 'tool_name', tool_name FROM tools UNION ALL SELECT provider, 'command', command FROM tools
   UNION ALL SELECT provider, 'tool_command', tool_name || ': ' || command FROM tools
   UNION ALL SELECT provider, 'first_word', split_part(command, ' ', 1) FROM tools UNION ALL SELECT provider, 'file_path', file_path FROM tools
   UNION ALL SELECT provider, 'mcp_server', mcp_server FROM tools UNION ALL SELECT provider, 'mcp_tool', mcp_tool FROM tools) WHERE value IS NOT NULL GROUP BY ALL)) WHERE rank <= 5"""))
def tool_call_stats(a: Assembled):
    return A.tool_call_stats(a)


@query(O.on_tables("SELECT provider, tool_name, count(DISTINCT command) AS commands FROM tools WHERE command IS NOT NULL GROUP BY ALL"))
def distinct_commands(a: Assembled):
    return A.distinct_commands(a)


@query(O.on_tables("SELECT provider, round(-sum(p * log2(p)), 9) AS entropy FROM (SELECT provider, n / sum(n) OVER (PARTITION BY provider) AS p FROM (SELECT provider, tool_name, count(*) AS n FROM tools GROUP BY ALL)) GROUP BY provider"))
def tool_entropy(a: Assembled):
    return A.tool_entropy(a).withColumn("entropy", F.round("entropy", 9))


@query(O.on_tables("""SELECT *, calls::DOUBLE / sessions AS tools_per_session, parallel_steps::DOUBLE / steps * 100.0 AS parallelization_rate, parallel_calls::DOUBLE / calls * 100.0 AS parallel_calls_ratio,
  errors::DOUBLE / calls * 100.0 AS error_rate, tokens::DOUBLE / sessions AS tokens_per_session, tokens::DOUBLE / calls AS tokens_per_tool,
  read_calls::DOUBLE / (read_calls + write_calls + execute_calls) * 100.0 AS read_share, write_calls::DOUBLE / (read_calls + write_calls + execute_calls) * 100.0 AS write_share,
  execute_calls::DOUBLE / (read_calls + write_calls + execute_calls) * 100.0 AS execute_share
 FROM (SELECT provider, count(*) AS sessions, sum(total_turns)::BIGINT AS turns, sum(total_tokens)::BIGINT AS tokens FROM sessions WHERE total_turns > 0 GROUP BY provider)
 JOIN (SELECT provider, count(*) AS steps, count(*) FILTER (tool_count > 1) AS parallel_steps, coalesce(sum(tool_count) FILTER (tool_count > 1), 0)::BIGINT AS parallel_calls FROM steps GROUP BY provider) USING (provider)
 JOIN (SELECT provider, count(*) AS calls, count(*) FILTER (is_error) AS errors, count(*) FILTER (tool_kind = 'read') AS read_calls, count(*) FILTER (tool_kind = 'write') AS write_calls,
   count(*) FILTER (tool_kind = 'execute') AS execute_calls, count(*) FILTER (tool_kind = 'search') AS search_calls, count(*) FILTER (tool_kind = 'other') AS other_calls FROM tools GROUP BY provider) USING (provider)"""))
def provider_efficiency(a: Assembled):
    return A.provider_efficiency(a)


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


INTENT = f"""CASE WHEN word IN {_in((*T.READERS, *T.SEARCHERS))} OR (word = 'sed' AND NOT in_place) OR (word = 'awk' AND NOT contains(command, '>')) THEN 'read'
  WHEN word IN {_in(T.WRITERS)} OR (word IN ('echo', 'printf', 'awk') AND contains(command, '>')) OR word = 'sed' THEN 'write'
  WHEN regexp_matches(command, 'build|compile') OR word = 'make' THEN 'build' WHEN regexp_matches(command, 'test|jest') THEN 'test' WHEN word IN ('git', 'gh') THEN 'git' ELSE 'other' END"""


@query(O.on_tables(f"""SELECT provider, intent, count(*) AS calls, array_to_string(list_sort(list_distinct(list(command)))[1:3], ' | ') AS examples, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY provider) AS share FROM
  (SELECT provider, command, {INTENT} AS intent FROM (SELECT *, regexp_extract(command, '^\\s*(\\S*)', 1) AS word, regexp_matches(command, '(^|\\s)(-i|--in-place)($|[^a-zA-Z0-9])') AS in_place FROM tools WHERE command IS NOT NULL))
  GROUP BY provider, intent"""))
def execute_breakdown(a: Assembled):
    return A.execute_breakdown(a)


@query(O.on_tables("""SELECT count(*) AS sample_size, coalesce(sum(tool_calls_total), 0)::BIGINT AS total_tool_calls, coalesce(sum(tool_failures_total), 0)::BIGINT AS total_failures, coalesce(max(max_e2e_ms), 0) AS max_e2e_ms
  FROM (SELECT session_id, stream FROM sessions WHERE stream = 'main' ORDER BY start_time DESC, session_id LIMIT 100) LEFT JOIN sm USING (session_id, stream)""", METRICS))
def corpus_stats(a: Assembled):
    return A.corpus_stats(a)


LIMITS = "lim(prefix, max_tokens, buffer_pct) AS (VALUES " + ", ".join(f"('{p}', {n}::BIGINT, {b}::DOUBLE)" for p, n, b in T.MODEL_LIMITS) + ")"
MODEL = """ml AS (SELECT model, arg_max(max_tokens, length(prefix)) AS max_tokens, arg_max(buffer_pct, length(prefix)) AS buffer_pct FROM (SELECT DISTINCT model FROM ev) JOIN lim ON starts_with(model, prefix) GROUP BY model)"""


@query(O.on_events("SELECT DISTINCT e.session_id, e.model, max_tokens, buffer_pct FROM ev e LEFT JOIN ml USING (model)", LIMITS, MODEL), on="events")
def join_model_limit(e: DataFrame):
    return T.join_model_limit(e.select("session_id", "model").distinct())


USAGE = """cu AS (SELECT session_id, stream, cumulative_total AS used, (SELECT arg_max(model, seq) FROM ev WHERE ev.session_id = tm.session_id AND ev.stream = tm.stream) AS model FROM tm WHERE is_active AND stream = 'main'),
cl AS (SELECT cu.*, max_tokens, CASE WHEN max_tokens IS NOT NULL THEN greatest(1, CAST(floor(max_tokens * (100 - buffer_pct) / 100) AS BIGINT)) END AS effective FROM cu LEFT JOIN ml USING (model)),
cr AS (SELECT *, coalesce(used / effective::DOUBLE, 0.0::DOUBLE) AS ratio FROM cl)"""


@query(O.on_tables("""SELECT session_id, stream, model, used, max_tokens, effective, ratio, CASE WHEN effective IS NULL THEN NULL ELSE greatest(0, effective - used) END AS remaining,
  CASE WHEN ratio > 0.9 THEN 'error' WHEN ratio > 0.8 THEN 'warning' ELSE 'success' END AS level, used * 100.0::DOUBLE / max_tokens AS used_pct FROM cr""", TM, LIMITS, MODEL, USAGE))
def context_ratio(a: Assembled):
    return A.context_usage(a).drop("elapsed_ms").withColumn("used_pct", F.col("used") * F.lit(100.0).cast("double") / F.col("max_tokens"))


@query(O.on_events("SELECT session_id, type, count(*) AS n FROM ev GROUP BY ALL"), on="events")
def count_by_event_type(e: DataFrame):
    return Q.count_by_type(e)


# --- filters, search, pages -------------------------------------------------------------------------------------

@query(O.on_events("SELECT event_id, type FROM ev WHERE type IN ('user', 'tool_call', 'tool_result')"), on="events")
def filter_event_types(e: DataFrame):
    return Q.filter_event_types(e, ["User", "tool", "assistant"], ["message"]).select("event_id", "type")


@query(O.on_events("SELECT event_id, session_id FROM ev WHERE stream = 'main'"), on="events")
def filter_display(e: DataFrame):
    return Q.filter_display(e).select("event_id", "session_id")


@query(O.on_events("SELECT event_id, tool_name FROM ev WHERE type = 'tool_call' AND lower(tool_name) = 'bash'"), on="events")
def filter_tool_name(e: DataFrame):
    return Q.filter_tool_name(e, "bash").select("event_id", "tool_name")


@query(O.on_events(r"SELECT event_id, session_id, type FROM ev WHERE regexp_matches(payload_json, '(ask [0-9]*7|cargo (build|test))') ORDER BY session_id, seq LIMIT 10"), on="events")
def grep_events(e: DataFrame):
    return Q.grep_events(e, r"(ask [0-9]*7|cargo (build|test))", regex=True).select("event_id", "session_id", "type")


@query(O.on_events(r"SELECT event_id FROM ev WHERE type = 'tool_call' AND tool_name = 'Read' AND regexp_matches(payload_json, '^(?s:.*)/f1[^/]\.rs(?s:.*)$')"), on="events")
def grep_glob(e: DataFrame):
    return Q.grep_events(e, "**/f1?.rs**", tool="Read", limit=None).select("event_id")


LOC = """loc AS (SELECT ev.session_id, ev.stream, ev.event_id, CAST(row_number() OVER (PARTITION BY ev.session_id, ev.stream ORDER BY ev.seq) - 1 AS INT) AS event_index, r.turn_index, r.step_index, ev.type, ev.payload_json, ev.provider, ev.seq,
  CASE ev.type WHEN 'tool_call' THEN ev.tool_name || ': ' || coalesce(ev.file_path, ev.command, ev.pattern, '') WHEN 'tool_result' THEN ev.output WHEN 'slash_command' THEN ev.slash_name
    WHEN 'token_usage' THEN 'tokens: in=' || (ev.tok_cached + ev.tok_uncached) || ' out=' || ev.tok_generated ELSE coalesce(ev.text, '') END AS preview
  FROM ev LEFT JOIN r USING (session_id, stream, seq))"""


@query(O.on_tables("SELECT session_id, stream, event_id, event_index, turn_index, step_index FROM loc", LOC))
def event_location(a: Assembled):
    return Q.event_location(a).select(*KEYS, "event_id", "event_index", "turn_index", "step_index")


@query(O.on_tables("SELECT session_id, stream, event_index, turn_index, step_index, type, preview, 'eyJvZmZzZXQiOjQwfQ==' AS next_cursor FROM loc WHERE contains(payload_json, 'message') AND type = 'message' ORDER BY session_id, stream, event_index LIMIT 20 OFFSET 20", LOC))
def search_events(a: Assembled):
    return Q.search_events(a, "message", types=["assistant"], page=Q.cursor(20))


_COUNTED = """lc AS (SELECT session_id, event_id, stream, type, payload_json, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS BIGINT) AS event_index FROM ev),
sc AS (SELECT session_id, turn_index, step_index, size, sum(size) OVER (PARTITION BY session_id ORDER BY turn_index, step_index) AS upto FROM (
  SELECT session_id, turn_index, step_index, CAST(reasoning IS NOT NULL AS INT) + CAST(message IS NOT NULL AS INT) + 2 * tool_count AS size FROM steps WHERE stream = 'main')),
cl AS (SELECT lc.session_id, lc.stream, event_id, event_index, type, payload_json, coalesce(sc.turn_index, 0) AS turn_index, coalesce(sc.step_index, 0) AS step_index FROM lc
  LEFT JOIN sc ON sc.session_id = lc.session_id AND event_index >= upto - size AND event_index < upto)"""


@query(O.on_tables("SELECT session_id, stream, event_id, event_index, turn_index, step_index FROM cl", _COUNTED))
def event_location_compat(a: Assembled):
    return Q.counted_location(a).select(*KEYS, "event_id", "event_index", "turn_index", "step_index")


@query(O.on_tables("SELECT session_id, stream, event_index, turn_index, step_index, type, 'eyJvZmZzZXQiOjIwfQ==' AS next_cursor FROM cl WHERE contains(payload_json, 'message') AND type = 'message' ORDER BY session_id, event_index LIMIT 20", _COUNTED))
def search_events_compat(a: Assembled):
    return Q.search_events(a, "message", types=["assistant"], compat=True).drop("preview")


@query(O.on_tables("SELECT event_id, preview FROM loc", LOC))
def event_preview(a: Assembled):
    return Q.event_location(a).select("event_id", "preview")


@query(O.on_tables("""SELECT t.session_id, t.stream, t.turn_index, t.user_text, CASE WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status, step_count, duration_ms, total_tokens, coalesce(tools_used, '') AS tools_used
 FROM turns t LEFT JOIN (SELECT session_id, stream, turn_index, string_agg(tool_name || '=' || n, ',' ORDER BY tool_name || '=' || n) AS tools_used FROM (SELECT session_id, stream, turn_index, tool_name, count(*) AS n FROM tools GROUP BY ALL) GROUP BY ALL) USING (session_id, stream, turn_index)"""))
def list_turns(a: Assembled):
    return Q.list_turns(a)


def long_texts(e: DataFrame) -> DataFrame:
    """Events whose messages and results are repeated, so that some outgrow every bound."""
    times = (F.col("seq") % 700).cast("int")
    return e.withColumns({"text": F.when(F.col("type") == "message", F.repeat("text", times)).otherwise(F.col("text")), "output": F.repeat("output", times)})


LONG = """SELECT * REPLACE (CASE WHEN type = 'message' THEN repeat(text, seq % 700) ELSE text END AS text, repeat(output, seq % 700) AS output) FROM"""
_LONG_EV = O.EV.replace("ev AS (", "ev0 AS (", 1) + f", ev AS ({LONG} ev0)"


@query("WITH " + ",".join([_LONG_EV, O.ROWS, O.TABLES]) + """
SELECT session_id, turn_index, step_index, reasoning, CASE WHEN length(message) > 3000 THEN left(message, 3000) || '...(truncated)' ELSE message END AS message, status, tool_count, tokens
FROM steps WHERE stream = 'main' AND turn_index IN (0, 2) AND step_index < 30""", on="events")
def get_turns(e: DataFrame):
    return Q.get_turns(assemble(long_texts(e)), [0, 2])


def _cut(c: str) -> str:
    return f"CASE WHEN octet_length(encode({c})) > 5000 THEN left({c}, 1000) || '...<truncated_output_for_training>' ELSE {c} END AS {c}"


@query("WITH " + _LONG_EV + f"""
SELECT event_id, type, {_cut('text')}, {_cut('output')} FROM (SELECT *, coalesce(last_value(CASE WHEN type = 'tool_result' THEN is_error END IGNORE NULLS) OVER (PARTITION BY session_id, stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS skip FROM ev)
  WHERE NOT skip AND NOT (type = 'message' AND regexp_matches(lower(text), 'i apologize|my mistake|sorry'))""", on="events")
def export_clean(e: DataFrame):
    return Q.export_clean(long_texts(e)).select("event_id", "type", "text", "output")


@query(O.on_events("SELECT event_id, session_id, seq, type, payload_json FROM ev"), on="events")
def export_raw(e: DataFrame):
    return Q.export_raw(e).select("event_id", "session_id", "seq", "type", "payload_json")


@query(O.on_events("""SELECT event_id, session_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, stream, type, CASE type WHEN 'tool_result' THEN ev.output WHEN 'slash_command' THEN slash_name WHEN 'tool_call' THEN tool_name ELSE text END AS said, is_error,
  tok_cached + tok_uncached AS input, tok_generated AS output, tok_cached + tok_uncached + tok_generated AS total, tok_cached AS cache_read FROM ev"""), on="events")
def event_view(e: DataFrame):
    return Q.event_view(e).withColumn("ms", ms("ts")).drop("ts")


_KIDS = """kids AS (SELECT t.session_id, t.turn_index, coalesce(string_agg(c.stream, ',' ORDER BY c.stream), '') AS children FROM turns t LEFT JOIN
  (SELECT s.session_id, s.stream, m.t FROM sessions s JOIN (SELECT session_id, agent_id, arg_max(turn_index, seq) AS t FROM r WHERE stream = 'main' AND type = 'tool_result' AND agent_id IS NOT NULL GROUP BY ALL) m
   ON m.session_id = s.session_id AND s.stream = 'sidechain:' || m.agent_id) c ON c.session_id = t.session_id AND c.t = t.turn_index WHERE t.stream = 'main' GROUP BY ALL),
rn AS (SELECT session_id, stream, turn_index, step_index, run, tool_name, count(*) AS n FROM (SELECT *, sum(CASE WHEN prev = tool_name THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, stream, turn_index, step_index ORDER BY call_index) AS run FROM
  (SELECT *, lag(tool_name) OVER (PARTITION BY session_id, stream, turn_index, step_index ORDER BY call_index) AS prev FROM tools)) GROUP BY ALL),
tl AS (SELECT session_id, stream, turn_index, step_index, string_agg(CASE WHEN n >= 3 THEN tool_name || ' x' || n WHEN n = 2 THEN tool_name || ', ' || tool_name ELSE tool_name END, ', ' ORDER BY run) AS tools FROM rn GROUP BY ALL)"""


@query(O.on_tables("""SELECT s.session_id, s.stream, CAST(dense_rank() OVER (PARTITION BY s.session_id ORDER BY s.stream <> 'main', s.stream) AS INT) AS stream_place,
  CAST(floor((epoch_us(max(step_ts) OVER w) - epoch_us(min(s.turn_ts) OVER w)) / 1000) AS BIGINT) AS session_ms, s.turn_index, user_text, delta, cumulative_total, is_active, coalesce(children, '') AS children, s.step_index, status, reasoning,
  coalesce(tl.tools, '') AS tools, message, tokens, tokens * 100.0::DOUBLE / 200000 AS context_pct
  FROM steps s JOIN turns t USING (session_id, stream, turn_index) JOIN tm USING (session_id, stream, turn_index) LEFT JOIN kids ON kids.session_id = s.session_id AND s.stream = 'main' AND kids.turn_index = s.turn_index
  LEFT JOIN tl ON tl.session_id = s.session_id AND tl.stream = s.stream AND tl.turn_index = s.turn_index AND tl.step_index = s.step_index WINDOW w AS (PARTITION BY s.session_id, s.stream)""", TM, _KIDS))
def session_view(a: Assembled):
    return Q.session_view(a)


@query(O.on_events("SELECT event_id, type FROM (SELECT *, lag(type) OVER (PARTITION BY session_id, stream ORDER BY seq) AS b FROM ev) WHERE type = 'reasoning' OR (type = 'tool_call' AND b = 'reasoning')"), on="events")
def export_reasoning(e: DataFrame):
    return Q.export_reasoning(e).select("event_id", "type")


@query(O.on_tables("SELECT session_id, stream, row_number() OVER (ORDER BY start_time DESC, session_id, stream) AS place FROM sessions"))
def order_sessions(a: Assembled):
    return Q.number_sessions(a.sessions).select(*KEYS, "place")


@query(O.on_tables("SELECT session_id, stream FROM sessions WHERE start_time >= TIMESTAMP '2024-01-01 00:30:00' AND start_time <= TIMESTAMP '2024-01-05 00:00:00'"))
def filter_since_until(a: Assembled):
    return Q.sessions_between(a.sessions, "2024-01-01T00:30:00Z", "2024-01-05T00:00:00Z").select(*KEYS)


@query(O.on_tables("SELECT provider, session_id, total_turns, total_tokens, CASE WHEN (SELECT count(*) FROM sessions WHERE stream = 'main') > 20 THEN 'eyJvZmZzZXQiOjIwfQ==' END AS next_cursor FROM sessions WHERE stream = 'main' ORDER BY start_time DESC, session_id LIMIT 10 OFFSET 10"))
def list_sessions(a: Assembled):
    main = a.sessions.where("stream = 'main'")
    return Q.page_of(main, Q.order_sessions(main), 10, Q.cursor(10)).select("provider", "session_id", "total_turns", "total_tokens", "next_cursor")


@query(O.on_events("SELECT session_id, event_id, recency FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS INT) AS recency FROM ev) WHERE recency <= 50"), on="events")
def recent_events(e: DataFrame):
    return Q.recent_events(e).select("session_id", "event_id", "recency")


@query(O.on_events("SELECT tool_name, count(*) AS calls FROM ev WHERE type = 'tool_call' GROUP BY tool_name ORDER BY calls DESC, tool_name LIMIT 5"), on="events")
def top_k(e: DataFrame):
    return Q.top_tools(e)


@query(O.on_events("SELECT provider, arg_max(session_id, {'t': ts, 's': session_id}) AS session_id FROM ev GROUP BY provider"), on="events")
def most_recent_session(e: DataFrame):
    return Q.most_recent_session(e)


@query(O.on_tables("""SELECT s.session_id, s.stream, m.t AS spawned_turn, m.p AS spawned_step FROM sessions s LEFT JOIN
  (SELECT session_id, agent_id, arg_max(turn_index, seq) AS t, arg_max(step_index, seq) AS p FROM r WHERE stream = 'main' AND type = 'tool_result' AND agent_id IS NOT NULL GROUP BY ALL) m
  ON m.session_id = s.session_id AND s.stream = 'sidechain:' || m.agent_id WHERE starts_with(s.stream, 'sidechain:')"""))
def join_sidechain_spawn(a: Assembled):
    return Q.join_sidechain_spawn(a)


@query(O.on_tables("""SELECT t.session_id, t.turn_index, coalesce(string_agg(c.stream, ',' ORDER BY c.stream), '') AS children FROM turns t LEFT JOIN
  (SELECT s.session_id, s.stream, m.t FROM sessions s JOIN (SELECT session_id, agent_id, arg_max(turn_index, seq) AS t FROM r WHERE stream = 'main' AND type = 'tool_result' AND agent_id IS NOT NULL GROUP BY ALL) m
   ON m.session_id = s.session_id AND s.stream = 'sidechain:' || m.agent_id) c ON c.session_id = t.session_id AND c.t = t.turn_index WHERE t.stream = 'main' GROUP BY ALL"""))
def children_by_turn(a: Assembled):
    return Q.children_by_turn(a)


@query(O.on_events("""SELECT c.event_id AS child_id, c.ms AS start_ms, arg_min(p.session_id, {'d': abs(c.ms - p.ms), 'p': p.session_id, 's': p.ms}) AS parent_id, arg_min(p.ms, {'d': abs(c.ms - p.ms), 'p': p.session_id, 's': p.ms}) AS spawn_ms
  FROM (SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM ev WHERE type = 'slash_command') c
  LEFT JOIN (SELECT session_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM ev WHERE type = 'tool_call') p ON abs(c.ms - p.ms) <= 30000 GROUP BY ALL"""), on="events")
def join_spawn_interval(e: DataFrame):
    kids = e.where("type = 'slash_command'").select(F.col("event_id").alias("child_id"), ms("ts").alias("start_ms"))
    spawns = e.where("type = 'tool_call'").select(F.col("session_id").alias("parent_id"), ms("ts").alias("spawn_ms"))
    return Q.near_spawn(kids, spawns, 30_000)


@query(O.on_events("""SELECT c.event_id AS child_id, c.ms AS start_ms, arg_min(p.session_id, {'d': abs(c.ms - p.ms), 'p': p.session_id, 's': p.ms}) AS parent_id, arg_min(p.ms, {'d': abs(c.ms - p.ms), 'p': p.session_id, 's': p.ms}) AS spawn_ms
  FROM (SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM ev WHERE type = 'user') c
  LEFT JOIN (SELECT session_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) + seq % 250 AS ms FROM ev WHERE type = 'user') p ON abs(c.ms - p.ms) <= 100 GROUP BY ALL"""), on="events")
def join_codex_spawn(e: DataFrame):
    kids = e.where("type = 'user'").select(F.col("event_id").alias("child_id"), ms("ts").alias("start_ms"))
    spawns = e.where("type = 'user'").select(F.col("session_id").alias("parent_id"), (ms("ts") + F.col("seq") % 250).alias("spawn_ms"))
    return Q.near_spawn(kids, spawns)


@query(O.on_events("SELECT DISTINCT session_id FROM ev WHERE starts_with(session_id, 's1')" + " AND (session_id = 's1' OR NOT EXISTS (SELECT 1 FROM ev x WHERE x.session_id = 's1'))"), on="events")
def resolve_prefix(e: DataFrame):
    return Q.with_prefix(e, "s1")


# --- selection --------------------------------------------------------------------------------------------------

POOL = """pool AS (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY start_time DESC, session_id) + 1 AS boost FROM
  (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY start_time DESC, session_id) AS pr FROM (SELECT * FROM sessions WHERE stream = 'main' ORDER BY start_time DESC, session_id LIMIT 1000)) WHERE pr <= 200),
dg AS (SELECT p.provider, p.session_id, p.boost, sm.tool_calls_total, tool_failures_total, missing_tool_pairs, longest_chain, max_e2e_ms, loop_signals, max_tool_ms,
   (SELECT arg_min(user_text, turn_index) FROM turns t WHERE t.session_id = p.session_id AND t.stream = 'main') AS opening,
   (SELECT CASE WHEN max(tool_count) >= 3 THEN arg_max(user_text, {'c': tool_count, 'i': turn_index}) END FROM turns t WHERE t.session_id = p.session_id AND t.stream = 'main') AS activation
  FROM pool p JOIN sm ON sm.session_id = p.session_id AND sm.stream = 'main')"""
P90 = """th AS (SELECT list_sort(list(max_e2e_ms))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1] AS p90_e2e_ms, list_sort(list(max_tool_ms))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1] AS p90_tool_ms,
  list_sort(list(tool_calls_total))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1] AS p90_tool_calls FROM dg)"""
PICK = """l1 AS (SELECT session_id, 0 AS lens_order, 'Failures' AS lens, 'Failures (fails=' || tool_failures_total || ' missing=' || missing_tool_pairs || ')' AS reason, tool_failures_total * 100 + missing_tool_pairs * 50 + boost AS score FROM dg WHERE tool_failures_total > 0 OR missing_tool_pairs > 0 ORDER BY score DESC, boost DESC LIMIT 5),
l2 AS (SELECT session_id, 1 AS lens_order, 'Loops' AS lens, 'Loops (loop_signals=' || loop_signals || ')' AS reason, loop_signals * 100 + boost AS score FROM dg WHERE loop_signals > 0 AND session_id NOT IN (SELECT session_id FROM l1) ORDER BY score DESC, boost DESC LIMIT 5),
l3 AS (SELECT session_id, 2 AS lens_order, 'Bottlenecks' AS lens, 'Bottlenecks (max_tool=' || printf('%.1fs', max_tool_ms / 1000.0) || ' max_e2e=' || printf('%.1fs', max_e2e_ms / 1000.0) || ')' AS reason, max_tool_ms + max_e2e_ms AS score FROM dg, th WHERE (max_e2e_ms > p90_e2e_ms OR max_tool_ms > p90_tool_ms)
  AND session_id NOT IN (SELECT session_id FROM l1 UNION ALL SELECT session_id FROM l2) ORDER BY score DESC, boost DESC LIMIT 5),
l4 AS (SELECT session_id, 3 AS lens_order, 'Toolchains' AS lens, 'Toolchains (tool_calls=' || tool_calls_total || ' longest_chain=' || longest_chain || ')' AS reason, tool_calls_total * 10 + boost AS score FROM dg, th WHERE tool_calls_total > greatest(p90_tool_calls, 5)
  AND session_id NOT IN (SELECT session_id FROM l1 UNION ALL SELECT session_id FROM l2 UNION ALL SELECT session_id FROM l3) ORDER BY score DESC, boost DESC LIMIT 5),
chosen AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4),
filler AS (SELECT session_id, 4 AS lens_order, 'Activity' AS lens, 'Activity (filler)' AS reason, tool_calls_total AS score FROM dg WHERE session_id NOT IN (SELECT session_id FROM chosen) QUALIFY row_number() OVER (ORDER BY tool_calls_total DESC, boost DESC) <= 20 - (SELECT count(*) FROM chosen))"""


@query(O.on_tables("SELECT provider, session_id, boost FROM pool", METRICS, POOL))
def balance_providers(a: Assembled):
    return S.balance_providers(a.sessions).select("provider", "session_id", "boost")


@query(O.on_tables("SELECT session_id, opening, activation, tool_calls_total FROM dg", METRICS, POOL))
def digest(a: Assembled):
    return S.digests(a).select("session_id", "opening", "activation", "tool_calls_total")


@query(O.on_tables("SELECT * FROM th", METRICS, POOL, P90))
def p90_thresholds(a: Assembled):
    return S.p90_thresholds(S.digests(a))


@query(O.on_tables("SELECT * FROM chosen UNION ALL SELECT * FROM filler", METRICS, POOL, P90, PICK))
def lens_select(a: Assembled):
    return S.lens_select(S.digests(a))


@query(O.on_tables("SELECT lens, count(*) AS sessions, max(score) AS top FROM (SELECT * FROM chosen UNION ALL SELECT * FROM filler) GROUP BY lens", METRICS, POOL, P90, PICK))
def pack(a: Assembled):
    return S.lens_select(S.digests(a)).groupBy("lens").agg(F.count(F.lit(1)).alias("sessions"), F.max("score").alias("top"))


# --- scalar functions over the tables' texts ----------------------------------------------------------------------

@on_documents("truncate_marked", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...(truncated)' ELSE text END AS t FROM documents")
def _truncate_marked(d):
    return d.select("doc_id", X.truncate_marked(F.col("text"), 100).alias("t"))


@on_documents("truncate_snippet", "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS t FROM documents")
def _truncate_snippet(d):
    return d.select("doc_id", X.truncate_snippet(F.col("text"), 50).alias("t"))


@on_documents("truncate_ellipsis", "SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 37) || '...' END AS t FROM documents")
def _truncate_ellipsis(d):
    return d.select("doc_id", X.truncate_ellipsis(F.col("text"), 40).alias("t"))


@on_documents("truncate_bytes_check", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 200 THEN left(text, 200) || '...' ELSE text END AS t FROM documents")
def _truncate_by_bytes(d):
    return d.select("doc_id", X.truncate_by_bytes(F.col("text"), 200).alias("t"))


@on_documents("session_uuid", r"""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('doc' || doc_id)) AS h FROM documents)
  SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""")
def _session_uuid(d):
    return d.select("doc_id", X.session_uuid(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("id"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversations table, read as agent sessions."""
    c = conversation_events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    order = W.partitionBy("session_id").orderBy("seq")
    turn = F.sum((F.col("type") == "user").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return c.withColumn("turn_index", turn - 1).where("turn_index >= 0").groupBy("session_id", "turn_index").agg(
        F.count_if(F.col("type") == "message").alias("messages"), F.sum(F.length("text")).alias("chars"))


QUERIES["conversation_turns"] = conversation_turns
ORACLE["conversation_turns"] = """SELECT session_id, turn_index, count(*) FILTER (role = 'assistant') AS messages, sum(length(text))::BIGINT AS chars FROM
 (SELECT 'c' || conv_id AS session_id, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT - 1 AS turn_index FROM conversations) WHERE turn_index >= 0 GROUP BY ALL"""


# --- streams, drained -----------------------------------------------------------------------------------------------

def _raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of simple agent events; its place is its id."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "user", "view", "message", "click", "tool_call", "error", "tool_result", "purchase", "token_usage")]), F.col("event_type"))
    return raw.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"),
                      F.lit("main").alias("stream"), F.lit("p").alias("provider"), F.col("_metadata.file_path").alias("chunk"), F.col("_metadata.file_modification_time").alias("chunk_time"), k.alias("tok_uncached"), (k * 10).alias("tok_cached"), k.alias("tok_generated"),
                      F.lit(None).cast("string").alias("model"), (k % 3 == 0).alias("is_error"))


def _streamed(name: str, f, mode: str, sql: str, select) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(live.drain(f(_raw_stream(spark, sf_dir)), mode))
    QUERIES[name] = run
    ORACLE[name] = sql


_streamed("live_state", live.live_state, "complete", """SELECT 's' || user_id AS session_id, CAST(floor(epoch_us(max(ts)) / 1000) AS BIGINT) AS last_ms, count(*) AS event_count, count(*) FILTER (event_type = 'signup') AS turn_count,
  arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) FILTER (event_type = 'purchase') AS fresh_input FROM events GROUP BY user_id""",
          lambda d: d.select("session_id", ms("last_activity").alias("last_ms"), "event_count", "turn_count", "fresh_input"))
_streamed("watch_session", lambda e: live.live_state(live.watch(e, provider="p", session="s1")), "complete", """SELECT 's' || user_id AS session_id, count(*) AS event_count FROM events WHERE CAST(user_id AS VARCHAR) LIKE '1%' GROUP BY user_id""",
          lambda d: d.select("session_id", "event_count"))


# --- further joins and views over the assembled tables ---------------------------------------------------------------

@query(O.on_tables("""SELECT s.session_id, s.stream, row_number() OVER (PARTITION BY s.session_id ORDER BY m.t NULLS LAST, m.p NULLS LAST, s.stream) AS place FROM sessions s LEFT JOIN
  (SELECT session_id, agent_id, arg_max(turn_index, seq) AS t, arg_max(step_index, seq) AS p FROM r WHERE stream = 'main' AND type = 'tool_result' AND agent_id IS NOT NULL GROUP BY ALL) m
  ON m.session_id = s.session_id AND s.stream = 'sidechain:' || m.agent_id WHERE starts_with(s.stream, 'sidechain:')"""))
def children_of(a: Assembled):
    return Q.streams_by_spawn(a)


_TOLD = """told AS (SELECT session_id, stream, arg_max(tok_cached * 100 + 1, seq) AS told FROM ev WHERE type = 'token_usage' AND provider = 'codex' GROUP BY ALL),
db AS (SELECT cr.session_id, used, coalesce(told, effective) AS lim, CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / 1000) AS BIGINT) AS elapsed_ms
  FROM cr JOIN sessions USING (session_id, stream) LEFT JOIN told USING (session_id, stream))"""


@query(O.on_tables("""SELECT session_id, elapsed_ms, used, lim AS "limit", used / lim::DOUBLE AS ratio, coalesce(used / lim::DOUBLE >= 1, false) AS exceeded,
  CASE WHEN used / lim::DOUBLE > 0.9 THEN 'error' WHEN used / lim::DOUBLE > 0.8 THEN 'warning' ELSE 'success' END AS level FROM db""", TM, LIMITS, MODEL, USAGE, _TOLD), on="events")
def dashboard(e: DataFrame):
    told = F.when((F.col("type") == "token_usage") & (F.col("provider") == "codex"), F.col("tok_cached") * 100 + 1)
    return A.dashboard(assemble(e.withColumn("context_limit", told)))


@query(O.on_tables("""SELECT session_id, stream, model, lim::BIGINT AS max_tokens, i::DOUBLE * 100 / lim AS input_pct, o::DOUBLE * 100 / lim AS output_pct, (i + o)::DOUBLE * 100 / lim AS total_pct FROM (SELECT u.*, model, coalesce(told, max_tokens) AS lim FROM
  (SELECT session_id, stream, arg_max(fresh_input + cache_read, {'t': turn_index, 's': step_index}) AS i, arg_max(output, {'t': turn_index, 's': step_index}) AS o FROM steps WHERE stream = 'main' AND usages > 0 GROUP BY ALL) u
  JOIN (SELECT session_id, stream, arg_max(model, seq) AS model FROM ev GROUP BY ALL) m USING (session_id, stream) LEFT JOIN ml USING (model) LEFT JOIN told USING (session_id, stream))""", LIMITS, MODEL, _TOLD.split(",\ndb AS")[0]), on="events")
def usage_percent(e: DataFrame):
    told = F.when((F.col("type") == "token_usage") & (F.col("provider") == "codex"), F.col("tok_cached") * 100 + 1)
    return A.usage_percent(assemble(e.withColumn("context_limit", told)))


@query(O.on_events("SELECT prefix, max_tokens, greatest(1, CAST(floor(max_tokens * (100 - buffer_pct) / 100) AS BIGINT)) AS effective, count(ev.event_id) AS events FROM lim LEFT JOIN ev ON starts_with(ev.model, prefix) GROUP BY ALL", LIMITS), on="events")
def effective_limit(e: DataFrame):
    models = e.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    lim = T.model_limits(e.sparkSession)
    met = F.broadcast(lim).join(models, F.col("model").startswith(F.col("prefix")))
    n = met.groupBy("prefix").agg(F.sum("n").alias("events"))
    return lim.join(n, "prefix", "left").select("prefix", "max_tokens", T.effective_limit(F.col("max_tokens"), F.col("buffer_pct")).alias("effective"), F.coalesce("events", F.lit(0)).alias("events"))


@query(O.on_events("""SELECT c.event_id, arg_max(x.output, x.seq) AS sample FROM ev c LEFT JOIN ev x ON x.type = 'tool_result' AND x.session_id = c.session_id AND x.tool_call_id = c.event_id WHERE c.type = 'tool_call' GROUP BY c.event_id"""), on="events")
def join_call_sample(e: DataFrame):
    return Q.join_call_sample(e).select("event_id", "sample")


@query(O.on_events("SELECT event_id, type FROM ev WHERE type = 'reasoning'"), on="events")
def filter_event_type(e: DataFrame):
    return Q.filter_event_type(e, "Reasoning").select("event_id", "type")


@query(O.on_events("""SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || type || chr(10) || CASE type WHEN 'tool_call' THEN concat_ws(' ', tool_name, file_path, command, pattern) WHEN 'tool_result' THEN output
  WHEN 'token_usage' THEN 'in ' || (tok_cached + tok_uncached) || ' out ' || tok_generated WHEN 'slash_command' THEN slash_name ELSE coalesce(text, '') END || chr(10) AS value FROM ev"""), on="events")
def sink_text(e: DataFrame):
    return Q.as_text(e, "event_id")
