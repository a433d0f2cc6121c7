"""DuckDB SQL for the queries: shared table expressions and one statement a query."""

from __future__ import annotations

EV = r"""
e0 AS (SELECT event_id AS eid, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         row_number() OVER w AS seq,
         last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS call
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e1 AS (SELECT *, CASE WHEN event_type = 'signup' AND k % 10 = 0 THEN 'slash_command' WHEN event_type = 'signup' THEN 'user'
         WHEN event_type = 'view' AND k < 50 THEN 'reasoning' WHEN event_type = 'view' THEN 'message' WHEN event_type = 'click' THEN 'tool_call'
         WHEN event_type = 'error' THEN 'tool_result' ELSE 'token_usage' END AS type FROM e0 WHERE event_type <> 'error' OR call IS NOT NULL),
e2 AS (SELECT *, ['claude_code', 'codex', 'gemini'][user_id % 3 + 1] AS provider, 's' || user_id AS session_id, CAST(eid AS VARCHAR) AS event_id,
         CASE WHEN k % 11 = 7 THEN 'sidechain:a' || (k % 3) ELSE 'main' END AS stream,
         CASE WHEN type = 'user' AND k % 10 = 1 THEN '[Request interrupted by user]' WHEN type = 'user' AND k % 10 = 2 THEN 'This session is being continued ' || eid
              WHEN type = 'user' THEN 'ask ' || eid WHEN type = 'message' THEN CASE WHEN k % 9 = 4 THEN 'Sorry, ' ELSE '' END || 'message ' || k
              WHEN type = 'reasoning' THEN 'reasoning ' || k END AS text,
         CASE WHEN type = 'slash_command' THEN '/commit' END AS slash_name,
         CASE WHEN type = 'tool_call' THEN ['Read', 'Edit', 'Bash', 'Grep', 'Glob', 'mcp__db__query'][k % 6 + 1] END AS tool_name FROM e1),
ev AS (SELECT *, CASE WHEN tool_name IN ('Read', 'Edit') THEN '/src/f' || (k % 20) || '.rs' END AS file_path,
         CASE WHEN tool_name = 'Bash' THEN ['cargo build', 'cargo test --all', 'git status', 'ls -la src', 'cat a.txt', 'echo x > f.txt'][(k // 6) % 6 + 1] END AS command,
         CASE WHEN tool_name = 'Grep' THEN 'p' || k WHEN tool_name = 'Glob' THEN '**/*.rs' END AS pattern,
         CASE WHEN starts_with(tool_name, 'mcp__') THEN 'db' END AS mcp_server, CASE WHEN starts_with(tool_name, 'mcp__') THEN 'query' END AS mcp_tool,
         CASE WHEN type = 'tool_result' THEN CAST(call AS VARCHAR) END AS tool_call_id, CASE WHEN type = 'tool_result' THEN 'out ' || k END AS output,
         CASE WHEN type = 'tool_result' THEN k % 3 = 0 END AS is_error, CASE WHEN type = 'tool_result' AND k % 4 = 1 THEN 'a' || (k % 3) END AS agent_id,
         CASE WHEN type = 'token_usage' THEN k * 10 END AS tok_cached, CASE WHEN type = 'token_usage' THEN CAST(floor(value * 10) AS BIGINT) END AS tok_uncached,
         CASE WHEN type = 'token_usage' THEN CAST(floor(value) AS BIGINT) END AS tok_generated,
         ['claude-sonnet-4-5-x', 'claude-3-5-haiku', 'other-model', 'gpt-5.1-codex-max', 'gpt-5', 'gpt-4o', 'gemini-2.5-flash-lite', 'gemini-2.0-flash', 'gemini-1.5-pro'][(user_id % 3) * 3 + (user_id // 3) % 3 + 1] AS model,
         '{"type":"' || type || '","content":' || CASE type
           WHEN 'tool_call' THEN '{"name":"' || tool_name || '","arg":"' || coalesce(file_path, command, pattern, '') || '"}'
           WHEN 'tool_result' THEN '{"output":"' || output || '","is_error":' || is_error || '}'
           WHEN 'token_usage' THEN '{"cached":' || tok_cached || '}' WHEN 'slash_command' THEN '{"name":"/commit"}'
           ELSE '{"text":"' || text || '"}' END || '}' AS payload_json FROM e2)"""

ROWS = r"""
a0 AS (SELECT *, CASE WHEN type = 'slash_command' THEN 'S' WHEN type = 'user' AND starts_with(text, '[Request interrupted') THEN 'I' WHEN type = 'user' THEN 'U' END AS ctl,
         CAST(type IN ('reasoning', 'message', 'tool_call', 'token_usage') AS INT) AS content FROM ev),
a1 AS (SELECT *, sum(content) OVER (PARTITION BY session_id, stream ORDER BY seq) AS cc,
         last_value(ctl IGNORE NULLS) OVER (PARTITION BY session_id, stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pctl FROM a0),
a2 AS (SELECT *, last_value(CASE WHEN ctl = 'S' THEN cc END IGNORE NULLS) OVER (PARTITION BY session_id, stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ccs FROM a1),
a3 AS (SELECT *, coalesce(ctl = 'S' OR (ctl = 'U' AND NOT (coalesce(pctl, '') = 'S' AND cc = ccs)), false) AS opens FROM a2),
a4 AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY session_id, stream ORDER BY seq) AS tk,
         last_value(CASE WHEN ctl = 'I' THEN 'I' WHEN opens THEN 'T' END IGNORE NULLS) OVER (PARTITION BY session_id, stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM a3),
a5 AS (SELECT *, sum(content) OVER (PARTITION BY session_id, stream, tk) AS filled FROM a4 WHERE state = 'T'),
a6 AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY session_id, stream ORDER BY tk) - 1 AS INT) AS turn_index,
         min(CASE WHEN opens THEN ts END) OVER (PARTITION BY session_id, stream, tk) AS turn_ts, type IN ('reasoning', 'message') AS says FROM a5 WHERE filled > 0),
a7 AS (SELECT *, CAST(coalesce(lag(type) OVER w = type, true) AS INT) AS brk, row_number() OVER w AS nth FROM a6 WINDOW w AS (PARTITION BY session_id, stream, tk, says ORDER BY seq)),
a8 AS (SELECT *, sum(brk) OVER (PARTITION BY session_id, stream, tk, says ORDER BY seq) AS run FROM a7),
a9 AS (SELECT *, CAST(says AND (row_number() OVER (PARTITION BY session_id, stream, tk, says, run ORDER BY seq) - 1) % 2 = 0 AND nth > 1 AS INT) AS new_step FROM a8),
r AS (SELECT *, CAST(sum(new_step) OVER (PARTITION BY session_id, stream, tk ORDER BY seq) AS INT) AS step_index FROM a9)"""

TABLES = r"""
calls AS (SELECT *, row_number() OVER (PARTITION BY session_id, stream, turn_index, step_index, event_id ORDER BY seq) AS again FROM r WHERE type = 'tool_call'),
answers AS (SELECT x.session_id, x.stream, x.seq, any_value(x.event_id) AS event_id, any_value(x.output) AS output, any_value(x.ts) AS ts, any_value(x.is_error) AS is_error, max(c.seq) AS call_seq
            FROM r x JOIN calls c ON c.again = 1 AND x.session_id = c.session_id AND x.stream = c.stream AND x.turn_index = c.turn_index AND x.tool_call_id = c.event_id AND x.seq > c.seq
            WHERE x.type = 'tool_result' GROUP BY x.session_id, x.stream, x.seq),
paired AS (SELECT c.provider, c.session_id, c.stream, c.turn_index, c.step_index, c.event_id AS call_id, c.ts AS call_ts, c.seq AS call_seq, c.tool_name, c.file_path, c.command, c.pattern,
             c.mcp_server, c.mcp_tool, arg_min(x.event_id, x.seq) AS result_id, arg_min(x.output, x.seq) AS output, arg_min(x.ts, x.seq) AS result_ts, coalesce(arg_min(x.is_error, x.seq), false) AS is_error
           FROM calls c LEFT JOIN answers x ON x.session_id = c.session_id AND x.stream = c.stream AND x.call_seq = c.seq WHERE c.again = 1 GROUP BY ALL),
tools AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, stream, turn_index, step_index ORDER BY call_seq) - 1 AS INT) AS call_index,
            CASE WHEN tool_name IN ('Read', 'Glob') THEN 'read' WHEN tool_name IN ('Edit', 'Write') THEN 'write' WHEN tool_name IN ('Bash', 'KillShell', 'BashOutput') THEN 'execute'
                 WHEN tool_name IN ('Grep', 'WebSearch', 'WebFetch') THEN 'search' ELSE 'other' END AS tool_kind,
            CAST(floor((epoch_us(result_ts) - epoch_us(call_ts)) / 1000) AS BIGINT) AS duration_ms FROM paired),
per_step AS (SELECT session_id, stream, turn_index, step_index, count(*) AS tool_count, count(*) FILTER (result_id IS NULL) AS missing, count(*) FILTER (is_error) AS failed FROM tools GROUP BY ALL),
s0 AS (SELECT provider, session_id, stream, turn_index, step_index, min(turn_ts) AS turn_ts, min(ts) AS first_ts, max(CASE WHEN type = 'reasoning' THEN text END) AS reasoning,
         max(CASE WHEN type = 'message' THEN text END) AS message, count(*) FILTER (type = 'token_usage') AS usages, coalesce(max(tok_uncached), 0) AS fresh_input,
         coalesce(max(tok_cached), 0) AS cache_read, coalesce(max(tok_generated), 0) AS output FROM r GROUP BY ALL),
steps AS (SELECT s0.*, CASE WHEN step_index = 0 THEN turn_ts ELSE first_ts END AS step_ts, coalesce(tool_count, 0) AS tool_count, coalesce(missing, 0) AS missing, coalesce(failed, 0) AS failed,
            fresh_input + cache_read + output AS tokens,
            CASE WHEN coalesce(failed, 0) > 0 THEN 'failed' WHEN coalesce(missing, 0) > 0 THEN 'in_progress' WHEN coalesce(tool_count, 0) > 0 THEN 'done' WHEN message IS NOT NULL THEN 'done'
                 WHEN reasoning IS NOT NULL THEN 'in_progress' ELSE 'done' END AS status
          FROM s0 LEFT JOIN per_step USING (session_id, stream, turn_index, step_index)),
opened AS (SELECT session_id, stream, turn_index, max(CASE WHEN opens THEN event_id END) AS turn_id, max(CASE WHEN opens THEN slash_name END) AS slash_name,
             coalesce(max(CASE WHEN NOT opens THEN text END), max(CASE WHEN opens THEN text END), '') AS user_text FROM r WHERE opens OR type = 'user' GROUP BY ALL),
t0 AS (SELECT provider, session_id, stream, turn_index, min(turn_ts) AS turn_ts, count(*) AS step_count, sum(tokens)::BIGINT AS total_tokens, sum(tool_count)::BIGINT AS tool_count,
         sum(failed)::BIGINT AS failed, CAST(floor((epoch_us(max(step_ts)) - epoch_us(min(turn_ts))) / 1000) AS BIGINT) AS duration_ms,
         arg_max(tokens, step_index) FILTER (usages > 0) AS turn_end FROM steps GROUP BY ALL),
turns AS (SELECT t0.*, turn_id, slash_name, user_text, CASE WHEN starts_with(user_text, 'This session is being continued') THEN 'context_compaction' ELSE 'user' END AS origin
          FROM t0 JOIN opened USING (session_id, stream, turn_index)),
sessions AS (SELECT x.provider, x.session_id, x.stream, x.start_time, x.end_time, coalesce(total_turns, 0) AS total_turns, coalesce(total_tokens, 0) AS total_tokens,
               CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / 1000000) AS BIGINT) AS duration_seconds
             FROM (SELECT provider, session_id, stream, min(ts) AS start_time, max(ts) AS end_time FROM ev GROUP BY ALL) x
             LEFT JOIN (SELECT session_id, stream, count(*) AS total_turns, sum(total_tokens)::BIGINT AS total_tokens FROM turns GROUP BY ALL) y USING (session_id, stream))"""


def on_events(final: str, *more: str) -> str:
    return "WITH " + ",".join([EV, *more]) + "\n" + final


def on_tables(final: str, *more: str) -> str:
    return "WITH " + ",".join([EV, ROWS, TABLES, *more]) + "\n" + final
