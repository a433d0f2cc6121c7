"""Raw logs to events, on literal lines of each format."""

import json
import os

from sessionloom.sources import catalog, ingest

def test_lines_of_the_first_format(spark, tmp_path):
    def rec(**k):
        return json.dumps({"sessionId": "s", "timestamp": "2025-01-01T00:00:00Z", "isSidechain": False, **k})

    path = os.path.join(tmp_path, "a.jsonl")
    with open(path, "w") as f:
        f.write("\n".join([
            rec(type="user", uuid="u1", message={"role": "user", "content": "hello"}), "", "{broken",
            rec(type="user", uuid="u2", message={"role": "user", "content": "<command-name>/go</command-name><command-args>x y</command-args>"}),
            rec(type="assistant", uuid="a1", message={"role": "assistant", "model": "m", "content": [{"type": "thinking", "thinking": "hm"}], "usage": {"input_tokens": 1, "output_tokens": 2}}),
            rec(type="assistant", uuid="a2", message={"role": "assistant", "model": "m", "usage": {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 5},
                                                     "content": [{"type": "tool_use", "id": "t1", "name": "mcp__db__run", "input": {"q": 1}}]}),
            rec(type="user", uuid="u3", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "ok", "is_error": True},
                                                                         {"type": "tool_result", "tool_use_id": "t9", "content": "lost"}]}),
            rec(type="system", uuid="y1", subtype="compact_boundary", compactMetadata={"trigger": "auto", "preTokens": 7}),
            rec(type="system", uuid="y2", subtype="local_command", content="/model big one"), rec(type="pr-link", prNumber=3, prUrl="http://x", prRepository="r"),
            rec(type="queue-operation", operation="enqueue", content="c"), rec(type="user", uuid="u4", isSidechain=True, agentId="ag", message={"role": "user", "content": "side"})]))
    lines = ingest.read_lines(spark, path)
    assert ingest.bad_lines(lines).count() == 1
    rows = ingest.claude_events(lines).orderBy("line_no", "seq").collect()
    assert [(r.type, r.text or r.slash_name or r.output or r.queue_op) for r in rows] == [
        ("user", "hello"), ("slash_command", "/go"), ("reasoning", "hm"), ("tool_call", None), ("token_usage", None), ("tool_result", "ok"),
        ("notification", "Context compaction (trigger: auto, pre_tokens: 7)"), ("slash_command", "/model"), ("notification", "PR #3 linked: http://x"), ("queue_operation", "enqueue"), ("user", "side")]
    call, result = rows[3], rows[5]
    assert result.tool_call_id == call.event_id and result.is_error and (call.mcp_server, call.mcp_tool, call.tool_variant) == ("db", "run", "Mcp")
    assert (rows[4].tok_cached, rows[4].tok_uncached, rows[4].tok_generated) == (5, 3, 4)
    assert rows[-1].stream == "sidechain:ag" and rows[-1].parent_id is None


def test_lines_of_the_second_format(spark, tmp_path):
    def rec(kind, **payload):
        return json.dumps({"timestamp": "2025-01-01T00:00:00Z", "type": kind, "payload": payload})

    def usage(i, c, o):
        return rec("event_msg", type="token_count", info={"last_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": 1, "total_tokens": i + o}})

    path = os.path.join(tmp_path, "rollout-x.jsonl")
    with open(path, "w") as f:
        f.write("\n".join([
            rec("session_meta", id="sid", source={"subagent": "review"}), rec("turn_context", model="gpt-5"),
            rec("response_item", type="message", role="user", content=[{"type": "input_text", "text": "a"}, {"type": "input_text", "text": "b"}]),
            rec("event_msg", type="user_message", message="a"), rec("response_item", type="reasoning", summary=[{"type": "summary_text", "text": "why"}]),
            rec("response_item", type="function_call", name="shell", arguments=json.dumps({"command": ["bash", "-lc", "cat x"]}), call_id="c1"),
            rec("response_item", type="function_call_output", call_id="c1", output="Exit code: 2\nno"), usage(10, 4, 3), usage(10, 4, 3), rec("event_msg", type="token_count", info=None), usage(11, 4, 3),
            rec("response_item", type="custom_tool_call", name="apply_patch", input="*** Begin Patch\n*** Update File: a.py\n+x", call_id="c2", status="ok")]))
    rows = ingest.codex_events(ingest.read_lines(spark, path)).orderBy("line_no").collect()
    assert [r.type for r in rows] == ["user", "reasoning", "tool_call", "tool_result", "token_usage", "token_usage", "tool_call"]
    assert rows[0].text == "a\nb" and rows[1].text == "why" and rows[2].tool_variant == "FileRead" and rows[2].model == "gpt-5" and rows[3].is_error
    assert (rows[4].tok_uncached, rows[4].tok_cached, rows[4].tok_reasoning) == (6, 4, 1) and rows[6].tool_variant == "FileEdit" and rows[6].file_path == "a.py"
    assert {r.stream for r in rows} == {"subagent:review"} and {r.raw_session_id for r in rows} == {"sid"}


def test_documents_of_the_third_format(spark, tmp_path):
    path = os.path.join(tmp_path, "session-1.json")
    t = "2025-01-01T00:00:00Z"
    with open(path, "w") as f:
        json.dump({"sessionId": "g", "messages": [
            {"type": "user", "id": "u", "timestamp": t, "content": "hi"}, {"type": "user", "id": "7", "timestamp": t, "content": "skipped"},
            {"type": "info", "id": "i", "timestamp": t, "content": "note"},
            {"type": "gemini", "id": "m", "timestamp": t, "content": "", "model": "gemini-2.5-pro", "thoughts": [{"subject": "s", "description": "d"}],
             "toolCalls": [{"id": "t1", "name": "read_file", "args": {"file_path": "f"}, "result": [{"x": 1}], "status": "error", "resultDisplay": "bad"},
                           {"id": "t2", "name": "q", "displayName": "q (srv MCP Server)", "args": {}, "result": []}],
             "tokens": {"input": 5, "output": 2, "cached": 1, "thoughts": 1, "tool": 0, "total": 8}}]}, f)
    with open(os.path.join(tmp_path, "session-2.json"), "w") as f:
        json.dump([{"sessionId": "old", "messageId": 1, "type": "user", "message": "m", "timestamp": t}], f)
    rows = ingest.gemini_events(ingest.read_documents(spark, str(tmp_path))).orderBy("seq").collect()
    assert [r.type for r in rows] == ["user", "notification", "reasoning", "tool_call", "tool_result", "tool_call", "message", "token_usage"]
    assert rows[4].output == "bad" and rows[4].is_error and rows[5].mcp_server == "srv" and rows[3].tool_variant == "FileRead"
    assert [rows[k].parent_id for k in range(1, 8)] == [rows[k].event_id for k in range(7)]


def test_catalog(spark, tmp_path):
    folder = os.path.join(tmp_path, ".claude", "projects", "p")
    os.makedirs(folder)
    for name, text in (("a.jsonl", '{"type":"user","uuid":"u","sessionId":"s1","cwd":"/w","timestamp":"2025-01-01T00:00:00Z","message":{"content":"first"}}\n'),
                       ("b.jsonl", '{"type":"user","uuid":"v","sessionId":"s1","isSidechain":true,"agentId":"x","timestamp":"2025-01-01T00:01:00Z","message":{"content":"side"}}\n{bad\n'),
                       ("c.jsonl", "")):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    files = catalog.list_files(spark, os.path.join(tmp_path, ".claude", "projects"))
    assert {os.path.basename(r.path): r.provider for r in catalog.probe(files).collect()} == {"a.jsonl": "claude_code", "b.jsonl": "claude_code"}
    lines = ingest.read_lines(spark, os.path.join(folder, "a.jsonl"), os.path.join(folder, "b.jsonl"))
    heads = {r.is_sidechain: r for r in catalog.claude_headers(lines).collect()}
    assert heads[False].snippet == "first" and heads[False].cwd == "/w" and heads[True].session_id == "s1"
    known = catalog.probe(files).where("path like '%a.jsonl'")
    assert [os.path.basename(r.path) for r in catalog.changed(catalog.probe(files), known).collect()] == ["b.jsonl"]
    assert {r.status: r.files for r in catalog.diagnose(lines).groupBy("status").agg({"path": "count"}).withColumnRenamed("count(path)", "files").collect()} == {"ok": 1, "parse_error": 1}
    old = spark.createDataFrame([("s1", "h", None, "x", True), ("s2", "h", "2024", "y", True)], "id string, project_hash string, start_ts string, snippet string, is_valid boolean")
    new = spark.createDataFrame([("s1", "h2", "2025", None, False)], old.schema)
    made = {r.id: r for r in catalog.upsert(old, new, ["id"], keep=["start_ts", "snippet"]).collect()}
    assert (made["s1"].project_hash, made["s1"].start_ts, made["s1"].snippet, made["s1"].is_valid) == ("h2", "2025", "x", False) and made["s2"].start_ts == "2024"


def test_snippet_passes_over_all_descendants_of_meta(spark):
    def rec(**k):
        return json.dumps({"type": "user", "sessionId": "s", "timestamp": "2025-01-01T00:00:00Z", **k})

    lines = [rec(uuid="m", isMeta=True, message={"content": "meta"}), rec(uuid="c", parentUuid="m", message={"content": "child"}), rec(uuid="g", parentUuid="c", message={"content": "grandchild"}),
             rec(uuid="side", isSidechain=True, message={"content": "side"}), rec(uuid="ok", parentUuid="side", message={"content": "first of its own"})]
    new = [lines[0], json.dumps({"type": "file-history-snapshot"}), lines[1]]
    frame = spark.createDataFrame([("a", i, v) for i, v in enumerate(lines)] + [("b", i, v) for i, v in enumerate(new)], "path string, line_no long, value string")
    assert {r.path: r.snippet for r in catalog.claude_headers(frame).collect()} == {"a": "first of its own", "b": "child"}


def test_spawns_against_a_loop(spark):
    import random

    r, lines, want = random.Random(6), [], []
    for f in range(80):
        turn = step = 0
        inside = False
        for n in range(r.randint(1, 15)):
            kind = r.choice(["context", "user", "review", "other", "item", "meta"])
            record = {"context": "turn_context", "item": "response_item", "meta": "session_meta"}.get(kind, "event_msg")
            payload = {"type": {"user": "user_message", "review": "entered_review_mode"}.get(kind, "agent_message")}
            ts = f"2025-01-01T00:{f % 60:02}:{n:02}Z"
            lines.append((f"f{f}", n, json.dumps({"timestamp": ts, "type": record, "payload": payload})))
            if kind == "context":
                turn, step, inside = turn + inside, 0, True
            elif kind == "user":
                turn, step, inside = turn + inside, 0 if inside else step, True
            elif kind == "review":
                want.append((f"f{f}", turn, step))
                step += 1
            elif kind in ("other", "item") and inside:
                step += 1
    got = ingest.spawn_events(spark.createDataFrame(lines, "path string, line_no long, value string"))
    assert sorted((x.path, x.turn_index, x.step_index) for x in got.collect()) == sorted(want) and len(want) > 50


def test_from_a_folder_of_logs_to_sessions(spark, tmp_path):
    """Listing, headers, index, a session's events by its id, assembly, search, export and the way back."""
    from sessionloom.operators import query as Q
    from sessionloom.operators.assemble import assemble

    root = os.path.join(tmp_path, ".claude", "projects", "p")
    os.makedirs(root)

    def rec(kind, n, content, **k):
        return json.dumps({"type": kind, "uuid": f"u{n}", "sessionId": "s1", "cwd": "/w", "timestamp": f"2025-01-01T00:00:{n:02}Z", "message": {"content": content, "model": "m"}, **k})

    with open(os.path.join(root, "a.jsonl"), "w") as f:
        f.write("\n".join([rec("user", 1, "find the needle"), rec("assistant", 2, [{"type": "tool_use", "id": "t", "name": "Grep", "input": {"pattern": "needle"}}]),
                           rec("user", 3, [{"type": "tool_result", "tool_use_id": "t", "content": "found", "agentId": "x"}]), rec("assistant", 4, [{"type": "text", "text": "here it is"}])]))
    with open(os.path.join(root, "b.jsonl"), "w") as f:
        f.write(rec("user", 5, "side", isSidechain=True, agentId="x"))
    files = catalog.probe(catalog.list_files(spark, os.path.join(tmp_path, ".claude")))
    assert {r.confidence for r in files.collect()} == {1.0}
    lines = ingest.read_lines(spark, root)
    headers = catalog.header_columns(catalog.claude_headers(lines), "claude_code")
    paths = files.select("path").collect()
    index, counts = catalog.build_index(headers, files)
    assert counts.first() == (1, 2, 0) or len(paths) == 2
    index.write(str(tmp_path / "index"))
    index = catalog.Catalog.read(spark, str(tmp_path / "index"))
    again, counts = catalog.build_index(headers, files, old=index)
    assert tuple(counts.first()) == (0, 0, 2) and tuple(catalog.build_index(headers, files, old=index, force=True)[1].first()) == (1, 2, 0)
    assert catalog.cwd_of(lines).where("cwd = '/w'").count() == 2
    assert [r.role for r in catalog.find_session_files(index.log_files, "s1").collect()] == ["main", "sidechain"] and catalog.raw_files(spark, index.log_files, "s1").count() == 2
    events = catalog.load_session_events(spark, index, "s1")
    assert [r.type for r in events.orderBy("seq").collect()] == ["user", "tool_call", "tool_result", "message", "user"]
    a = assemble(events)
    found = Q.search_events(a, "needle", session=events.first().session_id).collect()
    assert {r.type for r in found} == {"user", "tool_call"}
    assert a.tools.first().tool_kind == "search" and a.tools.first().pattern == "needle"
    assert Q.session_view(a).count() == a.steps.count() == 1
    Q.export_session(events, str(tmp_path / "out"))
    back = ingest.scan_agent_events(spark, str(tmp_path / "out"))
    assert sorted(r.event_id for r in back.collect()) == sorted(r.event_id for r in events.collect())
    import pytest
    with pytest.raises(ValueError):
        ingest.parse_auto(spark, ["/nowhere/x.jsonl"])
    with pytest.raises(KeyError):
        catalog.load_session_events(spark, index, "none")
    assert ingest.normalize_all(spark).count() == 0


def test_empty_sessions_of_the_second_format(spark):
    rows = [("a", 0, "{}"), ("a", 1, '{"type":"x"}'), ("b", 0, '{"type":"session_meta"}'), ("c", 0, "{"), ("c", 1, "{"), ("c", 2, "{")]
    lines = spark.createDataFrame(rows, "path string, line_no long, value string")
    assert [r.path for r in catalog.empty_sessions(lines).collect()] == ["a"]


def test_headers_of_the_second_and_third_format(spark):
    def rec(kind, **payload):
        return json.dumps({"timestamp": "2025-01-01T00:00:00Z", "type": kind, "payload": payload})

    def said(text):
        return rec("response_item", type="message", role="user", content=[{"type": "input_text", "text": text}])

    lines = [rec("session_meta", id="sid", cwd="/w", source={"subagent": "review"}), said("<environment_context>x</environment_context>"), said("y" * 300), said("later")]
    frame = spark.createDataFrame([("a", i, v) for i, v in enumerate(lines)] + [("b", i, rec("event_msg", type="x")) for i in range(20)] + [("b", 20, said("too late"))], "path string, line_no long, value string")
    rows = {r.path: r for r in catalog.codex_headers(frame).collect()}
    assert (rows["a"].session_id, rows["a"].cwd, rows["a"].snippet, rows["a"].subagent) == ("sid", "/w", "y" * 200, "review") and rows["b"].snippet is None
    new = json.dumps({"sessionId": "g", "projectHash": "h", "startTime": "t0", "messages": [{"type": "info", "content": "no"}, {"type": "user", "content": "first"}]})
    old = json.dumps([{"sessionId": "old", "messageId": 0, "type": "user", "message": "said", "timestamp": "t1"}])
    docs = spark.createDataFrame([("new", new), ("old", old), ("bad", "{")], "path string, value string")
    heads = {r.path: r for r in catalog.gemini_headers(docs).collect()}
    assert (heads["new"].session_id, heads["new"].start_ts, heads["new"].snippet, heads["new"].stored_hash) == ("g", "t0", "first", "h")
    assert (heads["old"].session_id, heads["old"].start_ts, heads["old"].snippet) == ("old", "t1", "said") and heads["bad"].session_id is None
    made, _ = catalog.build_index(catalog.header_columns(catalog.gemini_headers(docs), "gemini"), docs.selectExpr("path", "length(value) as length", "timestamp'2025-01-01' as modificationTime"))
    assert {r.id: r.project_hash for r in made.sessions.collect()}["g"] == "h" and len({r.project_hash for r in made.sessions.collect()}) == 2
