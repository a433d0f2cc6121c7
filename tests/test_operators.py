"""Operators on small literal inputs, and the windows against a literal state machine."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.functions import tools as T
from sessionloom.operators import query as Q
from sessionloom.operators.assemble import assemble

SCHEMA = ("provider string, session_id string, event_id string, ts timestamp, stream string, seq long, type string, text string, slash_name string, "
          "tool_name string, file_path string, command string, pattern string, mcp_server string, mcp_tool string, tool_call_id string, output string, "
          "is_error boolean, agent_id string, tok_cached long, tok_uncached long, tok_generated long, tok_reasoning long, tok_tool long, model string, payload_json string")
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def event(**k):
    return tuple({"provider": "p", "stream": "main", **k}.get(n) for n in NAMES)


def random_sessions(seed: int, n: int):
    import datetime

    r, rows = random.Random(seed), []
    kinds = {"user": 6, "interrupt": 2, "slash_command": 3, "reasoning": 12, "message": 10, "tool_call": 14, "tool_result": 14, "token_usage": 10, "notification": 4}
    for s in range(n):
        calls, t = [], datetime.datetime(2024, 1, 1)
        for q in range(r.randint(1, 30)):
            kind = r.choices(list(kinds), kinds.values())[0]
            t += datetime.timedelta(milliseconds=r.randint(1, 5000))
            e = {"session_id": f"s{s}", "event_id": f"{s}-{q}", "ts": t, "seq": q, "type": kind}
            if kind == "interrupt":
                e |= {"type": "user", "text": "[Request interrupted by user]"}
            elif kind == "tool_result":
                if not calls:
                    continue
                e |= {"tool_call_id": r.choice(calls) if r.random() < 0.9 else "none", "is_error": r.random() < 0.3}
            elif kind == "tool_call":
                if calls and r.random() < 0.3:  # the same call again, in this step or a later one
                    e["event_id"] = r.choice(calls)
                calls.append(e["event_id"])
                e |= {"tool_name": "Read"}
            elif kind == "token_usage":
                e |= {"tok_cached": r.randint(0, 9), "tok_uncached": r.randint(0, 9), "tok_generated": r.randint(0, 9), "tok_reasoning": 0, "tok_tool": r.randint(0, 9)}
            elif kind in ("user", "reasoning", "message"):
                e |= {"text": f"{kind} {q}"}
            rows.append(e)
    return rows


def state_machine(rows):
    """(session, turn, step) -> status, tools, paired durations, tokens; one event after the other."""
    out = {}
    for s in dict.fromkeys(e["session_id"] for e in rows):
        turns, turn = [], None
        for e in (e for e in rows if e["session_id"] == s):
            kind, text = e["type"], e.get("text") or ""
            if kind == "user" and text.startswith("[Request interrupted"):
                turns, turn = turns + [turn], None
            elif kind == "user" and turn is not None and turn["slash"] and not turn["filled"] and not turn["content"]:
                turn["filled"] = True
            elif kind in ("user", "slash_command"):
                turns, turn = turns + [turn], {"slash": kind == "slash_command", "filled": False, "content": False, "steps": [{}], "pending": {}}
            elif turn is not None:
                if kind in ("reasoning", "message", "tool_call", "token_usage"):
                    turn["content"] = True
                if kind in ("reasoning", "message") and kind in turn["steps"][-1]:
                    turn["steps"].append({})
                step = turn["steps"][-1]
                if kind in ("reasoning", "message"):
                    step[kind] = text
                elif kind == "tool_call":
                    if e["event_id"] in step.setdefault("ids", set()):
                        continue
                    step["ids"].add(e["event_id"])
                    tool = {"ts": e["ts"], "ms": None, "error": False, "done": False}
                    step.setdefault("tools", []).append(tool)
                    turn["pending"][e["event_id"]] = tool
                elif kind == "tool_result" and (tool := turn["pending"].pop(e["tool_call_id"], None)):
                    tool |= {"ms": int((e["ts"] - tool["ts"]).total_seconds() * 1000 + 1e-6), "error": e["is_error"], "done": True}
                elif kind == "token_usage":
                    u = step.setdefault("usage", [0, 0, 0])
                    for k, v in enumerate((e["tok_uncached"], e["tok_cached"], e["tok_generated"] + e["tok_reasoning"] + e["tok_tool"])):
                        u[k] = max(u[k], v)
        kept = [t for t in turns + [turn] if t and t["content"]]
        for i, t in enumerate(kept):
            for j, step in enumerate(t["steps"]):
                tools = step.get("tools", [])
                status = ("failed" if any(x["error"] for x in tools) else "in_progress" if any(not x["done"] for x in tools) else "done" if tools
                          else "done" if "message" in step else "in_progress" if "reasoning" in step else "done")
                out[s, i, j] = (status, len(tools), sum(x["ms"] or 0 for x in tools), sum(step.get("usage", [0])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_a_state_machine(spark, seed):
    rows = random_sessions(seed, 300)
    a = assemble(spark.createDataFrame([event(**e) for e in rows], SCHEMA))
    steps = {(r.session_id, r.turn_index, r.step_index): r for r in a.steps.collect()}
    ms = {}
    for r in a.tools.collect():
        k = r.session_id, r.turn_index, r.step_index
        ms[k] = ms.get(k, 0) + (r.duration_ms or 0)
    want = state_machine(rows)
    assert {k: (r.status, r.tool_count, ms.get(k, 0), r.tokens) for k, r in steps.items()} == want
    assert len(want) > 300


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, X.session_uuid(F.lit("7f2abd2d-7cfc-4447-9ddd-3ca8d14e02e9"))) == "82dbb0e7-a88d-5cd2-b611-e73c375d0173"
    assert one(spark, X.clean_snippet(F.lit("a <changed_files>x\ny</changed_files>  b"))) == "a [..meta..] b"
    assert one(spark, X.exit_code(F.lit("done\nexit code: 3"))) == 3 and one(spark, X.exit_code(F.lit("none"))) is None
    assert [one(spark, c) for c in X.slash_command(F.lit("<command-name>/do</command-name><command-args>a b</command-args>"))] == ["/do", "a b"]
    assert [one(spark, c) for c in X.patch_header(F.lit("*** Begin\n*** Add File: a/b.rs\n+x"))] == ["Add", "a/b.rs"]
    assert one(spark, X.truncate_ellipsis(F.lit("abcdef"), 3)) == "abc" and one(spark, X.truncate_ellipsis(F.lit("abcdef"), 5)) == "ab..."


@pytest.mark.parametrize("command,intent,shell", [
    ("cat a", "read", "read"), ("bash -lc grep x", "read", "search"), ("sed -n 1p f", "read", "read"), ("sed -i s/a/b/ f", "write", None), ("echo a > b", "write", None),
    ("cargo build", "build", None), ("npm test", "test", None), ("git log", "git", None), ("python x.py", "other", None), ("rg --files", "read", "read"), ("rg foo", "read", "search"),
    ("bash -c bash -lc ls", "read", "read"), ("sed s/x/y/ a-i.txt", "read", "read"), ("rm -rf x", "write", None)])
def test_shell_intents(spark, command, intent, shell):
    assert one(spark, T.execute_intent(F.lit(command))) == intent
    assert one(spark, T.shell_intent(F.lit(command))) == shell


def test_limits(spark):
    assert one(spark, T.effective_limit(F.lit(200000), F.lit(22.5))) == 155000 and one(spark, T.effective_limit(F.lit(1000), F.lit(99.0))) == 10
    rows = T.join_model_limit(spark.createDataFrame([("gpt-5.1-codex-max-1",), ("claude-x",), (None,)], "model string")).collect()
    assert {r.model: r.max_tokens for r in rows} == {"gpt-5.1-codex-max-1": 400000, "claude-x": None, None: None}


def test_cursors():
    assert Q.offset_of(Q.cursor(40)) == 40 and Q.offset_of("rubbish") == 0 and Q.offset_of(None) == 0


def test_prefix(spark):
    s = spark.createDataFrame([("abc",), ("abd",), ("x",)], "session_id string")
    assert Q.resolve_prefix(s, "x") == "x" and Q.resolve_prefix(s, "q") is None and Q.resolve_prefix(s, "abc") == "abc"
    with pytest.raises(ValueError):
        Q.resolve_prefix(s, "ab")


def test_near_spawn(spark):
    kids = spark.createDataFrame([("a", 200), ("b", 2000), ("c", 5125)], "child_id string, start_ms long")
    spawns = spark.createDataFrame([("p", 225), ("p", 5100), ("q", 5226)], "parent_id string, spawn_ms long")
    assert {r.child_id: r.spawn_ms for r in Q.near_spawn(kids, spawns).collect()} == {"a": 225, "b": None, "c": 5100}


def plan_of(frame) -> str:
    """The executed plan, after adaptive execution."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


@pytest.mark.parametrize("name,windows,exchanges", [("session_metrics", 12, 2), ("analysis_report", 15, 2), ("provider_efficiency", 12, 3), ("list_turns", 12, 2), ("turn_stats", 12, 2), ("digest", 16, 8)])
def test_one_set_of_windows(spark, name, windows, exchanges):
    """Tables of all levels come from one scan and one exchange by session and stream (another one makes the test events)."""
    from sessionloom.plans.queries import QUERIES

    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert plan.count("Window [") + plan.count("Window(") <= windows, plan
    assert plan.count(" Exchange ") - plan.count("ReusedExchange") <= exchanges and plan.count("FileScan") == 1, plan


def test_turns_out_of_range(spark):
    rows = [event(session_id="s", event_id=str(i), ts=None, seq=i, type=t, text="x") for i, t in enumerate(["user", "message", "user", "message"])]
    a = assemble(spark.createDataFrame(rows, SCHEMA))
    assert Q.get_turns(a, [1], session="s").count() == 1
    with pytest.raises(IndexError):
        Q.get_turns(a, [2], session="s")


def test_stored_tables(spark, tmp_path):
    from sessionloom.operators import analyze as A
    from sessionloom.operators.assemble import Assembled

    a = assemble(spark.createDataFrame([event(**e) for e in random_sessions(3, 40)], SCHEMA))
    a.store(str(tmp_path))
    b = Assembled.load(spark, str(tmp_path))
    for f in (A.session_metrics, A.turn_metrics, A.tool_usage, Q.list_turns):
        assert sorted(map(str, f(b).select(*f(a).columns).collect())) == sorted(map(str, f(a).collect()))


def test_commands(spark):
    for command, pattern, path in (('rg -n "context window" docs -S', "context window", '"context'), ("grep pattern file.txt", "pattern", "file.txt"), ("ag 'a b' src/", "a b", "b'"),
                                   ("rg --files docs", "docs", "docs"), ('grep "open x', None, "x"), ("bash -lc cat file.txt", None, "file.txt"), ("sed -n '1,100p' file.txt", None, "file.txt"), ("ls", None, None)):
        assert one(spark, T.search_pattern_of(F.lit(command))) == pattern and one(spark, T.file_path_of(F.lit(command))) == path, command
    with pytest.raises(Exception):
        one(spark, T.effective_limit(F.lit(1000), F.lit(101.0)))


def test_file_named_like_its_command(spark):
    for command, path in (("sed -i s/a/b/ sed", "sed"), ("bash -lc sed -n '1,20p' sed", "sed"), ("sed -n '1,20p'", None), ("sed", None)):
        assert one(spark, T.file_path_of(F.lit(command))) == path, command


def test_own_lenses(spark):
    """A caller's lenses, in order, each with its share; the rest are fillers; nothing stays cached."""
    from sessionloom.operators import select as S

    rows = [(f"s{k}", k, k % 3, 0, 1, 10 * k, 0, 5 * k, 10 - k) for k in range(1, 9)]
    d = spark.createDataFrame(rows, "session_id string, tool_calls_total long, tool_failures_total long, missing_tool_pairs long, longest_chain long, max_e2e_ms long, loop_signals long, max_tool_ms long, boost long")
    c = F.col
    own = [S.Lens("Odd", c("tool_calls_total") % 2 == 1, c("tool_calls_total") * 1, F.lit("odd")), S.Lens("Slow", c("max_e2e_ms") >= c("p90_e2e_ms"), c("max_e2e_ms") * 1, F.format_string("e2e=%d", "max_e2e_ms"))]
    got = [(r.session_id, r.lens_order, r.lens, r.reason) for r in S.lens_select(d, 5, own).orderBy("lens_order", F.desc("score")).collect()]
    assert got == [("s7", 0, "Odd", "Odd (odd)"), ("s5", 0, "Odd", "Odd (odd)"), ("s8", 1, "Slow", "Slow (e2e=80)"), ("s6", 2, "Activity", "Activity (filler)"), ("s4", 2, "Activity", "Activity (filler)")]
    assert [r.lens for r in S.lens_select(d, 2, []).collect()] == ["Activity", "Activity"] and spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
