"""A format that the library doesn't know, by specification; errors beside events; what tools take."""

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import schemas
from sessionloom.functions.schemas import ToolSchema
from sessionloom.operators.assemble import assemble
from sessionloom.sources import formats, ingest
from sessionloom.sources.formats import ProviderSpec, Rule

NOTES = ProviderSpec(
    "notes", (".notes/",), "*.log", record="sid string, at string, n long, who string, say string, run struct<tool:string,args:string,id:string>, got struct<id:string,out:string,ok:boolean>, spent long",
    session=lambda r: r["sid"], time=lambda r: r["at"], identity=lambda r: r["n"],
    rules=(Rule("user", lambda r: (r["who"] == "me") & r["say"].isNotNull(), {"text": lambda r: r["say"]}),
           Rule("message", lambda r: (r["who"] == "bot") & r["say"].isNotNull(), {"text": lambda r: r["say"]}),
           Rule("tool_call", lambda r: r["run"].isNotNull(), {"tool_name": lambda r: r["run"]["tool"], "arguments": lambda r: r["run"]["args"], "provider_call_id": lambda r: r["run"]["id"]}),
           Rule("tool_result", lambda r: r["got"].isNotNull(), {"provider_call_id": lambda r: r["got"]["id"], "output": lambda r: r["got"]["out"], "is_error": lambda r: ~r["got"]["ok"]}),
           Rule("token_usage", lambda r: r["spent"].isNotNull(), {"tok_uncached": lambda r: r["spent"], "tok_generated": lambda r: F.lit(1)})),
    tools=(ToolSchema("notes", ("open",), "FileRead", "file_path string!"), ToolSchema("notes", ("sh",), "Execute", "command string!, wait integer?")),
    clock=lambda v: ingest.at(v, "$.at"))

LINES = [
    '{"sid":"q","at":"2024-01-01T00:00:00Z","n":1,"who":"me","say":"hello"}',
    '{"sid":"q","at":"2024-01-01T00:00:01Z","n":2,"who":"bot","say":"looking","run":{"tool":"open","args":"{\\"file_path\\":\\"a.txt\\"}","id":"c1"}}',
    '{"sid":"q","at":"2024-01-01T00:00:02Z","n":3,"got":{"id":"c1","out":"text","ok":false},"spent":7}',
    "no json",
    '{"sid":"q","at":"soon","n":4,"who":"me","say":"lost"}',
    '{"sid":"q","at":"2024-01-01T00:00:03Z","n":5,"run":{"tool":"sh","args":"{\\"wait\\":3}","id":"c2"}}',
]


def test_a_format_of_its_own(spark, tmp_path):
    folder = tmp_path / ".notes"
    folder.mkdir()
    (folder / "day.log").write_text("\n".join(LINES) + "\n")
    specs = (*formats.known_formats(), NOTES)
    got = formats.parse(spark, [str(folder / "day.log"), str(folder / "day.txt"), "/nowhere/x.log"], specs=specs)
    events = got.events.orderBy("seq").collect()
    assert [(r.provider, r.seq, r.type, r.text or r.tool_name or r.output) for r in events] == [
        ("notes", 1, "user", "hello"), ("notes", 2, "message", "looking"), ("notes", 3, "tool_call", "open"), ("notes", 4, "tool_result", "text"), ("notes", 5, "token_usage", None), ("notes", 6, "tool_call", "sh")]
    call, answer = events[2], events[3]
    assert (call.tool_variant, call.tool_kind, call.file_path, answer.tool_call_id, answer.is_error) == ("FileRead", "read", "a.txt", call.event_id, True)
    assert events[5].tool_variant == "Generic"  # its command is missing
    assert events[1].parent_id == events[0].event_id and {r.raw_session_id for r in events} == {"q"}
    assert sorted((r.reason, r.value or r.path.rpartition("/")[2]) for r in got.errors.collect()) == [("no time", LINES[4]), ("not JSON", "no json"), ("not a log", "day.txt"), ("unknown path", "x.log")]
    a = assemble(got.events)
    assert [(r.total_turns, r.total_tokens) for r in a.sessions.select("total_turns", "total_tokens").collect()] == [(1, 8)]
    got.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/events")).count() == 6 and spark.read.parquet(str(tmp_path / "out/errors")).count() == 4


def test_known_formats_by_name(spark, tmp_path):
    """A named format needs no mark in the path; nothing read is no rows."""
    (tmp_path / "x.jsonl").write_text('{"type":"user","uuid":"u","sessionId":"s","timestamp":"2024-01-01T00:00:00Z","message":{"content":"hi"}}\n')
    got = formats.parse(spark, [str(tmp_path / "x.jsonl")], provider="claude_code")
    assert [(r.type, r.text) for r in got.events.collect()] == [("user", "hi")] and got.errors.collect() == []
    none = formats.parse(spark, [])
    assert none.events.collect() == [] and none.events.columns == ingest.EVENT_COLUMNS and none.errors.collect() == []


@pytest.mark.parametrize("takes, arguments, want", [
    ("a string!", '{"a":"x","b":1}', True), ("a string!", "{}", False), ("a string!", '{"a":null}', False), ("a string!", '{"a":1}', False), ("a string?", '{"a":null}', True),
    ("a string?", "{}", True), ("a boolean", "{}", True), ("a boolean", '{"a":null}', False), ("a boolean", '{"a":true}', True), ("a integer?", '{"a":-1}', False),
    ("a integer?", '{"a":1.5}', False), ("a integer?", '{"a":7}', True), ("a strings!", '{"a":["x"]}', True), ("a strings!", '{"a":[]}', True), ("a strings!", '{"a":[1]}', False),
    ("a strings!", '{"a":"x"}', False), ("-i boolean?", '{"-i":"x"}', False), ("-i boolean?", '{"-i":false}', True), ("", "[]", False), ("", "{}", True), ("", '"x"', False), ("", None, False)])
def test_what_tools_take(spark, takes, arguments, want):
    rows = schemas.schema_table(spark, (ToolSchema("p", ("t",), "V", takes),)).withColumn("v", F.try_parse_json(F.lit(arguments).cast("string")))
    assert rows.select(schemas.fits(F.col("v"), F.col("takes"))).first()[0] is want
