"""Events to raw log lines: the way back, for exports and round trips."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F


def _line(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _time() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")


def _arguments() -> Column:
    return F.struct("file_path", "command", "pattern", *[F.lit("x").alias(n) for n in ("content", "old_string", "new_string")])


def spoilt(arguments: Column) -> Column:
    """Arguments (JSON) of every seventh place without, and of the next with a number for, the first that the tool needs; of the third as an array."""
    first = r'"(file_path|command|pattern|query|raw)":("([^"\\\\]|\\\\.)*"|\[[^\]]*\])'
    return (F.when(F.col("seq") % 7 == 1, F.regexp_replace(arguments, first, '"none":1')).when(F.col("seq") % 7 == 2, F.regexp_replace(arguments, first, '"$1":5'))
            .when(F.col("seq") % 7 == 3, F.concat(F.lit("["), arguments, F.lit("]"))).otherwise(arguments))


def in_order(key: str, order: str) -> WindowSpec:
    return W.partitionBy(key).orderBy(order)


def claude_lines(events: DataFrame, usage: bool = False, spoil: bool = False) -> DataFrame:
    """path (the session), line_no (seq) and value in the first format; usage rows have no record of their own there, but with ``usage`` one that says nothing."""
    c, kind = F.col, F.col("type")
    kinds = ["user", "slash_command", "message", "reasoning", "tool_call", "tool_result", *(["token_usage"] if usage else [])]
    events = events.where(kind.isin(*kinds)).withColumns({"_said": kind.isin("user", "slash_command"), "_call": kind == "tool_call", "_answer": kind == "tool_result"})
    said, call, answer = c("_said"), c("_call"), c("_answer")

    def when(those: Column, **fields: Column) -> list[Column]:
        return [F.when(those, v).alias(k) for k, v in fields.items()]

    # A record is put together of two texts; JSON leaves fields that are null out, so that one struct has the blocks of all kinds.  A struct for each kind would make
    # the row's code a method of more than 8,000 bytes, which the JVM never compiles.
    head = F.to_json(F.struct(F.when(said | answer, "user").otherwise("assistant").alias("type"), c("event_id").alias("uuid"), c("session_id").alias("sessionId"), _time(),
                              (c("stream") != "main").alias("isSidechain"), *when(c("stream") != "main", agentId=F.substring_index("stream", ":", -1))))
    block = F.struct(
        F.when(kind == "message", "text").when(kind == "reasoning", "thinking").when(call, "tool_use").otherwise("tool_result").alias("type"), *when(kind == "message", text=c("text")),
        *when(kind == "reasoning", thinking=c("text")), *when(call, id=c("event_id"), name=c("tool_name"), input=F.parse_json(spoilt(F.to_json(_arguments()))) if spoil else _arguments()),
        *when(answer, tool_use_id=c("tool_call_id"), content=c("output"), is_error=c("is_error"), agentId=c("agent_id")))
    slash = F.concat(F.lit("<command-name>"), "slash_name", F.lit("</command-name>"))
    message = (F.when(said, F.to_json(F.struct(F.when(kind == "user", c("text")).otherwise(slash).alias("content"))))
               .otherwise(F.to_json(F.struct(F.array(block).alias("content")))))
    if usage:
        spent = F.struct(c("tok_uncached").alias("input_tokens"), c("tok_cached").alias("cache_read_input_tokens"), c("tok_generated").alias("output_tokens"))
        nothing = F.array(F.struct(F.lit("text").alias("type"), F.lit("").alias("text")))
        message = F.when(kind == "token_usage", F.to_json(F.struct(nothing.alias("content"), "model", spent.alias("usage")))).otherwise(message)
    value = F.concat(F.rtrim(head, F.lit("}")), F.lit(',"message":'), message, F.lit("}"))
    return events.select(c("session_id").alias("path"), c("seq").alias("line_no"), value.alias("value"))


def review_lines(events: DataFrame) -> DataFrame:
    """Lines of the second format in which slash commands are turn contexts, results begin reviews, and all else are steps."""
    kind = F.col("type")

    def record(what: str, inner: str) -> Column:
        return _line(_time(), F.lit(what).alias("type"), F.struct(F.lit(inner).alias("type")).alias("payload"))

    value = (F.when(kind == "slash_command", record("turn_context", "none")).when(kind == "user", record("event_msg", "user_message")).when(kind == "tool_result", record("event_msg", "entered_review_mode"))
             .when(kind == "message", record("event_msg", "agent_message")).otherwise(record("response_item", "message")))
    return events.select(F.col("session_id").alias("path"), F.col("seq").alias("line_no"), value.alias("value"))


def other_records(events: DataFrame) -> DataFrame:
    """path, line_no and value: records of the first format that nobody says, of eight sorts by place."""
    n = F.col("seq")

    def record(kind: str, **fields: Column) -> Column:
        return _line(F.lit(kind).alias("type"), F.col("event_id").alias("uuid"), F.col("session_id").alias("sessionId"), _time(), *[v.alias(k) for k, v in fields.items()])

    hooks = F.array(F.struct(F.lit("lint").alias("command")), F.struct(F.lit("fmt").alias("command")))
    sorts = [record("system", subtype=F.lit("local_command"), content=F.concat(F.lit("/model big "), "event_id")), record("system", subtype=F.lit("turn_duration"), durationMs=n),
             record("system", subtype=F.lit("compact_boundary"), compactMetadata=F.struct(F.when(n % 3 == 0, "auto").alias("trigger"), n.alias("preTokens"))),
             record("system", subtype=F.lit("stop_hook_summary"), hookCount=F.lit(2), hookInfos=hooks),
             record("progress", data=F.struct(F.lit("hook_progress").alias("type"), F.lit("Stop").alias("hookEvent"), F.lit("h").alias("hookName"), F.when(n % 3 == 0, "run").alias("command"))),
             record("queue-operation", operation=F.lit("enqueue"), content=F.concat(F.lit("task "), "event_id")), record("summary", summary=F.concat(F.lit("sum "), "event_id"), leafUuid=F.col("event_id")),
             record("pr-link", prNumber=n, prUrl=F.lit("http://x"), prRepository=F.lit("r"))]
    return events.select(F.col("session_id").alias("path"), n.alias("line_no"), F.element_at(F.array(*sorts), (n % 8 + 1).cast("int")).alias("value"))


def own_names(events: DataFrame, names: dict[str, str]) -> Column:
    """The tool's name in another format."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("tool_name")), F.col("tool_name"))


def codex_tool_lines(events: DataFrame) -> DataFrame:
    """Calls in the second format as its own tools: shell, shell commands and patches."""
    name = own_names(events, {"Bash": "shell", "Read": "shell_command", "Grep": "shell", "Edit": "apply_patch"})
    tool = F.col("tool_name")
    args = (F.when(tool == "Bash", F.to_json(F.struct(F.array(F.lit("bash"), F.lit("-lc"), "command").alias("command")))).when(tool == "Read", F.to_json(F.struct(F.concat(F.lit("cat "), "file_path").alias("command"))))
            .when(tool == "Grep", F.to_json(F.struct(F.array(F.lit("rg"), F.lit("-n"), "pattern", F.lit("src")).alias("command"))))
            .when(tool == "Edit", F.concat(F.lit("*** Begin Patch\n*** "), F.when(F.col("seq") % 2 == 0, "Add").otherwise("Update"), F.lit(" File: "), "file_path", F.lit("\n+x"))).otherwise("{}"))
    call = F.struct(F.lit("function_call").alias("type"), name.alias("name"), spoilt(args).alias("arguments"), F.col("event_id").alias("call_id"))
    return events.where("type = 'tool_call'").select(F.col("session_id").alias("path"), F.col("seq").alias("line_no"), _line(_time(), F.lit("response_item").alias("type"), call.alias("payload")).alias("value"))


def gemini_documents(events: DataFrame, own_tools: bool = False) -> DataFrame:
    """path (the session) and value: one document of the third format a session, without results and slash commands; calls of even places have a result.

    With ``own_tools`` tools have that format's names and arguments, some of them spoilt."""
    kind = F.col("type")
    if own_tools:
        mcp = F.col("tool_name").startswith("mcp__")
        named = own_names(events, {"Read": "read_file", "Edit": "replace", "Bash": "run_shell_command", "Grep": "google_web_search"})
        events = events.withColumn("_display", F.when(mcp, F.concat("mcp_tool", F.lit(" ("), "mcp_server", F.lit(" MCP Server)")))).withColumn("tool_name", F.when(mcp, F.col("mcp_tool")).otherwise(named))
    else:
        events = events.withColumn("_display", F.lit(None).cast("string"))
    args = F.struct("file_path", "command")
    if own_tools:
        args = F.parse_json(spoilt(F.to_json(F.struct("file_path", "command", F.col("pattern").alias("query"), *[F.lit("x").alias(n) for n in ("content", "old_string", "new_string")]))))
    identity = F.concat(F.lit("m"), "event_id").alias("id")
    call = F.struct(F.col("event_id").alias("id"), F.col("tool_name").alias("name"), F.col("_display").alias("displayName"), args.alias("args"),
                    F.when(F.col("seq") % 2 == 0, F.array(F.struct(F.lit(1).alias("x")))).otherwise(F.filter(F.array(F.struct(F.lit(1).alias("x"))), lambda x: F.lit(False))).alias("result"),
                    F.when(F.col("seq") % 4 == 0, "error").otherwise("success").alias("status"), F.concat(F.lit("shown "), "event_id").alias("resultDisplay"))
    tokens = F.struct(F.col("tok_uncached").alias("input"), F.col("tok_generated").alias("output"), F.col("tok_cached").alias("cached"), F.lit(1).alias("thoughts"), F.lit(2).alias("tool"), F.lit(0).alias("total"))
    message = F.struct(
        F.when(kind == "user", "user").when(kind == "notification", "info").otherwise("gemini").alias("type"), identity, _time(),
        F.when(kind.isin("user", "message", "notification"), F.col("text")).otherwise("").alias("content"), "model",
        F.when(kind == "reasoning", F.array(F.struct(F.lit("why").alias("subject"), F.col("text").alias("description")))).alias("thoughts"),
        F.when(kind == "tool_call", F.array(call)).alias("toolCalls"), F.when(kind == "token_usage", tokens).alias("tokens"))
    rows = events.where("type not in ('tool_result', 'slash_command')").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.to_json(message).alias("m")))).alias("_m"))
    # Messages are JSON already and are put together as they are; parsed and written again, a document would cost twice what reading it does.
    named = F.to_json(F.struct(F.col("session_id").alias("sessionId")))
    value = F.concat(F.rtrim(named, F.lit("}")), F.when(F.col("session_id").isNull(), "").otherwise(","), F.lit('"messages":['), F.array_join("_m.m", ","), F.lit("]}"))
    return rows.select(F.col("session_id").alias("path"), value.alias("value"))


def codex_lines(events: DataFrame, models: bool = False) -> DataFrame:
    """The same in the second format, which has no slash commands; with ``models`` they are turn contexts that name a model."""
    c, kind = F.col, F.col("type")
    kinds = ["user", "message", "reasoning", "tool_call", "tool_result", "token_usage", *(["slash_command"] if models else [])]
    events = events.where(kind.isin(*kinds)).withColumns({"_spoken": kind.isin("user", "message"), "_call": kind == "tool_call", "_answer": kind == "tool_result", "_usage": kind == "token_usage"})
    spoken, call, answer, usage = c("_spoken"), c("_call"), c("_answer"), c("_usage")

    def when(those: Column, **fields: Column) -> list[Column]:
        return [F.when(those, v).alias(k) for k, v in fields.items()]

    text = F.array(F.struct(F.lit("t").alias("type"), "text"))
    last = F.struct((c("tok_uncached") + c("tok_cached")).alias("input_tokens"), c("tok_cached").alias("cached_input_tokens"),
                    c("tok_generated").alias("output_tokens"), (c("tok_uncached") + c("tok_cached") + c("tok_generated")).alias("total_tokens"))
    info = F.struct(last.alias("last_token_usage"), (c("seq") * 10).alias("model_context_window"))
    output = F.concat(F.lit("Exit code: "), c("is_error").cast("int").cast("string"), F.lit("\n"), "output")
    # One struct for all kinds, as in the first format.
    inner = F.when(spoken, "message").when(kind == "reasoning", "reasoning").when(call, "function_call").when(answer, "function_call_output").when(usage, "token_count")
    payload = F.struct(
        inner.alias("type"), *when(spoken, role=F.when(kind == "user", "user").otherwise("assistant"), content=text),
        F.when(kind == "reasoning", F.array(F.struct(F.lit("summary_text").alias("type"), "text"))).alias("summary"), *when(call, name=c("tool_name"), arguments=F.to_json(_arguments())),
        F.when(call, c("event_id")).when(answer, c("tool_call_id")).alias("call_id"), *when(answer, output=output), *when(usage, info=info),
        *(when(kind == "slash_command", model=F.concat_ws("-", "model", c("seq").cast("string"))) if models else ()))
    record = F.when(usage, "event_msg").when(kind == "slash_command", "turn_context").otherwise("response_item")
    return events.select(c("session_id").alias("path"), c("seq").alias("line_no"), _line(_time(), record.alias("type"), payload.alias("payload")).alias("value"))


def write_files(lines: DataFrame, folder: str, suffix: str = ".jsonl") -> int:
    """Writes the lines of each path to a file of its name below ``folder``, in place of what was there; gives the number of files.

    lines: path (parts may be joined by slashes), line_no, value and, if lines don't end all alike, ``end``.  Each file is written by one task, line by line."""
    if "end" not in lines.columns:
        lines = lines.withColumn("end", F.lit("\n"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        at = out = None
        n = 0
        for batch in batches:
            for path, value, end in zip(*[batch.column(c).to_pylist() for c in ("path", "value", "end")]):
                if path != at:
                    if out:
                        out.close()
                    name = f"{root}/{path}{suffix}"
                    files.create_dir(name.rpartition("/")[0], recursive=True)
                    at, out, n = path, files.open_output_stream(name), n + 1
                out.write(f"{value}{end}".encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return lines.select("path", "line_no", "value", "end").repartition("path").sortWithinPartitions("path", "line_no").mapInArrow(each, "files long").agg(F.sum("files")).first()[0] or 0
