"""Raw logs of three formats to agent events.

Lines come as a frame (path, place, value), where places order a file's lines;
:func:`read_lines` makes it from files.  A line that isn't JSON is left out
(:func:`bad_lines` has them).  A record is parsed once and gives an array of
events, which is exploded; only then rows are shuffled, by path, for all that
looks back in a file (numbers of lines, parents, results to calls, models).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import schemas as S
from ..functions import text as X
from ..functions import tools as T

_FIELDS = {
    "text": "string", "level": "string", "slash_name": "string", "slash_args": "string", "queue_op": "string", "queue_content": "string",
    "task_id": "string", "leaf_uuid": "string", "tool_name": "string", "display_name": "string", "provider_call_id": "string", "arguments": "string",
    "output": "string", "is_error": "boolean", "agent_id": "string", "tok_cached": "long", "tok_uncached": "long", "tok_generated": "long",
    "tok_reasoning": "long", "tok_tool": "long", "model": "string", "context_limit": "long"}


def _flat(spark: SparkSession, folders: tuple[str, ...]) -> bool:
    """Whether the folders (or globs of folders) are there, and hold files only."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = list(files.globStatus(path) or ())
        if not found or any(not f.isDirectory() or files.getContentSummary(f.getPath()).getDirectoryCount() > 1 for f in found):
            return False
    return True


def _texts(spark: SparkSession, paths: tuple[str, ...], **options) -> DataFrame:
    """Text files.  A glob of file names is a filter on its folder's listing: as a path, it would make each file a root that is listed by itself.

    Where folders lie below, which a glob may mean, too, it is left a path."""
    folders, names = zip(*[p.rpartition("/")[::2] for p in paths])
    if len(set(names)) == 1 and any(c in names[0] for c in "*?[{") and all(folders) and _flat(spark, folders):
        return spark.read.option("pathGlobFilter", names[0]).text(list(folders), **options)
    return spark.read.text(list(paths), **options)


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """path, place and value of every line that isn't blank; files may be split between tasks, and nothing is shuffled.

    Places order the lines of a file: where the split begins, and the line's turn in it."""
    rows = _texts(spark, paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"))
    return rows.select("path", F.struct("_block", F.monotonically_increasing_id().alias("_id")).alias("place"), "value").where(F.trim("value") != "")


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """path, line_no (from 0) and value of the first ``n`` lines of each file; each task keeps no more than those of a file."""
    if "line_no" in lines.columns:
        return lines.where(F.col("line_no") < n)
    nth = F.row_number().over(W.partitionBy("path").orderBy("place"))
    return lines.withColumn("_nth", nth).where(F.col("_nth") <= n).select("path", (F.col("_nth") - 1).cast("long").alias("line_no"), "value")


def place_of(lines: DataFrame) -> Column:
    """What orders the lines of a file: their place, or their number where they have one."""
    return F.col("line_no" if "line_no" in lines.columns else "place")


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """path and whole value of every file."""
    return _texts(spark, paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that aren't JSON."""
    return lines.where(F.try_parse_json("value").isNull())


def at(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _event(kind: str, suffix: str, **values: Column) -> Column:
    """A struct of one event; fields that aren't given are null."""
    fields = [F.lit(kind).alias("type"), F.lit(suffix).alias("suffix")]
    return F.struct(*fields, *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()])


def _first_of(cases: list[tuple]) -> Column:
    """The struct of the first case (condition, event) that holds; null if none does."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(None))


# Parts of paths that tell a format.
PROVIDER_MARKS = ((".claude/", "claude_code"), (".codex/", "codex"), (".gemini/", "gemini"))


def detect_provider(path: Column) -> Column:
    """The format that a path tells; null if none."""
    return reduce(lambda rest, mark: F.when(path.contains(mark[0]), mark[1]).otherwise(rest), reversed(PROVIDER_MARKS), F.lit(None).cast("string"))


def parse_ts(text: Column) -> Column:
    return F.try_to_timestamp(text)


def _finish(rows: DataFrame, provider: str, session: Column, schemas: tuple[S.ToolSchema, ...] = S.SCHEMAS) -> DataFrame:
    """Ids, links and order.  rows: path, place or line_no, raw (a session id or null), ts, stream, sub_no, base_id, and the event ``e`` (null for lines without)."""
    place = "line_no" if "line_no" in rows.columns else "place"
    line = W.partitionBy("path").orderBy(place)
    order = W.partitionBy("path").orderBy(place, "sub_no")
    if place == "place":
        rows = rows.withColumn("line_no", (F.dense_rank().over(line) - 1).cast("long"))
    rows = rows.withColumn("raw_session_id", F.coalesce(F.first(F.when(F.col("e").isNotNull() & F.col("ts").isNotNull(), F.col("raw")), True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), session))
    rows = rows.where("e is not null and ts is not null").select("path", "raw_session_id", "ts", "stream", "line_no", "sub_no", "base_id", "e.*")
    rows = rows.withColumn("session_id", X.session_uuid(F.col("raw_session_id")))
    rows = rows.withColumn("event_id", X.uuid5(F.col("session_id"), F.concat("base_id", F.lit(":"), "suffix")))
    same_call = W.partitionBy("path", "provider_call_id").orderBy("line_no", "sub_no").rowsBetween(W.unboundedPreceding, -1)
    called = F.last(F.when(F.col("type") == "tool_call", F.col("event_id")), True).over(same_call)
    rows = rows.withColumn("tool_call_id", F.when((F.col("type") == "tool_result") & F.col("provider_call_id").isNotNull(), called))
    rows = rows.where("type != 'tool_result' or tool_call_id is not null")
    rows = rows.withColumn("parent_id", F.lag("event_id").over(W.partitionBy("path", "stream").orderBy("line_no", "sub_no")))
    seq = F.row_number().over(W.partitionBy("session_id").orderBy("ts", "path", "line_no", "sub_no"))
    rows = rows.withColumn("seq", seq.cast("long")).withColumn("provider", F.lit(provider))
    return with_payload(with_tool_columns(rows, schemas)).drop("suffix", "base_id", "sub_no")


def with_payload(rows: DataFrame) -> DataFrame:
    """``payload_json``: type and content of each event, for search; fields without a value are left out."""
    kind = F.col("type")
    content = F.struct(
        "text", "level", F.coalesce("slash_name", "tool_name").alias("name"), F.col("slash_args").alias("args"), F.try_parse_json("arguments").alias("arguments"), "provider_call_id",
        F.when(kind == "tool_result", F.col("tool_call_id")).alias("tool_call_id"), "output", F.when(kind == "tool_result", F.col("is_error")).alias("is_error"), "agent_id",
        F.col("queue_op").alias("operation"), F.col("queue_content").alias("content"), "task_id", "leaf_uuid",
        F.when(kind == "token_usage", F.struct(F.col("tok_cached").alias("cached"), F.col("tok_uncached").alias("uncached"))).alias("input"),
        F.when(kind == "token_usage", F.struct(F.col("tok_generated").alias("generated"), F.col("tok_reasoning").alias("reasoning"), F.col("tok_tool").alias("tool"))).alias("usage"))
    return rows.withColumn("payload_json", F.to_json(F.struct("type", content.alias("content"))))


# --- first format: JSON lines tagged by type ---------------------------------------------------------------------

def claude_events(lines: DataFrame) -> DataFrame:
    """Events of lines of the first format; a user or assistant record gives one for each block of its content, and its usage."""
    place = place_of(lines)
    name_of_place = "line_no" if "line_no" in lines.columns else "place"
    c = F.col
    r = lines.withColumn("v", F.try_parse_json("value")).select(
        "path", place.alias(name_of_place), "v", at("v", "$.type").alias("record"), at("v", "$.sessionId").alias("raw"), parse_ts(at("v", "$.timestamp")).alias("ts"),
        at("v", "$.uuid").alias("uuid"), F.coalesce(at("v", "$.isSidechain", "boolean"), F.lit(False)).alias("side"), at("v", "$.agentId").alias("agent"),
        at("v", "$.subtype").alias("sub"), at("v", "$.message.model").alias("model"), at("v", "$.message.usage.input_tokens", "long").alias("spent"))
    said = at("v", "$.message.content", "variant")
    plain = F.when(F.schema_of_variant(said) == "STRING", F.array(F.parse_json(F.to_json(F.struct(F.lit("text").alias("type"), at("v", "$.message.content").alias("text"))))))
    talk, none = c("record").isin("user", "assistant"), F.expr("cast(array() as array<variant>)")
    r = r.withColumn("blocks", F.when(talk, F.coalesce(plain, at("v", "$.message.content", "array<variant>"), none)).otherwise(none))
    makes = F.exists("blocks", lambda x: F.try_variant_get(x, "$.type", "string").isin("tool_use", "text"))
    usage, other = (c("record") == "assistant") & makes & c("spent").isNotNull(), c("v").isNotNull() & ~F.coalesce(talk, F.lit(False))

    def item(what: str, sub_no: Column, b: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), sub_no.cast("long").alias("sub_no"), b.alias("b"))

    def itself(when: Column, what: str, sub_no: int) -> Column:
        return F.when(when, F.array(item(what, F.lit(sub_no), c("v")))).otherwise(F.transform(none, lambda x: item(what, F.lit(sub_no), x)))

    items = F.concat(F.transform("blocks", lambda x, i: item("block", i, x)), itself(usage, "usage", 1 << 40), itself(other, "record", 0))
    stream = F.when(c("side") & ~c("record").isin("queue-operation", "summary", "pr-link"), F.concat(F.lit("sidechain:"), F.coalesce("agent", F.lit("unknown")))).otherwise("main")
    r = r.withColumn("stream", stream).withColumn("result_agent", at("v", "$.toolUseResult.agentId")).withColumn("stamp", at("v", "$.timestamp"))
    b = r.select("path", name_of_place, "raw", "ts", "stream", "record", "uuid", "sub", "model", "spent", "result_agent", "stamp", F.explode_outer(items).alias("x")).select("*", "x.*").drop("x")
    b = b.withColumns({"kind": at("b", "$.type"), "said": at("b", "$.text"), "told": at("b", "$.content")})

    kind, text, told, what, record, sub, user = c("kind"), c("said"), c("told"), c("what"), c("record"), c("sub"), c("record") == "user"
    name, args = X.slash_command(text)
    result = F.when(F.schema_of_variant(at("b", "$.content", "variant")) == "STRING", told)
    block, whole = what == "block", what == "record"

    def note_of(v: Column) -> Column:
        # The texts of notifications, the suffixes of ids below, and what stands for names that are missing.
        def told_of(path: str, missing: str, kind: str = "string") -> Column:
            return F.coalesce(at(v, path, kind).cast("string"), F.lit(missing))

        hooks = F.array_join(F.filter(F.transform(at(v, "$.hookInfos", "array<variant>"), lambda h: F.try_variant_get(h, "$.command", "string")), lambda x: x.isNotNull()), ", ")
        lasted, before = at(v, "$.durationMs", "long"), at(v, "$.compactMetadata.preTokens", "long")
        is_system = record == "system"
        return (F.when(is_system & (sub == "turn_duration") & lasted.isNotNull(), F.concat(F.lit("Turn duration: "), lasted.cast("string"), F.lit("ms")))
                .when(is_system & (sub == "compact_boundary"), F.concat(F.lit("Context compaction (trigger: "), told_of("$.compactMetadata.trigger", "unknown"), F.coalesce(F.concat(F.lit(", pre_tokens: "), before.cast("string")), F.lit("")), F.lit(")")))
                .when(is_system & (sub == "stop_hook_summary"), F.concat(F.lit("Stop hooks executed (count: "), told_of("$.hookCount", "0", "long"), F.lit(")"), F.when(hooks != "", F.concat(F.lit(": "), hooks)).otherwise("")))
                .when((record == "progress") & (at(v, "$.data.type") == "hook_progress"), F.concat(F.lit("Hook: "), told_of("$.data.hookName", "unknown"), F.lit(" ("), told_of("$.data.hookEvent", ""), F.lit(")")))
                .when(record == "pr-link", F.concat(F.lit("PR #"), told_of("$.prNumber", "", "long"), F.lit(" linked: "), at(v, "$.prUrl"))))

    # A function of the few records that aren't said by anyone: kept out of the code that is generated for all rows, which has a bound.
    note = F.when(whole, F.get(F.transform(F.array("b"), note_of), 0))
    loud = (record == "pr-link") | sub.isin("compact_boundary", "stop_hook_summary") | at("b", "$.data.command").isNotNull()
    b = b.withColumns({"note": note, "name": name, "args": args})
    name, args = c("name"), c("args")
    of_block = (F.when(kind == "text", F.when(~user, "message").when(name.isNotNull(), "slash_command").otherwise("user")).when(kind == "tool_result", "tool_result")
                .when(~user & (kind == "thinking"), "reasoning").when(~user & (kind == "tool_use"), "tool_call"))
    of_record = (F.when((record == "system") & (sub == "local_command") & told.isNotNull(), "slash_command").when(c("note").isNotNull(), "notification")
                 .when(record == "queue-operation", "queue_operation").when(record == "summary", "summary"))
    b = b.withColumn("type", F.when(block, of_block).when(whole, of_record).when(what == "usage", "token_usage"))
    kind = c("type")
    # Columns of their own, as each is asked several times: a method of more than 8,000 bytes is never compiled by the JVM, and the row's code is one method.
    b = b.withColumns({"_call": kind == "tool_call", "_answer": kind == "tool_result", "_slash": kind == "slash_command", "_spent": kind == "token_usage", "_queue": kind == "queue_operation",
                       "_block": block})
    call, answer, slash, spent, queue, block = (c(f"_{n}") for n in ("call", "answer", "slash", "spent", "queue", "block"))
    suffix = F.create_map(*[F.lit(x) for x in ("slash_command", "slashcmd", "tool_call", "call", "tool_result", "result", "token_usage", "usage", "notification", "notify", "queue_operation", "queue")])
    fields = {
        "text": F.when(kind.isin("user", "message"), text).when(kind == "reasoning", at("b", "$.thinking")).when(kind == "notification", c("note")).when(kind == "summary", at("b", "$.summary")),
        "level": F.when(kind == "notification", F.when(loud, "info").otherwise("debug")),
        "slash_name": F.when(slash & block, name).when(slash, F.substring_index(told, " ", 1)),
        "slash_args": F.when(slash & block, args).when(slash & told.contains(" "), F.regexp_extract(told, r"(?s)^[^ ]* (.*)$", 1)),
        "queue_op": F.when(queue, at("b", "$.operation")), "queue_content": F.when(queue, told), "task_id": F.when(queue, at("b", "$.taskId")),
        "leaf_uuid": F.when(kind == "summary", at("b", "$.leafUuid")), "tool_name": F.when(call, at("b", "$.name")),
        "provider_call_id": F.when(call, at("b", "$.id")).when(answer, at("b", "$.tool_use_id")), "arguments": F.when(call, at("b", "$.input")),
        "output": F.when(answer, F.coalesce(result, F.lit(""))), "is_error": F.when(answer, F.coalesce(at("b", "$.is_error", "boolean"), F.lit(False))),
        "agent_id": F.when(answer & user, F.coalesce(at("b", "$.agentId"), c("result_agent"))),
        "tok_cached": F.when(spent, F.coalesce(at("b", "$.message.usage.cache_read_input_tokens", "long"), F.lit(0))), "tok_uncached": F.when(spent, c("spent")),
        "tok_generated": F.when(spent, at("b", "$.message.usage.output_tokens", "long")), "tok_reasoning": F.when(spent, 0), "tok_tool": F.when(spent, 0),
        "model": F.when(call | spent, c("model"))}
    e = F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.coalesce(F.try_element_at(suffix, kind), kind).alias("suffix"),
                                          *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()]))
    made_up = F.concat(F.lit("gen-"), F.lower(F.hex(F.xxhash64("raw", "stamp", "record"))))
    base = (F.when(block, F.concat(c("uuid"), F.lit("-content-"), c("sub_no").cast("string"))).when(record.isin("queue-operation", "pr-link"), made_up)
            .when(record == "summary", F.coalesce(at("b", "$.leafUuid"), F.lit("summary"))).otherwise(c("uuid")))
    rows = b.select("path", name_of_place, "raw", "ts", "stream", F.coalesce("sub_no", F.lit(0)).alias("sub_no"), base.alias("base_id"), e.alias("e"))
    return _finish(rows, "claude_code", F.lit("unknown"))


# --- second format: JSON lines of timestamp, type and payload ------------------------------------------------------

def codex_events(lines: DataFrame) -> DataFrame:
    """Events of lines of the second format: their fields are taken out first, then rows look back in their file for session, agent, model and last usage."""
    c, place = F.col, "line_no" if "line_no" in lines.columns else "place"
    r = lines.withColumn("v", F.try_parse_json("value")).select(
        "path", place, "v", at("v", "$.type").alias("record"), at("v", "$.payload.type").alias("kind"), at("v", "$.payload.role").alias("role"), parse_ts(at("v", "$.timestamp")).alias("ts"),
        F.coalesce(at("v", "$.payload.arguments"), at("v", "$.payload.input")).alias("raw_args"), at("v", "$.payload.output").alias("output"))

    def joined(path: str) -> Column:
        return F.array_join(F.filter(F.transform(at("v", path, "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), lambda t: t.isNotNull()), "\n")

    kind, item, meta = c("kind"), c("record") == "response_item", c("record") == "session_meta"
    reasoned = F.coalesce(F.nullif(F.when(F.schema_of_variant(at("v", "$.payload.content", "variant")) == "STRING", at("v", "$.payload.content")).otherwise(joined("$.payload.content")), F.lit("")),
                          joined("$.payload.summary"), F.lit(""))
    args = F.when(F.try_parse_json("raw_args").isNotNull(), c("raw_args")).otherwise(F.to_json(F.struct(c("raw_args").alias("raw"))))
    failed = F.coalesce(X.exit_code(c("output")) != 0, F.lit(False))
    tokens = "$.payload.info.last_token_usage"
    spent, cached = at("v", f"{tokens}.input_tokens", "long"), F.coalesce(at("v", f"{tokens}.cached_input_tokens", "long"), F.lit(0))
    cases = [
        (item & (kind == "message") & (c("role") == "user"), _event("user", "user", text=joined("$.payload.content"))),
        (item & (kind == "message"), _event("message", "message", text=joined("$.payload.content"))),
        (item & (kind == "reasoning"), _event("reasoning", "reasoning", text=reasoned)),
        (item & kind.isin("function_call", "custom_tool_call"), _event("tool_call", "call", tool_name=at("v", "$.payload.name"), provider_call_id=at("v", "$.payload.call_id"), arguments=args)),
        (item & kind.isin("function_call_output", "custom_tool_call_output"), _event("tool_result", "result", provider_call_id=at("v", "$.payload.call_id"), output=c("output"), is_error=failed)),
        ((kind == "token_count") & spent.isNotNull(), _event("token_usage", "usage", tok_cached=cached, tok_uncached=F.greatest(F.lit(0), spent - cached), tok_generated=at("v", f"{tokens}.output_tokens", "long"),
                                                             tok_reasoning=F.coalesce(at("v", f"{tokens}.reasoning_output_tokens", "long"), F.lit(0)), tok_tool=F.lit(0),
                                                             context_limit=F.coalesce(at("v", "$.payload.info.model_context_window", "long"), at("v", "$.info.model_context_window", "long"))))]
    usage = F.when((kind == "token_count") & spent.isNotNull(), F.struct(spent.alias("i"), at("v", f"{tokens}.output_tokens", "long").alias("o"), at("v", f"{tokens}.total_tokens", "long").alias("t")))
    r = r.select("path", place, "ts", _first_of(cases).alias("e"), usage.alias("usage"), F.when(meta, at("v", "$.payload.id")).alias("_id"), F.when(meta, at("v", "$.payload.source.subagent")).alias("_agent"),
                 F.when(c("record") == "turn_context", at("v", "$.payload.model")).alias("_model"))
    order = W.partitionBy("path").orderBy(place)
    whole, upto, before = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumns({"raw": F.last("_id", True).over(whole), "_agent": F.last("_agent", True).over(whole), "_model": F.last("_model", True).over(upto),
                       "_was": F.last("usage", True).over(before), "_row": (F.row_number().over(order) - 1)})
    again = c("usage").isNotNull() & c("usage").eqNullSafe(c("_was"))
    base = F.concat(F.coalesce("raw", F.lit("unknown-session")), F.lit(":row_"), (c("line_no") if place == "line_no" else c("_row")).cast("string"))
    stream = F.when(c("_agent").isNotNull(), F.concat(F.lit("subagent:"), "_agent")).otherwise("main")
    rows = r.select("path", place, "raw", "ts", stream.alias("stream"), F.lit(0).cast("long").alias("sub_no"), base.alias("base_id"),
                    F.when(~again, c("e").withField("model", F.coalesce("e.model", "_model"))).alias("e"))
    return _finish(rows, "codex", F.lit("unknown-session"))


# --- third format: one JSON document a session -----------------------------------------------------------------------

def gemini_events(documents: DataFrame) -> DataFrame:
    """Events of whole documents (path, value); the legacy array format has a header only and gives none."""
    d = documents.withColumn("d", F.try_parse_json("value")).where("d is not null").select(
        "path", at("d", "$.sessionId").alias("raw"), F.posexplode(at("d", "$.messages", "array<variant>")).alias("line_no", "m"))
    c, none = F.col, F.expr("cast(array() as array<variant>)")
    r = d.select("path", "raw", c("line_no").cast("long").alias("line_no"), "m", at("m", "$.type").alias("kind"), parse_ts(at("m", "$.timestamp")).alias("ts"),
                 at("m", "$.model").alias("model"), at("m", "$.id").alias("identity"))

    def item(what: str, i: Column, b: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), i.cast("int").alias("i"), b.alias("b"))

    def itself(what: str, when: Column = F.lit(True)) -> Column:
        return F.when(when, F.array(item(what, F.lit(0), c("m")))).otherwise(F.transform(none, lambda x: item(what, F.lit(0), x)))

    def called(x: Column, i: Column) -> Column:
        made = item("tool_call", i, x)
        return F.when(F.coalesce(F.size(F.try_variant_get(x, "$.result", "array<variant>")), F.lit(0)) > 0, F.array(made, item("tool_result", i, x))).otherwise(F.array(made))

    def listed(path: str) -> Column:
        return F.coalesce(at("m", path, "array<variant>"), none)

    # Only what an event is made of is exploded; its fields are columns of the exploded row, as an array of whole events would be made without generated code.
    answer = F.concat(F.transform(listed("$.thoughts"), lambda x, i: item("reasoning", i, x)), F.flatten(F.transform(listed("$.toolCalls"), called)), itself("message"),
                      itself("token_usage", at("m", "$.tokens.input", "long").isNotNull()))
    items = F.when((c("kind") == "user") & c("identity").try_cast("int").isNull(), itself("user")).when(c("kind") == "info", itself("notification")).when(c("kind") == "gemini", answer)
    b = r.select("path", "raw", "ts", "line_no", "model", "identity", F.posexplode(items).alias("sub_no", "x")).select("*", "x.*").drop("x")
    kind = c("what")
    call, answered, spent, said = kind == "tool_call", kind == "tool_result", kind == "token_usage", kind.isin("user", "notification")
    told = F.when(F.schema_of_variant(at("b", "$.resultDisplay", "variant")) == "STRING", at("b", "$.resultDisplay"))
    fields = {
        "text": F.when(said | (kind == "message"), at("b", "$.content")).when(kind == "reasoning", F.concat(at("b", "$.subject"), F.lit(": "), at("b", "$.description"))),
        "level": F.when(kind == "notification", "info"), "tool_name": F.when(call, at("b", "$.name")), "display_name": F.when(call, at("b", "$.displayName")),
        "provider_call_id": F.when(call | answered, at("b", "$.id")), "arguments": F.when(call, at("b", "$.args")),
        "output": F.when(answered, F.coalesce(told, at("b", "$.result"))), "is_error": F.when(answered, F.coalesce(at("b", "$.status") == "error", F.lit(False))),
        "model": F.when(~said, c("model")),
        **{n: F.when(spent, F.coalesce(at("b", f"$.tokens.{k}", "long"), F.lit(0))) for n, k in (
            ("tok_cached", "cached"), ("tok_uncached", "input"), ("tok_generated", "output"), ("tok_reasoning", "thoughts"), ("tok_tool", "tool"))}}
    suffix = F.create_map(*[F.lit(x) for x in ("tool_call", "call", "tool_result", "result", "token_usage", "usage", "notification", "notify")])
    e = F.struct(kind.alias("type"), F.coalesce(F.try_element_at(suffix, kind), kind).alias("suffix"), *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()])
    part = F.when(kind == "reasoning", "-thought-").when(call | answered, "-tool-")
    base = F.when(part.isNotNull(), F.concat("identity", part, c("i").cast("string"))).otherwise(c("identity"))
    rows = b.select("path", "raw", "ts", F.lit("main").alias("stream"), "line_no", c("sub_no").cast("long").alias("sub_no"), base.alias("base_id"), e.alias("e"))  # one path a document
    return _finish(rows, "gemini", F.lit("unknown-session"))


# --- tools ---------------------------------------------------------------------------------------------------------

def with_tool_columns(rows: DataFrame, schemas: tuple[S.ToolSchema, ...] = S.SCHEMAS) -> DataFrame:
    """file_path, command, pattern, server and tool of another server, variant (by ``schemas``), kinds and origin of tool calls."""
    arg = F.when(F.col("type") == "tool_call", F.try_parse_json("arguments"))
    rows = rows.withColumn("_a", arg)
    name, provider = F.col("tool_name"), F.col("provider")
    listed = at("_a", "$.command", "array<string>")
    command = F.coalesce(F.array_join(listed, " "), at("_a", "$.command"), at("_a", "$.cmd"))
    path = F.coalesce(at("_a", "$.file_path"), at("_a", "$.path"), at("_a", "$.uri"))
    pattern = F.coalesce(at("_a", "$.pattern"), at("_a", "$.query"), at("_a", "$.input"), at("_a", "$.url"))
    shell = (provider == "codex") & name.isin("shell", "shell_command")
    patched = X.patch_header(F.coalesce(at("_a", "$.raw"), at("_a", "$.input"), F.lit("")))
    server, tool = T.mcp_name(name)
    display = F.regexp_extract(F.coalesce("display_name", F.lit("")), r"\(([^()]*) MCP Server\)", 1)
    rows = rows.withColumns({"command": command, "file_path": F.coalesce(path, patched[1]), "pattern": pattern,
                             "mcp_server": F.coalesce(server, F.nullif(display, F.lit(""))), "mcp_tool": F.coalesce(tool, F.when(display != "", name))})
    rows = rows.withColumn("_intent", T.shell_intent(F.col("command")))
    intent = F.col("_intent")
    rows = rows.withColumns({"file_path": F.when(shell & intent.isNotNull(), T.file_path_of(F.col("command"))).otherwise(F.col("file_path")),
                             "pattern": F.when(shell & (intent == "search"), T.search_pattern_of(F.col("command"))).otherwise(F.col("pattern"))})
    rows = rows.join(F.broadcast(S.schema_table(rows.sparkSession, schemas)), ["provider", "tool_name"], "left")  # a row a tool, as listed
    listed = F.col("schema_variant")
    variant = (F.when(S.fits(F.col("_a"), F.col("takes")), F.when((provider == "codex") & (name == "apply_patch"), F.when(patched[0] == "Add", "FileWrite").when(patched[0] == "Update", "FileEdit").otherwise("Generic"))
                      .when(shell & (intent == "search"), "Search").when(shell & (intent == "read"), "FileRead").otherwise(listed))
               .when(listed.isNull() & F.col("mcp_server").isNotNull() & S.is_object(F.col("_a")), "Mcp").otherwise("Generic"))
    kinds = {"FileRead": "read", "FileEdit": "write", "FileWrite": "write", "Execute": "execute", "Search": "search"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    rows = rows.withColumn("tool_variant", F.when(name.isNotNull(), variant))
    return rows.withColumns({"tool_kind": F.when(name.isNotNull(), F.coalesce(F.try_element_at(kind, F.col("tool_variant")), F.lit("other"))),
                             "tool_kind_named": F.when(name.isNotNull(), T.classify(provider, name)),
                             "tool_origin": F.when(name.isNotNull(), T.origin_of(name))}).drop("_a", "_intent", "display_name", "schema_variant", "takes")


def normalize_all(spark: SparkSession, claude: list[str] = (), codex: list[str] = (), gemini: list[str] = ()) -> DataFrame:
    """Events of all files of the three formats, in the columns of EVENTS; ready to be assembled."""
    frames = []
    if claude:
        frames.append(claude_events(read_lines(spark, *claude)))
    if codex:
        frames.append(codex_events(read_lines(spark, *codex)))
    if gemini:
        frames.append(gemini_events(read_documents(spark, *gemini)))
    if not frames:
        return spark.createDataFrame([], EVENTS)
    return reduce(DataFrame.unionByName, frames).select(*EVENT_COLUMNS)


#: The columns of normalized events.
EVENTS = ("provider string, raw_session_id string, session_id string, event_id string, parent_id string, ts timestamp, stream string, seq long, type string, text string, level string, "
          "slash_name string, slash_args string, queue_op string, queue_content string, task_id string, leaf_uuid string, tool_name string, tool_variant string, tool_kind string, "
          "tool_kind_named string, tool_origin string, provider_call_id string, arguments string, file_path string, command string, pattern string, mcp_server string, mcp_tool string, "
          "tool_call_id string, output string, is_error boolean, agent_id string, tok_cached long, tok_uncached long, tok_generated long, tok_reasoning long, tok_tool long, model string, "
          "context_limit long, payload_json string, path string, line_no long")
EVENT_COLUMNS = [f.split()[0] for f in EVENTS.split(", ")]


def parse_auto(spark: SparkSession, paths: list[str], provider: str | None = None) -> DataFrame:
    """Events of files whose format their paths tell, or of the format that is named; a path that tells none is an error."""
    held: dict[str, list[str]] = {}
    for path in paths:
        told = provider or next((p for mark, p in PROVIDER_MARKS if mark in path), None)
        if told is None:
            raise ValueError(f"the path doesn't tell a format: {path}")
        held.setdefault(told, []).append(path)
    return normalize_all(spark, held.get("claude_code", ()), held.get("codex", ()), held.get("gemini", ()))


def scan_agent_events(spark: SparkSession, *paths: str, schema: str = EVENTS) -> DataFrame:
    """Normalized events that were written as JSON lines; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(list(paths))


def spawn_events(lines: DataFrame) -> DataFrame:
    """path, spawn_ts, turn_index and step_index of each start of a review in files of the second format.

    A turn context or a user message starts a turn; other events and response items
    are steps of the turn they are in.  A user message that is the first to start
    a turn doesn't begin its steps anew."""
    place = "line_no" if "line_no" in lines.columns else "place"
    v, c = F.try_parse_json("value"), F.col
    r = lines.select("path", place, at(v, "$.type").alias("record"), at(v, "$.payload.type").alias("kind"), parse_ts(at(v, "$.timestamp")).alias("ts")).where(
        c("record").isin("turn_context", "event_msg", "response_item"))
    told = c("record") == "event_msg"
    starts, spawns = (c("record") == "turn_context") | (told & (c("kind") == "user_message")), F.coalesce(told & (c("kind") == "entered_review_mode"), F.lit(False))
    r = r.withColumns({"_starts": F.coalesce(starts, F.lit(False)), "_spawns": spawns})
    order = W.partitionBy("path").orderBy(place)
    r = r.withColumns({"_k": F.sum(c("_starts").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)),
                       "_said": F.first(F.when(c("_starts"), c("record")), True).over(order.rowsBetween(W.unboundedPreceding, 0))})
    group = F.when((c("_said") == "event_msg") & (c("_k") <= 1), 0).otherwise(c("_k"))
    counts = c("_spawns") | (~c("_starts") & (c("_k") > 0))
    within = W.partitionBy("path", "_group").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumn("_group", group).withColumn("step_index", F.coalesce(F.sum(counts.cast("int")).over(within), F.lit(0)).cast("int"))
    return r.where("_spawns").select("path", c("ts").alias("spawn_ts"), F.greatest(F.lit(0), c("_k") - 1).cast("int").alias("turn_index"), "step_index")
