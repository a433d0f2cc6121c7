"""Filters, search, listings, paging and export over events and assembled tables."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .analyze import is_compacted
from .assemble import CONTINUED, KEYS, Assembled, between_ms, user_text_of

# Names under which event types can be asked for.
ALIASES = {"user": ["user"], "assistant": ["message"], "message": ["message"], "tool": ["tool_call", "tool_result"], "reasoning": ["reasoning"],
           "token": ["token_usage"], "tokenusage": ["token_usage"], "notification": ["notification"], "info": ["notification"],
           "slashcommand": ["slash_command"], "command": ["slash_command"], "queueoperation": ["queue_operation"], "queue": ["queue_operation"], "summary": ["summary"]}
# Words of messages that training exports leave out, and the bounds of exported texts.
APOLOGIES = "i apologize|my mistake|sorry"
EXPORT_BYTES, EXPORT_CHARS, EXPORT_MARK = 5000, 1000, "...<truncated_output_for_training>"
PAGE, MAX_PAGE, PREVIEW = 20, 50, 200


def _types(names: list[str]) -> list[str]:
    return [t for n in names for t in ALIASES.get(n.lower(), [])]


def filter_event_types(events: DataFrame, only: list[str] | None = None, hide: list[str] | None = None) -> DataFrame:
    """Events of the types in ``only`` (all if None) but none of ``hide``; names may be aliases in any case."""
    if only is not None:
        events = events.where(F.col("type").isin(_types(only)))
    return events.where(~F.col("type").isin(_types(hide))) if hide else events


def filter_event_type(events: DataFrame, kind: str) -> DataFrame:
    """Events of exactly one type; its name in any case."""
    return events.where(F.col("type") == kind.lower())


def filter_display(events: DataFrame) -> DataFrame:
    """What a viewer shows at first: the main stream."""
    return events.where(F.col("stream") == "main")


def filter_tool_name(events: DataFrame, name: str, ignore_case: bool = True) -> DataFrame:
    """Calls of a tool."""
    tool = F.lower("tool_name") == name.lower() if ignore_case else F.col("tool_name") == name
    return events.where((F.col("type") == "tool_call") & tool)


def count_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("n"))


def top_tools(events: DataFrame, k: int = 5) -> DataFrame:
    """The k tools that are called most."""
    return events.where("type = 'tool_call'").groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "tool_name").limit(k)


def most_recent_session(events: DataFrame) -> DataFrame:
    """Each provider's session with the newest event."""
    return events.groupBy("provider").agg(F.max_by("session_id", F.struct("ts", "session_id")).alias("session_id"))


def split_streams(a: Assembled) -> DataFrame:
    """The streams of each session, with their place: main first, then by start."""
    place = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("stream") != "main", "start_time", "stream"))
    return a.sessions.select(*KEYS, place.cast("long").alias("place"))


def join_call_sample(events: DataFrame) -> DataFrame:
    """Each call with the last result that its session has for it."""
    last = events.where("type = 'tool_result'").groupBy("session_id", F.col("tool_call_id").alias("event_id")).agg(F.max_by("output", "seq").alias("sample"))
    return events.where("type = 'tool_call'").select("session_id", "event_id").join(last, ["session_id", "event_id"], "left")


def matches(pattern: str, regex: bool = False, ignore_case: bool = False) -> Column:
    """A predicate on payload_json: a regular expression, a glob if it has ``*`` or ``?``, else a substring."""
    text = F.col("payload_json")
    if regex:
        return text.rlike(("(?i)" if ignore_case else "") + pattern)
    if "*" in pattern or "?" in pattern:
        return text.rlike(("(?i)" if ignore_case else "") + X.glob_pattern(pattern))
    return F.lower(text).contains(pattern.lower()) if ignore_case else text.contains(pattern)


def grep_events(events: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, types: list[str] | None = None,
                tool: str | None = None, limit: int | None = 10) -> DataFrame:
    """Events whose payload matches, in order of session and place; type and tool are tested first."""
    if types:
        events = events.where(F.col("type").isin(_types(types)))
    if tool:
        events = events.where((F.col("type") == "tool_call") & (F.col("tool_name") == tool))
    found = events.where(matches(pattern, regex, ignore_case))
    return found.orderBy("session_id", "seq").limit(limit) if limit else found


def preview() -> Column:
    """What an event says, cut at PREVIEW."""
    said = (F.when(F.col("type") == "tool_call", F.concat("tool_name", F.lit(": "), F.coalesce("file_path", "command", "pattern", F.lit(""))))
            .when(F.col("type") == "tool_result", F.col("output")).when(F.col("type") == "slash_command", F.col("slash_name"))
            .when(F.col("type") == "token_usage", F.concat(F.lit("tokens: in="), (F.col("tok_cached") + F.col("tok_uncached")).cast("string"), F.lit(" out="), F.col("tok_generated").cast("string")))
            .otherwise(F.coalesce("text", F.lit(""))))
    return X.truncate_by_bytes(said, PREVIEW)


def event_location(a: Assembled) -> DataFrame:
    """Each event's place in its session's stream, with its turn and step (null outside turns)."""
    at = F.row_number().over(W.partitionBy(*KEYS).orderBy("seq")) - 1
    return a.placed.withColumn("event_index", at).select(
        *KEYS, "event_id", "event_index", "turn_index", "step_index", "type", "payload_json", "provider", "seq", preview().alias("preview"))


def counted_location(a: Assembled) -> DataFrame:
    """Each event's place in its session, and the main stream's turn and step where that many events are reached when steps are counted up; (0, 0) where none is.

    A step counts its reasoning, its message and two events a tool.  The places
    differ from those of ``event_location``, which are exact; this is for results
    that were made by counting.  Starts of steps and events are put in one order,
    so that a window finds each event's step, without a join on ranges."""
    c = F.col
    order = W.partitionBy("session_id").orderBy("turn_index", "step_index").rowsBetween(W.unboundedPreceding, 0)
    size = c("reasoning").isNotNull().cast("long") + c("message").isNotNull().cast("long") + 2 * c("tool_count")
    steps = (a.steps.where("stream = 'main'").select("session_id", "turn_index", "step_index", size.alias("_size")).where("_size > 0")
             .withColumn("_end", F.sum("_size").over(order)))
    starts = steps.select("session_id", (c("_end") - c("_size")).alias("event_index"), F.struct("turn_index", "step_index", "_end").alias("_step"))
    at = (F.row_number().over(W.partitionBy("session_id").orderBy("seq")) - 1).cast("long")
    events = a.events.select("session_id", "stream", "event_id", at.alias("event_index"), "type", "payload_json", "provider", "seq", preview().alias("preview"))
    upto = W.partitionBy("session_id").orderBy("event_index", c("_step").isNull()).rowsBetween(W.unboundedPreceding, 0)
    both = events.unionByName(starts, allowMissingColumns=True).withColumn("_step", F.last("_step", True).over(upto)).where("event_id is not null")
    inside = c("event_index") < c("_step._end")
    return both.select(*KEYS, "event_id", "event_index", *[F.coalesce(F.when(inside, c(f"_step.{k}")), F.lit(0)).cast("int").alias(k) for k in ("turn_index", "step_index")],
                       "type", "payload_json", "provider", "seq", "preview")


def cursor(offset: int) -> str:
    return base64.b64encode(json.dumps({"offset": offset}, separators=(",", ":")).encode()).decode()


def offset_of(page: str | None) -> int:
    """The offset that a cursor tells; 0 for none or one that can't be read."""
    try:
        return max(0, int(json.loads(base64.b64decode(page or ""))["offset"]))
    except (ValueError, KeyError, TypeError):
        return 0


def page_of(rows: DataFrame, order: list, size: int = PAGE, page: str | None = None) -> DataFrame:
    """One page in a total order, with the cursor of the next one (null on the last)."""
    size, start = min(size, MAX_PAGE), offset_of(page)
    got = rows.orderBy(*order).offset(start).limit(size + 1)
    n = F.row_number().over(W.orderBy(*order))
    more = F.count(F.lit(1)).over(W.partitionBy()) > size
    return got.withColumn("_n", n).withColumn("next_cursor", F.when(more, F.lit(cursor(start + size)))).where(F.col("_n") <= size).drop("_n")


def search_events(a: Assembled, text: str, provider: str | None = None, types: list[str] | None = None, size: int = PAGE, page: str | None = None,
                  session: str | None = None, sessions: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """A page of events whose payload holds a text, with their places and previews; of one session, or of those in ``sessions`` (a project's, say).

    ``compat`` gives the places of ``counted_location``, in the order of these."""
    found = (counted_location(a) if compat else event_location(a)).where(F.col("payload_json").contains(text))
    if session:
        found = found.where(F.col("session_id") == session)
    if sessions is not None:
        found = found.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    if provider:
        found = found.where(F.col("provider") == provider)
    if types:
        found = found.where(F.col("type").isin(_types(types)))
    return page_of(found.select("session_id", "stream", "event_index", "turn_index", "step_index", "type", "preview"),
                   ["session_id", *([] if compat else ["stream"]), "event_index"], size, page)


def list_turns(a: Assembled) -> DataFrame:
    """Turns with a short text, status, counts, tokens and tools used (name=count, sorted)."""
    used = F.transform(F.array_distinct("tool_names"), lambda n: F.concat(n, F.lit("="), F.size(F.filter("tool_names", lambda x: x == n)).cast("string")))
    return a.turns.select(
        *KEYS, "turn_index", X.truncate_marked(F.col("user_text"), 100).alias("user_text"), F.when(F.col("failed") > 0, "failed").otherwise("completed").alias("status"),
        "step_count", "duration_ms", "total_tokens", F.array_join(F.array_sort(used), ",").alias("tools_used"))


def get_turns(a: Assembled, turns: list[int], chars: int = 3000, steps: int = 30, session: str | None = None) -> DataFrame:
    """The steps of the chosen turns of the main streams, texts and step numbers cut.

    For one ``session`` an index that it doesn't have is an error; over all sessions it gives no row."""
    rows = a.steps.where(F.col("stream") == "main")
    if session is not None:
        rows = rows.where(F.col("session_id") == session)
        n = rows.agg(F.coalesce(F.max("turn_index") + 1, F.lit(0))).first()[0]
        if out := [t for t in turns if not 0 <= t < n]:
            raise IndexError(f"session {session} has {n} turns, not {out}")
    return rows.where(F.col("turn_index").isin(turns) & (F.col("step_index") < steps)).select(
        "session_id", "turn_index", "step_index", X.truncate_marked(F.col("reasoning"), chars).alias("reasoning"),
        X.truncate_marked(F.col("message"), chars).alias("message"), "status", "tool_count", "tokens")


def export_clean(events: DataFrame) -> DataFrame:
    """Events for training: without failed results and what follows them up to the next good one, and without apologies; long texts cut."""
    order = W.partitionBy(*KEYS).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    skip = F.coalesce(F.last(F.when(F.col("type") == "tool_result", F.col("is_error")), True).over(order), F.lit(False))
    sorry = (F.col("type") == "message") & F.lower("text").rlike(APOLOGIES)
    cut = {c: F.when(F.octet_length(c) > EXPORT_BYTES, F.concat(F.substring(c, 1, EXPORT_CHARS), F.lit(EXPORT_MARK))).otherwise(F.col(c)) for c in ("text", "output")}
    return events.withColumn("_skip", skip).where(~F.col("_skip") & ~F.coalesce(sorry, F.lit(False))).drop("_skip").withColumns(cut)


def export_reasoning(events: DataFrame) -> DataFrame:
    """Reasoning, and tool calls right after one."""
    before = F.lag("type").over(W.partitionBy(*KEYS).orderBy("seq"))
    return events.withColumn("_b", before).where("type = 'reasoning' or (type = 'tool_call' and _b = 'reasoning')").drop("_b")


def as_text(events: DataFrame, *keep: str) -> DataFrame:
    """A ``value`` column with each event in readable lines, and the columns to keep."""
    body = (F.when(F.col("type") == "tool_call", F.concat_ws(" ", "tool_name", "file_path", "command", "pattern")).when(F.col("type") == "tool_result", F.col("output"))
            .when(F.col("type") == "token_usage", F.concat(F.lit("in "), (F.col("tok_cached") + F.col("tok_uncached")).cast("string"), F.lit(" out "), F.col("tok_generated").cast("string")))
            .when(F.col("type") == "slash_command", F.col("slash_name")).otherwise(F.coalesce("text", F.lit(""))))
    head = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.col("type"))
    return events.select(*keep, F.concat_ws("\n", head, body, F.lit("")).alias("value"))


def export_raw(events: DataFrame) -> DataFrame:
    """All events as they are."""
    return events


EXPORTS = {"raw": export_raw, "clean": export_clean, "reasoning": export_reasoning}


def as_jsonl(events: DataFrame, *keep: str) -> DataFrame:
    """A ``value`` column with each event as one line of JSON, and the columns to keep."""
    return events.select(*keep, F.to_json(F.struct(*events.columns)).alias("value"))


def export_session(events: DataFrame, folder: str, strategy: str = "raw", form: str = "jsonl") -> None:
    """Write the events of each session that a strategy keeps into a folder of its own, as JSON lines or as text, in order.

    A session's events are one sorted run of rows; many sessions are written side by side."""
    kept = EXPORTS[strategy](events)
    lines = (as_jsonl if form == "jsonl" else as_text)(kept, "session_id", "seq")
    lines.repartition("session_id").sortWithinPartitions("session_id", "seq").select("session_id", "value").write.partitionBy("session_id").text(folder)


def event_view(events: DataFrame) -> DataFrame:
    """Events flattened for display: what each says, with its details beside it."""
    c, kind = F.col, F.col("type")
    usage, cached = kind == "token_usage", F.when(kind == "token_usage", F.col("tok_cached"))
    total_in, total_out = c("tok_cached") + c("tok_uncached"), c("tok_generated") + c("tok_reasoning") + c("tok_tool")
    return events.select(
        "event_id", "session_id", "ts", "stream", "type", F.coalesce(F.when(kind == "tool_result", c("output")), F.when(kind == "slash_command", c("slash_name")), F.when(kind == "tool_call", c("tool_name")), c("text")).alias("said"),
        F.when(kind == "tool_result", c("is_error")).alias("is_error"), F.when(usage, total_in).alias("input"), F.when(usage, total_out).alias("output"),
        F.when(usage, total_in + total_out).alias("total"), cached.alias("cache_read"))


def children_by_turn(a: Assembled) -> DataFrame:
    """The child streams that each turn of a main stream spawned, joined by commas."""
    return a.turns.where("stream = 'main'").select("session_id", "turn_index").join(_children(a), ["session_id", "turn_index"], "left").withColumn("children", F.coalesce("children", F.lit("")))


def _children(a: Assembled) -> DataFrame:
    """Those turns that spawned a child stream."""
    kids = join_sidechain_spawn(a).where("spawned_turn is not null").groupBy("session_id", F.col("spawned_turn").alias("turn_index"))
    return kids.agg(F.array_join(F.array_sort(F.collect_list("stream")), ",").alias("children"))


def streams_by_spawn(a: Assembled) -> DataFrame:
    """The child streams of each session, with their place by the turn and step that spawned them."""
    order = W.partitionBy("session_id").orderBy(F.asc_nulls_last("spawned_turn"), F.asc_nulls_last("spawned_step"), "stream")
    return join_sidechain_spawn(a).select(*KEYS, F.row_number().over(order).cast("long").alias("place"))


def session_view(a: Assembled, max_context: int = 200_000, session: str | None = None) -> DataFrame:
    """The full report of sessions, a row a step: stream (main first), header, turn with its totals and children, and the step's reasoning, tools and message.

    A stream lasts from its first turn to its last step; runs of three or more equal
    tools in a step are told once, with their number.  All but the children comes
    out of the steps, by windows of their partitioning."""
    c = F.col
    if session is not None:
        a = type(a)(**{name: frame.where(c("session_id") == session) for name, frame in vars(a).items()})
    stream, turn = W.partitionBy(*KEYS), W.partitionBy(*KEYS, "turn_index")
    upto = stream.orderBy("turn_index").rangeBetween(W.unboundedPreceding, 0)
    steps = a.steps.withColumns({
        "session_ms": between_ms(F.min("turn_ts").over(stream), F.max("step_ts").over(stream)), "is_active": c("turn_index") == F.max("turn_index").over(stream),
        "user_text": user_text_of(lambda t: F.max(t).over(turn)), "_end": F.max_by("tokens", F.when(c("usages") > 0, c("step_index"))).over(turn)})
    ends = steps.withColumns({"cumulative_total": F.coalesce(F.last("_end", True).over(upto), F.lit(0)),
                              "_before": F.coalesce(F.last("_end", True).over(upto.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))})
    compacted = is_compacted(c("user_text").startswith(CONTINUED), c("_before"), c("cumulative_total"))
    delta = F.when(compacted, c("cumulative_total")).otherwise(F.greatest(F.lit(0), c("cumulative_total") - c("_before")))
    kids = _children(a).withColumn("stream", F.lit("main"))
    places = W.partitionBy("session_id").orderBy(c("stream") != "main", "stream")
    return (ends.join(kids, [*KEYS, "turn_index"], "left").withColumn("stream_place", F.dense_rank().over(places)).select(
        *KEYS, "stream_place", "session_ms", "turn_index", X.truncate_marked(c("user_text"), 100).alias("user_text"), delta.cast("long").alias("delta"), c("cumulative_total").cast("long").alias("cumulative_total"),
        "is_active", F.coalesce("children", F.lit("")).alias("children"), "step_index", "status", "reasoning", told_runs(c("tool_names")).alias("tools"), "message", "tokens",
        (c("tokens") * 100.0 / max_context).cast("double").alias("context_pct")))


def told_runs(names: Column) -> Column:
    """Names joined by commas, in their order; a run of three or more equal ones is told once, with its number."""
    empty = F.array().cast("array<struct<name:string,n:int>>")

    def add(runs, name):
        same = F.coalesce(F.try_element_at(runs, F.lit(-1))["name"] == name, F.lit(False))
        longer = F.struct(name.alias("name"), (F.try_element_at(runs, F.lit(-1))["n"] + 1).alias("n"))
        return F.when(same, F.array_append(F.slice(runs, F.lit(1), F.size(runs) - 1), longer)).otherwise(F.array_append(runs, F.struct(name.alias("name"), F.lit(1).alias("n"))))

    def tell(run):
        return F.when(run["n"] >= 3, F.concat(run["name"], F.lit(" x"), run["n"].cast("string"))).otherwise(F.array_join(F.array_repeat(run["name"], run["n"]), ", "))

    return F.array_join(F.transform(F.aggregate(names, empty, add), tell), ", ")


def order_sessions(sessions: DataFrame, newest: bool = True) -> list:
    return [F.desc("start_time"), F.asc("session_id")] if newest else [F.asc("start_time"), F.asc("session_id")]


def number_sessions(sessions: DataFrame, newest: bool = True, bucket: str = "hour") -> DataFrame:
    """``sessions`` with their ``place`` in that order, from 1, without one task for all of them.

    Only the buckets of time that hold sessions are summed up in one task; places are counted inside each bucket."""
    order = [*order_sessions(sessions, newest), F.asc("stream")]
    none = F.to_timestamp(F.lit("0001-01-01"))  # sessions without a start are in one bucket, before all others
    rows = sessions.withColumn("_bucket", F.coalesce(F.date_trunc(bucket, "start_time"), none))
    before = W.orderBy(F.desc("_bucket") if newest else F.asc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    return rows.withColumn("_place", inside).join(starts, "_bucket").withColumn("place", (F.col("_start") + F.col("_place")).cast("long")).drop("_bucket", "_place", "_start")


def sessions_between(sessions: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Sessions that started in a span; a bound that can't be read is ignored, a session without start is dropped if a bound holds."""
    for bound, late in ((since, False), (until, True)):
        if bound:
            t = F.try_to_timestamp(F.lit(bound))
            sessions = sessions.where(t.isNull() | ((F.col("start_time") <= t) if late else (F.col("start_time") >= t)))
    return sessions


def recent_events(events: DataFrame, k: int = 50) -> DataFrame:
    """The newest k events of each session."""
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))
    return events.withColumn("recency", back).where(F.col("recency") <= k)


def with_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """The ids of the sessions that are meant: the one that is ``prefix``, else those that start with it."""
    ids = sessions.where(F.col("session_id").startswith(prefix)).select("session_id").distinct()
    exact = ids.where(F.col("session_id") == prefix).agg((F.count(F.lit(1)) > 0).alias("_exact"))  # one row
    return ids.join(F.broadcast(exact)).where((F.col("session_id") == prefix) | ~F.col("_exact")).drop("_exact")


def resolve_prefix(sessions: DataFrame, prefix: str) -> str | None:
    """The session id that is or starts with ``prefix``; None if none does, an error if several do."""
    ids = sessions.select("session_id").distinct()
    if ids.where(F.col("session_id") == prefix).count():
        return prefix
    found = [r[0] for r in ids.where(F.col("session_id").startswith(prefix)).limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"{prefix} is ambiguous")
    return found[0] if found else None


def join_sidechain_spawn(a: Assembled) -> DataFrame:
    """Where each child stream was spawned: turn and step of the last main-stream tool result that names its agent."""
    named = a.steps.where("stream = 'main' and size(agents) > 0").select("session_id", "turn_index", "step_index", F.inline("agents"))
    made = named.groupBy("session_id", "agent_id").agg(F.max_by(F.struct("turn_index", "step_index"), "seq").alias("s"))
    child = a.events.where(F.col("stream").startswith("sidechain:")).select("session_id", "stream").distinct().select("session_id", "stream", F.substring_index("stream", ":", -1).alias("agent_id"))
    return child.join(made, ["session_id", "agent_id"], "left").select(
        "session_id", "stream", F.col("s.turn_index").alias("spawned_turn"), F.col("s.step_index").alias("spawned_step"))


def near_spawn(children: DataFrame, spawns: DataFrame, within_ms: int = 100) -> DataFrame:
    """Each child (child_id, start_ms) with the nearest spawn (parent_id, spawn_ms, ...) at most ``within_ms`` away.

    Spawns go to their bucket of time and both beside it, so that the interval join is an equi-join."""
    bucket = F.floor(F.col("spawn_ms") / within_ms)
    spread = spawns.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    met = children.withColumn("_b", F.floor(F.col("start_ms") / within_ms)).join(spread, "_b").where(F.abs(F.col("start_ms") - F.col("spawn_ms")) <= within_ms)
    best = met.groupBy("child_id").agg(F.min(F.struct(F.abs(F.col("start_ms") - F.col("spawn_ms")).alias("d"), "parent_id", "spawn_ms")).alias("b"))
    return children.join(best, "child_id", "left").select("child_id", "start_ms", F.col("b.parent_id").alias("parent_id"), F.col("b.spawn_ms").alias("spawn_ms"))
