"""Sessions, turns, steps and tool executions out of events, with windows only.

Everything is partitioned by (session_id, stream), so one exchange serves the
windows and all aggregates up to the session.  The order inside a partition is
``seq``.  Tables are levels of one chain: events give steps, steps give turns,
turns give sessions, and each level carries the sums that the next ones need
(columns that a query doesn't ask for are pruned).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

KEYS = ["session_id", "stream"]
# How the texts of an interruption and of a continued session begin.
INTERRUPTED, CONTINUED = "[Request interrupted", "This session is being continued"
CONTENT = ("reasoning", "message", "tool_call", "token_usage")
KINDS = ("read", "write", "execute", "search", "other")


@dataclass
class Assembled:
    """The events, those with their turn and step beside them (null outside turns), those inside turns, and the tables made of them; every frame is lazy."""

    events: DataFrame
    placed: DataFrame
    rows: DataFrame
    tools: DataFrame
    steps: DataFrame
    turns: DataFrame
    sessions: DataFrame

    def store(self, folder: str) -> None:
        """Write all tables below ``folder``, by provider where they have one, for many queries to read."""
        for name, frame in vars(self).items():
            writer = frame.write.mode("overwrite")
            (writer.partitionBy("provider") if "provider" in frame.columns else writer).parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Assembled:
        """The tables that ``store`` has written."""
        return cls(**{name: spark.read.parquet(f"{folder}/{name}") for name in cls.__dataclass_fields__})


def between_ms(a: Column, b: Column) -> Column:
    """Whole milliseconds from a to b."""
    return F.floor((F.unix_micros(b) - F.unix_micros(a)) / 1000).cast("long")


def segment(events: DataFrame) -> DataFrame:
    """All events with turn_index and step_index (null outside turns), ``opens`` (the event that opened the turn) and turn_ts.

    A user event or slash command opens a turn; an interruption closes it; a user
    event right after a slash command without content fills that turn.  Turns
    without content are dropped and take no index.  A step holds at most one
    reasoning and one message: of the reasoning and message events of a turn, one
    of the type of the one before starts a run, and in a run each second one
    opens a step.
    """
    def running(*keys: str, order: tuple = ("seq",)):
        w = W.partitionBy(*KEYS, *keys).orderBy(*order)
        return w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)

    c = F.col
    upto, before = running()
    control = (F.when(c("type") == "slash_command", "S").when((c("type") == "user") & c("text").startswith(INTERRUPTED), "I")
               .when(c("type") == "user", "U"))
    e = events.withColumns({"_ctl": control, "_content": c("type").isin(*CONTENT).cast("int")})
    e = e.withColumns({"_seen": F.sum("_content").over(upto), "_last": F.last("_ctl", True).over(before)})
    e = e.withColumn("_seen_at_slash", F.last(F.when(c("_ctl") == "S", c("_seen")), True).over(before))
    fills = (F.coalesce("_last", F.lit("")) == "S") & (c("_seen") == c("_seen_at_slash"))
    e = e.withColumn("opens", F.coalesce((c("_ctl") == "S") | ((c("_ctl") == "U") & ~fills), F.lit(False)))
    e = e.withColumns({"_turn": F.sum(c("opens").cast("int")).over(upto),
                       "_state": F.last(F.when(c("_ctl") == "I", "I").when(c("opens"), "T"), True).over(upto)})
    live = c("_state").eqNullSafe("T")
    e = e.withColumn("_says", (live & c("type").isin("reasoning", "message")).cast("int"))

    upto, before = running("_turn")
    whole = upto.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = e.withColumns({"_filled": F.sum(F.when(live, c("_content"))).over(whole), "turn_ts": F.min(F.when(c("opens"), c("ts"))).over(whole),
                       "_said": F.last(F.when(c("_says") == 1, c("type")), True).over(before), "_nth": F.sum("_says").over(upto)})
    starts_run = (c("_says") == 1) & F.coalesce(c("_said") == c("type"), F.lit(True))
    e = e.withColumn("_nth_at", F.last(F.when(starts_run, c("_nth")), True).over(upto))
    new_step = (c("_says") == 1) & ((c("_nth") - c("_nth_at")) % 2 == 0) & (c("_nth") > 1)
    in_order, _ = running(order=("_turn", "seq"))  # the order that the rows are in already
    inside = live & (c("_filled") > 0)
    e = e.withColumns({"step_index": F.when(inside, F.sum(new_step.cast("int")).over(upto).cast("int")),
                       "turn_index": F.when(inside, F.sum((c("opens") & (c("_filled") > 0)).cast("int")).over(in_order) - 1).cast("int")})
    return e.drop("_ctl", "_content", "_seen", "_last", "_seen_at_slash", "_turn", "_state", "_filled", "_says", "_said", "_nth", "_nth_at")


def pair_tools(rows: DataFrame) -> DataFrame:
    """Segmented events with its result of the same turn beside each call; ``_call`` marks calls that count.

    A call's id counts once a step; in a later step of the turn it is a new
    execution, which takes the results from there on.  Only the first result of
    an execution is its own."""
    key = F.when(F.col("type") == "tool_call", F.col("event_id")).when(F.col("type") == "tool_result", F.col("tool_call_id"))
    call = F.coalesce((F.col("type") == "tool_call") & F.col("turn_index").isNotNull(), F.lit(False))
    result = (F.col("type") == "tool_result") & F.col("turn_index").isNotNull()
    rows = rows.withColumn("_key", F.when(F.col("turn_index").isNotNull(), key))
    over = W.partitionBy(*KEYS, "turn_index", "_key").orderBy("seq")
    step_before = F.last(F.when(call, F.col("step_index")), True).over(over.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_call", call & ~F.coalesce(step_before == F.col("step_index"), F.lit(False)))
    told = F.struct((F.col("type") == "tool_result").alias("answers"), "event_id", "ts", "output", "is_error", "agent_id")
    rows = rows.withColumn("_event", F.when(F.col("_call") | result, told))
    after = F.expr(f"lead(_event) ignore nulls over (partition by {', '.join(KEYS)}, turn_index, _key order by seq)")
    return rows.withColumn("_next", after).withColumn("result", F.when(F.col("_call") & F.col("_next.answers"), F.col("_next").dropFields("answers"))).drop("_key", "_event", "_next")


#: The kind that a tool's variant has; it can't be plan or ask.
def variant_kind(tool: Column) -> Column:
    return (F.when(tool.isin("Read", "Glob"), "read").when(tool.isin("Edit", "Write"), "write")
            .when(tool.isin("Bash", "KillShell", "BashOutput"), "execute").when(tool.isin("Grep", "WebSearch", "WebFetch"), "search").otherwise("other"))


def tool_kind_of(rows: DataFrame) -> Column:
    """The kind of a tool call: that of its variant where the logs told it, else by name."""
    named = variant_kind(F.col("tool_name"))
    return F.coalesce("tool_kind", named) if "tool_kind" in rows.columns else named


def assemble(events: DataFrame) -> Assembled:
    """Turns, steps, tools and sessions of all sessions and streams in ``events``."""
    every = pair_tools(segment(events))
    rows = every.where("turn_index is not null")
    levels = _steps(every)
    steps = levels.where("turn_index is not null")
    turns = _turns(steps)
    sessions = _sessions(_turns(levels))
    return Assembled(events, segment(events), rows, _tools(rows), steps.drop(*[c for c in steps.columns if c.startswith("_")]),
                     turns.drop(*[c for c in turns.columns if c.startswith("_")]), sessions)


def _tools(rows: DataFrame) -> DataFrame:
    step_keys = [*KEYS, "turn_index", "step_index"]
    return rows.where("_call").select(
        "provider", *step_keys, (F.row_number().over(W.partitionBy(*step_keys).orderBy("seq")) - 1).alias("call_index"),
        F.col("event_id").alias("call_id"), F.col("ts").alias("call_ts"), F.col("seq").alias("call_seq"), "tool_name",
        tool_kind_of(rows).alias("tool_kind"), "file_path", "command", "pattern", "mcp_server", "mcp_tool",
        F.col("result.event_id").alias("result_id"), F.col("result.output").alias("output"),
        between_ms(F.col("ts"), F.col("result.ts")).alias("duration_ms"), F.coalesce("result.is_error", F.lit(False)).alias("is_error"))


def _steps(every: DataFrame) -> DataFrame:
    """One row a step, and one of null indexes a stream for its events outside turns."""
    c = F.col

    def text_of(t: str) -> Column:
        return F.max(F.when(c("type") == t, c("text")))

    call, kind, ms = c("_call"), tool_kind_of(every), between_ms(c("ts"), c("result.ts"))
    content = c("type").isin("message", "tool_call")
    s = every.groupBy("provider", *KEYS, "turn_index", "step_index").agg(
        F.min("turn_ts").alias("turn_ts"), F.min("ts").alias("_first_ts"), F.max("ts").alias("_last_ts"),
        text_of("reasoning").alias("reasoning"), text_of("message").alias("message"),
        F.max(F.when(c("type") == "reasoning", c("event_id"))).alias("_reasoning_id"), F.min_by("event_id", F.when(content, c("seq"))).alias("_content_id"),
        F.count_if(call).alias("tool_count"), F.count_if(call & c("result").isNull()).alias("missing"), F.count_if(call & c("result.is_error")).alias("failed"),
        F.count_if(c("type") == "token_usage").alias("usages"),
        F.coalesce(F.max("tok_uncached"), F.lit(0)).alias("fresh_input"), F.coalesce(F.max("tok_cached"), F.lit(0)).alias("cache_read"),
        F.coalesce(F.max(c("tok_generated") + c("tok_reasoning") + c("tok_tool")), F.lit(0)).alias("output"),
        F.max(F.when(call, ms)).alias("max_tool_ms"), F.collect_list(F.when(call, ms)).alias("_tool_ms"),
        F.collect_list(F.when(call & ms.isNotNull(), F.struct(kind.alias("kind"), ms.alias("ms")))).alias("_timed"),
        *[F.count_if(call & (kind == k)).alias(f"{k}_calls") for k in KINDS],
        F.sort_array(F.collect_list(F.when(call, F.struct("seq", kind.alias("kind"), "tool_name")))).alias("_calls"),
        F.max_by("model", F.when(c("model").isNotNull(), c("seq"))).alias("model"), F.max(F.when(c("model").isNotNull(), c("seq"))).alias("_model_at"),
        F.max(F.when(c("opens"), c("event_id"))).alias("_turn_id"), F.max(F.when(c("opens"), c("slash_name"))).alias("_slash"),
        F.max(F.when(~c("opens") & (c("type") == "user"), c("text"))).alias("filled_text"), F.max(F.when(c("opens"), c("text"))).alias("asked_text"),
        F.collect_list(F.when((c("type") == "tool_result") & c("agent_id").isNotNull(), F.struct("agent_id", "seq"))).alias("agents"))
    status = (F.when(c("failed") > 0, "failed").when(c("missing") > 0, "in_progress").when(c("tool_count") > 0, "done")
              .when(c("message").isNotNull(), "done").when(c("reasoning").isNotNull(), "in_progress").otherwise("done"))
    return s.withColumns({
        "tool_names": F.transform("_calls", lambda x: x["tool_name"]),
        "step_ts": F.when(c("step_index") == 0, c("turn_ts")).otherwise(c("_first_ts")),
        "tokens": c("fresh_input") + c("cache_read") + c("output"), "status": status,
        "step_id": F.coalesce("_reasoning_id", "_content_id", X.uuid5(F.lit(X.NAMESPACE_OID), F.concat_ws(":", *KEYS, "turn_index", "step_index")))})


def user_text_of(most: Callable[[str], Column]) -> Column:
    """What was asked in a turn, of the texts of its steps: that which filled it, else that which opened it."""
    return F.coalesce(most("filled_text"), most("asked_text"), F.lit(""))


def _turns(steps: DataFrame) -> DataFrame:
    c = F.col
    t = steps.groupBy("provider", *KEYS, "turn_index").agg(
        F.min("turn_ts").alias("turn_ts"), F.count(F.lit(1)).alias("step_count"), F.max("step_ts").alias("_last"),
        F.sum("tokens").alias("total_tokens"), F.sum("tool_count").alias("tool_count"), F.sum("failed").alias("failed"), F.sum("missing").alias("missing"),
        F.max_by("tokens", F.when(c("usages") > 0, c("step_index"))).alias("turn_end"), F.max("tool_count").alias("_chain"), F.max("max_tool_ms").alias("max_tool_ms"),
        F.count_if(c("message").isNotNull()).alias("messages"), F.count_if(c("reasoning").isNotNull()).alias("reasonings"), F.count_if(c("usages") > 0).alias("usages"),
        F.bool_or(c("usages") == 0).alias("_waits"), F.count_if(c("tool_count") > 1).alias("parallel_steps"),
        F.sum(F.when(c("tool_count") > 1, c("tool_count")).otherwise(0)).alias("parallel_calls"), *[F.sum(f"{k}_calls").alias(f"{k}_calls") for k in KINDS],
        F.flatten(F.collect_list("_tool_ms")).alias("tool_ms"), F.flatten(F.collect_list("_timed")).alias("timed_calls"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("step_index", "_calls"))), lambda s: s["_calls"])).alias("_calls"),
        F.min("_first_ts").alias("_first_ts"), F.max("_last_ts").alias("_last_ts"),
        F.max_by("model", "_model_at").alias("model"), F.max("_model_at").alias("_model_at"),
        F.max("_turn_id").alias("turn_id"), F.max("_slash").alias("slash_name"), user_text_of(F.max).alias("user_text"))
    return t.withColumns({
        "duration_ms": between_ms(c("turn_ts"), c("_last")), "kinds": F.transform("_calls", lambda x: x["kind"]), "tool_names": F.transform("_calls", lambda x: x["tool_name"]),
        "origin": F.when(c("user_text").startswith(CONTINUED), "context_compaction").otherwise("user")})


#: A turn with more tool calls than this is a sign of a loop.
LOOP_TOOLS = 5


def _sessions(turns: DataFrame) -> DataFrame:
    """One row a stream, with the sums of its turns; ``turns`` has its events outside turns as a row of null index."""
    c, turn = F.col, F.col("turn_index").isNotNull()

    def inside(name: str) -> Column:
        return F.coalesce(F.sum(F.when(turn, c(name))), F.lit(0))

    s = turns.groupBy("provider", *KEYS).agg(
        F.min("_first_ts").alias("start_time"), F.max("_last_ts").alias("end_time"), F.count("turn_index").alias("total_turns"),
        inside("total_tokens").alias("total_tokens"), inside("step_count").alias("steps"), inside("tool_count").alias("tool_calls_total"), inside("failed").alias("tool_failures_total"),
        inside("missing").alias("missing_tool_pairs"), F.max(F.when(turn, c("_chain"))).alias("longest_chain"),
        F.greatest(F.max(F.when(turn, c("duration_ms"))), F.lit(0)).alias("max_e2e_ms"), F.greatest(F.max("max_tool_ms"), F.lit(0)).alias("max_tool_ms"),
        F.count_if(turn & (c("tool_count") > LOOP_TOOLS)).alias("loop_signals"), inside("messages").alias("messages"), inside("reasonings").alias("reasonings"), inside("usages").alias("usages"),
        inside("parallel_steps").alias("parallel_steps"), inside("parallel_calls").alias("parallel_calls"), *[inside(f"{k}_calls").alias(f"{k}_calls") for k in KINDS],
        F.coalesce(F.max_by("turn_end", F.when(turn & c("turn_end").isNotNull(), c("turn_index"))), F.lit(0)).alias("used"),
        F.max_by("model", "_model_at").alias("model"), F.max("turn_index").alias("last_turn"), F.max_by("_waits", "turn_index").alias("last_waits"),
        F.min_by("user_text", F.when(turn, c("turn_index"))).alias("first_text"),
        F.max_by(F.struct("user_text", "tool_count"), F.when(turn, F.struct("tool_count", "turn_index"))).alias("busiest"))
    return s.withColumn("duration_seconds", F.floor((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1_000_000).cast("long"))
