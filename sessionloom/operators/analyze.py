"""Metrics, diagnostics and statistics over assembled sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tools as T
from .assemble import KEYS, Assembled, between_ms

# What counts as slow or heavy; the texts and severities of insights are fixed, too.
SLOW_TOOL_MS, HEAVY_DEFAULT = 10_000, 15_000


def zero_div(a, b, factor: float = 1.0):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b * factor)


def session_metrics(a: Assembled) -> DataFrame:
    """Tool calls, failures, missing results, longest tool and turn, turns with many tools and longest chain of each session with a turn."""
    return a.sessions.where("total_turns > 0").select(
        "provider", *KEYS, "tool_calls_total", "tool_failures_total", "missing_tool_pairs", "longest_chain", "max_e2e_ms", "loop_signals", "max_tool_ms")


def is_compacted(said: Column, before: Column, total: Column) -> Column:
    """Whether a turn's context was made smaller: its text says so, or its total is under half of the one before."""
    return said | ((before > 0) & (total < F.floor(before / 2)))


def turn_metrics(a: Assembled, max_context: int | None = None) -> DataFrame:
    """Running token totals of each turn, with compactions of the context."""
    order = W.partitionBy(*KEYS).orderBy("turn_index")
    end = F.coalesce(F.last("turn_end", True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    t = a.turns.withColumn("cumulative_total", end).withColumn("_before", F.coalesce(F.lag("cumulative_total").over(order), F.lit(0)))
    compacted = is_compacted(F.col("origin") == "context_compaction", F.col("_before"), F.col("cumulative_total"))
    delta = F.when(compacted, F.col("cumulative_total")).otherwise(F.greatest(F.lit(0), F.col("cumulative_total") - F.col("_before")))
    heavy = delta >= (max_context // 10 if max_context else HEAVY_DEFAULT)
    return t.select(*KEYS, "turn_index", F.when(compacted, 0).otherwise(F.col("_before")).cast("long").alias("prev_total"), delta.cast("long").alias("delta"),
                    heavy.alias("is_heavy"), (F.lead("turn_index").over(order).isNull()).alias("is_active"), compacted.alias("context_compacted"),
                    F.col("cumulative_total").cast("long").alias("cumulative_total"), F.when(compacted, F.col("_before")).cast("long").alias("compaction_from"))


def summarize(a: Assembled) -> DataFrame:
    """Counts of user turns, messages, reasoning, tool calls and all events inside turns, for each session."""
    c = F.col
    return a.sessions.where("total_turns > 0").select(
        *KEYS, c("total_turns").alias("user_messages"), c("messages").alias("assistant_messages"), c("tool_calls_total").alias("tool_calls"), c("reasonings").alias("reasoning_blocks"),
        (c("total_turns") + c("messages") + c("reasonings") + 2 * c("tool_calls_total") + c("usages")).alias("total"))


def with_loops(turns: DataFrame) -> DataFrame:
    """``turns`` with ``loops``: whether its kinds of tools repeat those of the turn before for the second time or more."""
    order = W.partitionBy(*KEYS).orderBy("turn_index")
    kinds = F.when(F.size("kinds") > 0, F.array_join("kinds", ","))
    t = turns.withColumn("_kinds", kinds)
    t = t.withColumn("_new", (~F.coalesce(F.lag("_kinds").over(order) == F.col("_kinds"), F.lit(False))).cast("int"))
    since = F.last(F.when(F.col("_new") == 1, F.col("turn_index")), True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return t.withColumn("loops", F.col("turn_index") - since >= 2).drop("_kinds", "_new")


def _insight(diagnostic: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(diagnostic).alias("diagnostic"), F.lit(severity).alias("severity"), message.alias("message"))


def _slow(x: Column) -> Column:
    return F.concat(F.lit("Slow tool execution ("), F.initcap(x["kind"]), F.lit(" took "), F.floor(x["ms"] / 1000).cast("string"), F.lit("s)"))


def insights(a: Assembled, checks=("failures", "loops", "bottlenecks"), slow_ms: int = SLOW_TOOL_MS) -> DataFrame:
    """What the checks find, a row each: turns with failed calls, turns whose kinds of tools repeat those of the turn before for the second time or more, and slow calls.

    All checks look at one row of a turn, so that the events are read and put in order once."""
    c = F.col

    def once(when: Column, found: Column) -> Column:
        return F.filter(F.array(found), lambda x: F.coalesce(when, F.lit(False)))

    found = {"failures": lambda: once(c("failed") > 0, _insight("failures", "critical", F.format_string("%d tool execution(s) failed", "failed"))),
             "loops": lambda: once(c("loops"), _insight("loops", "warning", F.lit("Repeated tool sequence detected"))),
             "bottlenecks": lambda: F.transform(F.filter("timed_calls", lambda x: x["ms"] > slow_ms), lambda x: _insight("bottlenecks", "warning", _slow(x)))}
    turns = with_loops(a.turns) if "loops" in checks else a.turns
    return turns.select(*KEYS, "turn_index", F.explode(F.concat(*[found[name]() for name in checks])).alias("_i")).select(*KEYS, "turn_index", "_i.*")


def analyze_failures(a: Assembled) -> DataFrame:
    return insights(a, ("failures",))


def analyze_loops(a: Assembled) -> DataFrame:
    """Turns whose kinds of tools repeat those of the turn before for the second time or more."""
    return insights(a, ("loops",))


def analyze_bottlenecks(a: Assembled, slow_ms: int = SLOW_TOOL_MS) -> DataFrame:
    return insights(a, ("bottlenecks",), slow_ms)


def analysis_report(a: Assembled, checks=("failures",), slow_ms: int = SLOW_TOOL_MS) -> DataFrame:
    """Summary, insights and health score (100 less 10 for each, 0 at least) of each session with a turn; insights are counted turn by turn."""
    c = F.col
    found = {"failures": (c("failed") > 0).cast("int"), "loops": c("loops").cast("int"), "bottlenecks": F.size(F.filter("tool_ms", lambda ms: ms > slow_ms))}
    turns = with_loops(a.turns) if "loops" in checks else a.turns
    total = sum((F.sum(found[name]) for name in checks), F.lit(0)).cast("long")
    s = turns.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("user_messages"), F.sum("messages").alias("assistant_messages"), F.sum("tool_count").alias("tool_calls"), F.sum("reasonings").alias("reasoning_blocks"),
        (F.count(F.lit(1)) + F.sum("messages") + F.sum("reasonings") + 2 * F.sum("tool_count") + F.sum("usages")).alias("total"), total.alias("insights"))
    return s.withColumn("score", F.greatest(F.lit(0), 100 - 10 * F.col("insights")))


def tool_usage(a: Assembled) -> DataFrame:
    """Calls of each tool by provider, with its origin and kind by name and the first call as a sample."""
    sample = F.min(F.struct("session_id", "call_seq", "call_id", F.coalesce("output", F.lit("")).alias("output")))
    return a.tools.groupBy("provider", "tool_name").agg(F.count(F.lit(1)).alias("calls"), sample.alias("_s")).select(
        "provider", "tool_name", "calls", T.origin_of(F.col("tool_name")).alias("origin"), T.classify(F.col("provider"), F.col("tool_name")).alias("kind"),
        F.col("_s.call_id").alias("sample_call"), F.col("_s.output").alias("sample_output"))


def tool_call_stats(a: Assembled, k: int = 5) -> DataFrame:
    """The k most frequent values of each dimension of tool calls, by provider, in one pass."""
    t = a.tools.withColumn("first_word", F.when(F.col("command").isNotNull(), T.first_word(F.col("command"))))
    t = t.withColumn("tool_command", F.concat("tool_name", F.lit(": "), "command"))
    dims = ["tool_kind", "tool_name", "command", "tool_command", "first_word", "file_path", "mcp_server", "mcp_tool"]
    long = t.select("provider", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])).alias("x")).select("provider", "x.*")
    counts = long.where("value is not null").groupBy("provider", "dimension", "value").agg(F.count(F.lit(1)).alias("calls"))
    top = W.partitionBy("provider", "dimension").orderBy(F.desc("calls"), "value")
    return counts.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def distinct_commands(a: Assembled) -> DataFrame:
    return a.tools.where("command is not null").groupBy("provider", "tool_name").agg(F.count_distinct("command").alias("commands"))


def tool_entropy(a: Assembled) -> DataFrame:
    """Shannon entropy, in bits, of the tools' names of each provider."""
    n = a.tools.groupBy("provider", "tool_name").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("provider"))
    return n.withColumn("p", p).groupBy("provider").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def provider_efficiency(a: Assembled) -> DataFrame:
    """Counts and ratios of each provider's sessions with a turn; a ratio is 0 where its base is."""
    names = ("read", "write", "execute", "search", "other")
    sums = {"turns": "total_turns", "tokens": "total_tokens", "steps": "steps", "parallel_steps": "parallel_steps", "parallel_calls": "parallel_calls", "calls": "tool_calls_total",
            "errors": "tool_failures_total", **{f"{k}_calls": f"{k}_calls" for k in names}}
    j = a.sessions.where("total_turns > 0").groupBy("provider").agg(F.count(F.lit(1)).alias("sessions"), *[F.sum(v).alias(k) for k, v in sums.items()])
    c = F.col
    rwe = c("read_calls") + c("write_calls") + c("execute_calls")
    return j.withColumns({
        "tools_per_session": zero_div(c("calls"), c("sessions")), "parallelization_rate": zero_div(c("parallel_steps"), c("steps"), 100.0),
        "parallel_calls_ratio": zero_div(c("parallel_calls"), c("calls"), 100.0), "error_rate": zero_div(c("errors"), c("calls"), 100.0),
        "tokens_per_session": zero_div(c("tokens"), c("sessions")), "tokens_per_tool": zero_div(c("tokens"), c("calls")),
        "read_share": zero_div(c("read_calls"), rwe, 100.0), "write_share": zero_div(c("write_calls"), rwe, 100.0), "execute_share": zero_div(c("execute_calls"), rwe, 100.0)})


def execute_breakdown(a: Assembled) -> DataFrame:
    """Intents of shell commands by provider: calls, share in percent, and the first three commands in order as examples."""
    n = a.tools.where("command is not null").groupBy("provider", "command").agg(F.count(F.lit(1)).alias("n")).withColumn("intent", T.execute_intent(F.col("command")))
    rank = F.row_number().over(W.partitionBy("provider", "intent").orderBy("command"))  # over distinct commands; each task keeps three first
    three = n.withColumn("_r", rank).where("_r <= 3").groupBy("provider", "intent").agg(F.array_join(F.array_sort(F.collect_list("command")), " | ").alias("examples"))
    calls = n.groupBy("provider", "intent").agg(F.sum("n").alias("calls"))
    return calls.join(three, ["provider", "intent"]).withColumn(
        "share", F.col("calls") * F.lit(100.0).cast("double") / F.sum("calls").over(W.partitionBy("provider")))


def corpus_stats(a: Assembled, newest: int = 100) -> DataFrame:
    """Totals over the newest main sessions."""
    top = a.sessions.where("stream = 'main'").orderBy(F.desc("start_time"), "session_id").limit(newest)
    return top.agg(F.count(F.lit(1)).alias("sample_size"), F.coalesce(F.sum("tool_calls_total"), F.lit(0)).alias("total_tool_calls"),
                   F.coalesce(F.sum("tool_failures_total"), F.lit(0)).alias("total_failures"), F.coalesce(F.max("max_e2e_ms"), F.lit(0)).alias("max_e2e_ms"))


def level_of(ratio: Column) -> Column:
    return F.when(ratio > 0.9, "error").when(ratio > 0.8, "warning").otherwise("success")


def context_usage(a: Assembled) -> DataFrame:
    """The last turn's tokens of each main session against its model's limits, with ratio, level and what is left."""
    last = a.sessions.where("total_turns > 0 and stream = 'main'").select(*KEYS, "used", "model", "start_time", "end_time")
    j = T.join_model_limit(last)
    limit = T.effective_limit(F.col("max_tokens"), F.col("buffer_pct"))
    ratio = F.when(F.coalesce("effective", F.lit(0)) == 0, 0.0).otherwise(F.col("used") / F.col("effective").cast("double"))
    j = j.withColumn("effective", limit).withColumn("ratio", ratio)
    return j.select(*KEYS, "model", "used", "max_tokens", "effective", "ratio",
                    F.when(F.col("effective").isNotNull(), F.greatest(F.lit(0), F.col("effective") - F.col("used"))).alias("remaining"),
                    level_of(F.col("ratio")).alias("level"), (F.col("used") * 100.0 / F.col("max_tokens")).alias("used_pct"), between_ms(F.col("start_time"), F.col("end_time")).alias("elapsed_ms"))


def _told_limits(a: Assembled) -> DataFrame:
    """The last context limit that each stream's events tell."""
    c = F.col
    return a.events.groupBy(*KEYS).agg(F.max_by("context_limit", F.when(c("context_limit").isNotNull(), c("seq"))).alias("_told"))


def dashboard(a: Assembled) -> DataFrame:
    """Elapsed time, tokens and limit of each main session: the limit that its logs tell (``context_limit``), else what its model's leaves; with ratio and level."""
    u, c = context_usage(a), F.col
    if "context_limit" in a.events.columns:
        u = u.join(_told_limits(a), KEYS, "left").withColumn("effective", F.coalesce("_told", "effective"))
    ratio = F.when(c("effective") > 0, c("used") / c("effective").cast("double"))
    return u.withColumn("ratio", ratio).select("session_id", "elapsed_ms", "used", c("effective").alias("limit"), "ratio", F.coalesce(ratio >= 1, F.lit(False)).alias("exceeded"),
                                               level_of(F.coalesce("ratio", F.lit(0.0))).alias("level"))


def usage_percent(a: Assembled) -> DataFrame:
    """What share of its limit the last usage of each main session fills: input, output and both, in percent; null without a limit.

    The limit is the one that the session's logs tell (``context_limit``), else its model's whole one."""
    c = F.col
    last = a.steps.where("stream = 'main' and usages > 0").groupBy(*KEYS).agg(
        F.max_by(F.struct((c("fresh_input") + c("cache_read")).alias("i"), c("output").alias("o")), F.struct("turn_index", "step_index")).alias("_u"))
    j = T.join_model_limit(last.join(a.sessions.select(*KEYS, "model"), KEYS))
    if "context_limit" in a.events.columns:
        j = j.join(_told_limits(a), KEYS, "left").withColumn("max_tokens", F.coalesce("_told", "max_tokens"))
    share = {"input_pct": c("_u.i"), "output_pct": c("_u.o"), "total_pct": c("_u.i") + c("_u.o")}
    return j.select(*KEYS, "model", "max_tokens", *[(v.cast("double") * 100 / c("max_tokens")).alias(k) for k, v in share.items()])


def is_turn_active(a: Assembled) -> DataFrame:
    """Whether one of a turn's last three steps is in progress."""
    back = F.row_number().over(W.partitionBy(*KEYS, "turn_index").orderBy(F.desc("step_index")))
    return a.steps.withColumn("_back", back).where("_back <= 3").groupBy(*KEYS, "turn_index").agg(F.bool_or(F.col("status") == "in_progress").alias("active"))


def group_consecutive_tools(a: Assembled, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more equal tools in a step."""
    order = W.partitionBy(*KEYS, "turn_index", "step_index").orderBy("call_index")
    new = (~F.coalesce(F.lag("tool_name").over(order) == F.col("tool_name"), F.lit(False))).cast("int")
    t = a.tools.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return t.groupBy(*KEYS, "turn_index", "step_index", "run", "tool_name").agg(
        F.count(F.lit(1)).alias("calls"), F.bool_or("is_error").alias("has_errors"), F.min_by("call_id", "call_index").alias("sample_call")).where(F.col("calls") >= least)


def turn_token_breakdown(a: Assembled, max_context: int = 200_000) -> DataFrame:
    """Input, output and cached tokens of each turn, and what share of the context they fill."""
    return a.steps.groupBy(*KEYS, "turn_index").agg(
        F.sum("fresh_input").alias("input_tokens"), F.sum("output").alias("output_tokens"), F.nullif(F.sum("cache_read"), F.lit(0)).alias("cached_tokens"),
        (F.sum("tokens") * 100.0 / max_context).alias("context_pct"))


def child_stream_view(a: Assembled) -> DataFrame:
    """Label, first user text, last totals and activity of every child stream with a turn."""
    return a.sessions.where("total_turns > 0 and stream != 'main'").select(
        *KEYS, F.substring(F.regexp_replace("stream", "^[a-z]+:", ""), 1, 8).alias("label"), F.substring("first_text", 1, 60).alias("opening"),
        F.col("last_turn").alias("turn_index"), F.col("used").cast("long").alias("cumulative_total"), F.col("last_waits").alias("active"))
