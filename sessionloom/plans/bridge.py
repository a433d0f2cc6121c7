"""Agent events out of the relational test tables, by fixed rules.

The same rules are written as SQL in :mod:`sessionloom.plans.oracle`, so that
every operator on agent events can be compared on the test tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the bridge.
PROVIDERS = ("claude_code", "codex", "gemini")
TOOLS = ("Read", "Edit", "Bash", "Grep", "Glob", "mcp__db__query")
COMMANDS = ("cargo build", "cargo test --all", "git status", "ls -la src", "cat a.txt", "echo x > f.txt")
MODELS = (("claude-sonnet-4-5-x", "claude-3-5-haiku", "other-model"), ("gpt-5.1-codex-max", "gpt-5", "gpt-4o"),
          ("gemini-2.5-flash-lite", "gemini-2.0-flash", "gemini-1.5-pro"))

TYPES = ("user", "reasoning", "tool_call", "tool_result", "message", "token_usage", "notification", "slash_command",
         "queue_operation", "summary")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def agent_events(events: DataFrame) -> DataFrame:
    """Agent events from the ``events`` table (event_id, ts, user_id, event_type, value, props)."""
    k = F.get_json_object("props", "$.k").cast("long")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = (events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", k.alias("k"))
         .withColumn("seq", F.row_number().over(order).cast("long"))
         .withColumn("_call", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), True)
                     .over(order.rowsBetween(W.unboundedPreceding, -1))))
    kind, k, source = F.col("type"), F.col("k"), F.col("event_type")
    e = e.where((source != "error") | F.col("_call").isNotNull()).withColumn("type", (
        F.when((source == "signup") & (k % 10 == 0), "slash_command").when(source == "signup", "user")
        .when((source == "view") & (k < 50), "reasoning").when(source == "view", "message")
        .when(source == "click", "tool_call").when(source == "error", "tool_result").otherwise("token_usage")))
    call, result, usage = kind == "tool_call", kind == "tool_result", kind == "token_usage"
    identity = F.col("event_id").cast("string")
    e = (e.withColumn("provider", _pick(PROVIDERS, F.col("user_id") % 3))
         .withColumn("session_id", F.concat(F.lit("s"), F.col("user_id").cast("string")))
         .withColumn("stream", F.when(k % 11 == 7, F.concat(F.lit("sidechain:a"), (k % 3).cast("string"))).otherwise("main"))
         .withColumn("text", F.when((kind == "user") & (k % 10 == 1), "[Request interrupted by user]")
                     .when((kind == "user") & (k % 10 == 2), F.concat(F.lit("This session is being continued "), identity))
                     .when(kind == "user", F.concat(F.lit("ask "), identity))
                     .when(kind == "message", F.concat(F.when(k % 9 == 4, "Sorry, ").otherwise(""), F.lit("message "), k.cast("string")))
                     .when(kind == "reasoning", F.concat(F.lit("reasoning "), k.cast("string"))))
         .withColumn("slash_name", F.when(kind == "slash_command", "/commit"))
         .withColumn("tool_name", F.when(call, _pick(TOOLS, k % 6))))
    tool = F.col("tool_name")
    e = (e.withColumn("file_path", F.when(tool.isin("Read", "Edit"), F.concat(F.lit("/src/f"), (k % 20).cast("string"), F.lit(".rs"))))
         .withColumn("command", F.when(tool == "Bash", _pick(COMMANDS, F.floor(k / 6) % 6)))
         .withColumn("pattern", F.when(tool == "Grep", F.concat(F.lit("p"), k.cast("string"))).when(tool == "Glob", "**/*.rs"))
         .withColumn("mcp_server", F.when(tool.startswith("mcp__"), "db")).withColumn("mcp_tool", F.when(tool.startswith("mcp__"), "query"))
         .withColumn("tool_call_id", F.when(result, F.col("_call").cast("string")))
         .withColumn("output", F.when(result, F.concat(F.lit("out "), k.cast("string"))))
         .withColumn("is_error", F.when(result, k % 3 == 0))
         .withColumn("agent_id", F.when(result & (k % 4 == 1), F.concat(F.lit("a"), (k % 3).cast("string"))))
         .withColumn("tok_cached", F.when(usage, k * 10)).withColumn("tok_uncached", F.when(usage, F.floor(F.col("value") * 10).cast("long")))
         .withColumn("tok_generated", F.when(usage, F.floor("value").cast("long")))
         .withColumn("tok_reasoning", F.when(usage, F.lit(0).cast("long"))).withColumn("tok_tool", F.when(usage, F.lit(0).cast("long")))
         .withColumn("model", _pick([m for row in MODELS for m in row], (F.col("user_id") % 3) * 3 + F.floor(F.col("user_id") / 3) % 3)))
    content = (F.when(call, F.concat(F.lit('{"name":"'), tool, F.lit('","arg":"'), F.coalesce("file_path", "command", "pattern", F.lit("")), F.lit('"}')))
               .when(result, F.concat(F.lit('{"output":"'), F.col("output"), F.lit('","is_error":'), F.col("is_error").cast("string"), F.lit("}")))
               .when(usage, F.concat(F.lit('{"cached":'), F.col("tok_cached").cast("string"), F.lit("}")))
               .when(kind == "slash_command", F.lit('{"name":"/commit"}'))
               .otherwise(F.concat(F.lit('{"text":"'), F.col("text"), F.lit('"}'))))
    return e.select(
        "provider", "session_id", identity.alias("event_id"), "ts", "stream", "seq", "type", "text", "slash_name", "tool_name", "file_path",
        "command", "pattern", "mcp_server", "mcp_tool", "tool_call_id", "output", "is_error", "agent_id", "tok_cached", "tok_uncached",
        "tok_generated", "tok_reasoning", "tok_tool", "model", F.concat(F.lit('{"type":"'), kind, F.lit('","content":'), content, F.lit("}")).alias("payload_json"))


def bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Agent events from ``conversations`` (conv_id, turn, role, text): user, assistant -> message, system -> notification."""
    role = F.col("role")
    return conversations.select(
        _pick(PROVIDERS, F.col("conv_id") % 3).alias("provider"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"),
        F.timestamp_micros((F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")) * 1_000_000).alias("ts"),
        F.lit("main").alias("stream"), F.col("turn").cast("long").alias("seq"),
        F.when(role == "user", "user").when(role == "assistant", "message").otherwise("notification").alias("type"), "text")
