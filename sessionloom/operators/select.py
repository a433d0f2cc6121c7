"""Choosing noteworthy sessions: digests, thresholds and lenses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import text as X
from .assemble import KEYS, Assembled

#: Newest main sessions looked at, and the most of one provider.
POOL, PER_PROVIDER = 1000, 200


@dataclass(frozen=True)
class Lens:
    """What makes a session worth a look; columns over metrics, ``boost`` and the p90 thresholds."""

    name: str
    predicate: Column
    score: Column
    reason: Column


def lenses() -> list[Lens]:
    # The lenses' names, reasons, weights and least numbers.
    c = F.col
    seconds = lambda n: F.format_string("%.1fs", c(n) / 1000.0)
    return [
        Lens("Failures", (c("tool_failures_total") > 0) | (c("missing_tool_pairs") > 0), c("tool_failures_total") * 100 + c("missing_tool_pairs") * 50 + c("boost"),
             F.format_string("fails=%d missing=%d", "tool_failures_total", "missing_tool_pairs")),
        Lens("Loops", c("loop_signals") > 0, c("loop_signals") * 100 + c("boost"), F.format_string("loop_signals=%d", "loop_signals")),
        Lens("Bottlenecks", (c("max_e2e_ms") > c("p90_e2e_ms")) | (c("max_tool_ms") > c("p90_tool_ms")), c("max_tool_ms") + c("max_e2e_ms"),
             F.concat(F.lit("max_tool="), seconds("max_tool_ms"), F.lit(" max_e2e="), seconds("max_e2e_ms"))),
        Lens("Toolchains", c("tool_calls_total") > F.greatest(c("p90_tool_calls"), F.lit(5)), c("tool_calls_total") * 10 + c("boost"),
             F.format_string("tool_calls=%d longest_chain=%d", "tool_calls_total", "longest_chain"))]


def balance_providers(sessions: DataFrame, pool: int = POOL, each: int = PER_PROVIDER) -> DataFrame:
    """The newest main sessions, at most ``each`` of a provider, with ``boost``: the pool's size less the place in it."""
    newest = [F.desc("start_time"), F.asc("session_id")]
    top = sessions.where("stream = 'main'").orderBy(*newest).limit(pool)
    held = top.withColumn("_r", F.row_number().over(W.partitionBy("provider").orderBy(*newest))).where(F.col("_r") <= each).drop("_r")
    return held.withColumn("boost", F.count(F.lit(1)).over(W.partitionBy()) - F.row_number().over(W.orderBy(*newest)) + 1)


def digests(a: Assembled, pool: int = POOL, each: int = PER_PROVIDER) -> DataFrame:
    """Metrics, opening and activation text of the balanced pool's sessions with a turn."""
    return balance_providers(a.sessions, pool, each).where("total_turns > 0").select(
        "provider", *KEYS, "start_time", "boost", "tool_calls_total", "tool_failures_total", "missing_tool_pairs", "longest_chain", "max_e2e_ms", "loop_signals", "max_tool_ms",
        X.truncate_snippet(X.clean_snippet(F.col("first_text")), 100).alias("opening"),
        F.when(F.col("busiest.tool_count") >= 3, X.truncate_snippet(X.clean_snippet(F.col("busiest.user_text")), 120)).alias("activation"))


def _thresholds(window: WindowSpec | None = None) -> dict[str, Column]:
    """The value at 0.9 of each sorted list (POOL values at most); defaults for none.  Aggregates, or columns over a window."""
    def at(name: str, default: int) -> Column:
        listed = F.collect_list(name)
        values = F.array_sort(listed if window is None else listed.over(window))
        n = F.size(values)
        place = F.least(F.floor(n * F.lit(0.9)), n - 1).cast("int")
        return F.when(n == 0, F.lit(default)).otherwise(F.get(values, place)).cast("long")
    return {"p90_e2e_ms": at("max_e2e_ms", 5000), "p90_tool_ms": at("max_tool_ms", 5000), "p90_tool_calls": at("tool_calls_total", 10)}


def p90_thresholds(d: DataFrame) -> DataFrame:
    """One row: the thresholds of a pool."""
    return d.agg(*[v.alias(n) for n, v in _thresholds().items()])


def lens_select(d: DataFrame, limit: int = 20, own: list[Lens] | None = None) -> DataFrame:
    """Sessions chosen lens by lens, each once, then the most active ones up to ``limit``.

    ``own`` lenses stand in place of the four known ones; each may take an equal
    share of ``limit``, one session at least.  ``d`` has POOL rows at most: the
    thresholds are columns over the pool, each lens marks in turn the best of those
    not taken yet by a window over it, and nothing is computed twice or kept.
    """
    chosen, c = lenses() if own is None else own, F.col
    each = max(1, limit // max(1, len(chosen)))
    d = d.withColumns(_thresholds(W.partitionBy()))
    d = d.withColumns({"lens_order": F.lit(None).cast("int"), "lens": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "score": F.lit(None).cast("long")})
    for k, lens in enumerate(chosen):
        free = c("lens_order").isNull() & lens.predicate
        rank = F.row_number().over(W.partitionBy(free).orderBy(F.desc(lens.score), F.desc("boost")))
        d = d.withColumn("_take", free & (rank <= each)).withColumns({
            "lens_order": F.when(c("_take"), k).otherwise(c("lens_order")), "lens": F.when(c("_take"), lens.name).otherwise(c("lens")),
            "reason": F.when(c("_take"), F.concat(F.lit(f"{lens.name} ("), lens.reason, F.lit(")"))).otherwise(c("reason")),
            "score": F.when(c("_take"), lens.score).otherwise(c("score"))})
    taken = F.count("lens_order").over(W.partitionBy())
    rank = F.row_number().over(W.partitionBy(c("lens_order").isNull()).orderBy(F.desc("tool_calls_total"), F.desc("boost")))
    fills = c("lens_order").isNull() & (c("_rank") <= limit - c("_taken"))
    d = d.withColumn("_taken", taken).withColumn("_rank", rank).withColumn("_fills", fills).where("lens_order is not null or _fills")
    return d.select("session_id", F.coalesce("lens_order", F.lit(len(chosen))).alias("lens_order"), F.coalesce("lens", F.lit("Activity")).alias("lens"),
                    F.coalesce("reason", F.lit("Activity (filler)")).alias("reason"), F.coalesce("score", "tool_calls_total").alias("score"))
