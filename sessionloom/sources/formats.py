"""Formats as specifications, and reading logs of any of them with what couldn't be read beside the events.

A specification has what tells the format (parts of paths and a glob of file
names), how its records become events, and what its tools take.  The three known
formats bring a normalizer of their own; another one needs a record schema, a few
column builders and a rule for each kind of event.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import SCHEMAS, ToolSchema
from . import ingest

Builder = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """One kind of event of a record: ``when`` it is there, and its fields (those of normalized events), made of the record; counts of tokens that aren't given are 0."""

    type: str
    when: Builder
    fields: dict[str, Builder] = field(default_factory=dict)


@dataclass(frozen=True)
class ProviderSpec:
    """``whole``: a file is one document, else each of its lines is a record.

    ``normalize`` makes events of lines or documents; without it they are made by
    ``rules`` of records read by the schema ``record``, with ``session``, ``time``
    (text), ``identity`` and ``stream`` of a record.  ``timed`` tells, of a raw
    record (a variant), whether it makes events and so needs a time, and ``clock``
    gives that time's text."""

    name: str
    marks: tuple[str, ...]
    glob: str
    whole: bool = False
    normalize: Callable[[DataFrame], DataFrame] | None = None
    record: str = ""
    session: Builder = lambda r: r["session"]
    time: Builder = lambda r: r["time"]
    identity: Builder = lambda r: r["id"]
    stream: Builder = lambda r: F.lit("main")
    rules: tuple[Rule, ...] = ()
    tools: tuple[ToolSchema, ...] = ()
    timed: Builder = lambda v: F.lit(True)
    clock: Builder = lambda v: ingest.at(v, "$.timestamp")

    def events(self, lines: DataFrame) -> DataFrame:
        """Normalized events of lines (path, place or line_no, value) or documents (path, value)."""
        return self.normalize(lines) if self.normalize else by_rules(self, lines)


def by_rules(spec: ProviderSpec, lines: DataFrame) -> DataFrame:
    """Events by a specification's rules: a record gives one for each rule that holds, in the order of the rules."""
    place = "line_no" if "line_no" in lines.columns else "place"
    r = F.col("r")

    def fields_of(rule: Rule) -> dict[str, Column]:
        none = {n: F.lit(0) for n in ("tok_cached", "tok_uncached", "tok_generated", "tok_reasoning", "tok_tool")} if rule.type == "token_usage" else {}
        return none | {n: f(r) for n, f in rule.fields.items()}

    made = [F.when(rule.when(r), F.struct(F.lit(k).cast("long").alias("sub_no"), ingest._event(rule.type, rule.type, **fields_of(rule)).alias("e"))) for k, rule in enumerate(spec.rules)]
    rows = lines.where(F.try_parse_json("value").isNotNull()).withColumn("r", F.from_json("value", spec.record))
    rows = rows.select("path", place, "r", F.explode_outer(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x"))
    rows = rows.select("path", place, spec.session(r).alias("raw"), ingest.parse_ts(spec.time(r)).alias("ts"), spec.stream(r).alias("stream"), F.coalesce("x.sub_no", F.lit(0)).cast("long").alias("sub_no"),
                       F.concat(spec.identity(r).cast("string"), F.lit("-"), F.coalesce("x.sub_no", F.lit(0)).cast("string")).alias("base_id"), F.col("x.e").alias("e"))
    return ingest._finish(rows, spec.name, F.lit("unknown-session"), spec.tools)


def _kind_in(path: str, *kinds: str) -> Builder:
    return lambda v: ingest.at(v, path).isin(*kinds)


def known_formats() -> tuple[ProviderSpec, ...]:
    """The three formats."""
    marks = dict((name, mark) for mark, name in ingest.PROVIDER_MARKS)

    def tools(name: str) -> tuple[ToolSchema, ...]:
        return tuple(s for s in SCHEMAS if s.provider == name)

    return (
        ProviderSpec("claude_code", (marks["claude_code"],), "*.jsonl", normalize=ingest.claude_events, tools=tools("claude_code"),
                     timed=_kind_in("$.type", "user", "assistant", "system", "progress", "queue-operation", "summary", "pr-link")),
        ProviderSpec("codex", (marks["codex"],), "rollout-*.jsonl", normalize=ingest.codex_events, tools=tools("codex"), timed=_kind_in("$.type", "response_item", "event_msg")),
        ProviderSpec("gemini", (marks["gemini"],), "session-*.json", whole=True, normalize=ingest.gemini_events, tools=tools("gemini"), clock=lambda v: ingest.at(v, "$.messages[0].timestamp")))


@dataclass
class Parsed:
    """Events, and a row (path, place, reason, value) for what gave none: a path that tells no format or isn't a log of it, a line that isn't JSON, a record without a time."""

    events: DataFrame
    errors: DataFrame
    raw: list[DataFrame]

    def write(self, folder: str) -> None:
        """Both tables below ``folder``, from one read of the logs, which is kept on the executors' disks meanwhile."""
        for lines in self.raw:
            lines.persist(StorageLevel.DISK_ONLY)
        try:
            self.events.write.mode("overwrite").parquet(f"{folder}/events")
            self.errors.write.mode("overwrite").parquet(f"{folder}/errors")
        finally:
            for lines in self.raw:
                lines.unpersist()


ERRORS = "path string, place struct<_block:bigint,_id:bigint>, reason string, value string"


def bad_records(lines: DataFrame, spec: ProviderSpec) -> DataFrame:
    """Lines or documents that give no events where they should, with the reason."""
    v = F.try_parse_json("value")
    place = F.col("place") if "place" in lines.columns else F.lit(None)
    untimed = F.coalesce(spec.timed(F.col("v")), F.lit(False)) & ingest.parse_ts(spec.clock(F.col("v"))).isNull()
    rows = lines.select("path", place.cast("struct<_block:bigint,_id:bigint>").alias("place"), "value", v.alias("v"))
    return rows.select("path", "place", F.when(F.col("v").isNull(), "not JSON").when(untimed, "no time").alias("reason"), "value").where("reason is not null")


def spec_of(path: str, specs: tuple[ProviderSpec, ...]) -> ProviderSpec | None:
    """The first specification whose mark a path has."""
    return next((s for s in specs if any(m in path for m in s.marks)), None)


def parse(spark: SparkSession, paths: list[str], provider: str | None = None, specs: tuple[ProviderSpec, ...] | None = None) -> Parsed:
    """Events and errors of files (or globs, or folders) whose format their paths tell, or of the format that is named."""
    specs = known_formats() if specs is None else specs
    held: dict[str, list[str]] = {}
    lost: list[tuple] = []
    for path in paths:
        name = path.rstrip("/").rpartition("/")[2]
        spec = next((s for s in specs if s.name == provider), None) if provider else spec_of(path, specs)
        if spec is None:
            lost.append((path, None, "unknown path", None))
        elif "." in name[1:] and not any(c in name for c in "*?[{") and not fnmatch.fnmatch(name, spec.glob):
            lost.append((path, None, "not a log", None))
        else:
            held.setdefault(spec.name, []).append(path)
    events, errors, raw = [], [spark.createDataFrame(lost, ERRORS)], []
    for spec in specs:
        if spec.name in held:
            lines = (ingest.read_documents if spec.whole else ingest.read_lines)(spark, *held[spec.name])
            raw.append(lines)
            events.append(spec.events(lines))
            errors.append(bad_records(lines, spec))
    made = reduce(DataFrame.unionByName, events).select(*ingest.EVENT_COLUMNS) if events else spark.createDataFrame([], ingest.EVENTS)
    return Parsed(made, reduce(DataFrame.unionByName, errors), raw)
