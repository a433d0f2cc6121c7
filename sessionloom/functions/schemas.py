"""What each format's tools take: a table of arguments, against which calls are tested.

A call becomes its tool's variant if its arguments are an object in which every
listed argument has its type; one that must be there isn't missing, and one that
may be null is.  Other arguments don't matter.  Calls that don't fit, and tools
that aren't listed, are Generic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ToolSchema:
    """``arguments``: name and type each, with ``!`` where one must be there, ``?`` where it may be missing or null, and nothing where it may be missing only.

    Types are string, integer (not negative), boolean and strings."""

    provider: str
    tools: tuple[str, ...]
    variant: str
    arguments: str = ""


# The tools of the three formats, their variants and the arguments they take.
SCHEMAS = (
    ToolSchema("claude_code", ("Read",), "FileRead", "file_path string!, offset integer?, limit integer?"),
    ToolSchema("claude_code", ("Glob",), "FileRead", "pattern string!, path string?"),
    ToolSchema("claude_code", ("Edit",), "FileEdit", "file_path string!, old_string string!, new_string string!, replace_all boolean"),
    ToolSchema("claude_code", ("Write",), "FileWrite", "file_path string!, content string!"),
    ToolSchema("claude_code", ("Bash",), "Execute", "command string!, description string?, timeout integer?, dangerouslyDisableSandbox boolean?, run_in_background boolean?"),
    ToolSchema("claude_code", ("KillShell", "BashOutput"), "Execute", "command string?, description string?, timeout integer?"),
    ToolSchema("claude_code", ("Grep",), "Search", "pattern string!, path string?, glob string?, type string?, output_mode string?, -i boolean?, -n boolean?, -A integer?, -B integer?, -C integer?, head_limit integer?, multiline boolean?"),
    ToolSchema("claude_code", ("WebSearch", "WebFetch"), "Search", "pattern string?, query string?, input string?, path string?"),
    ToolSchema("codex", ("apply_patch",), "FileEdit", "raw string!"),
    ToolSchema("codex", ("shell",), "Execute", "command strings!, timeout_ms integer?, workdir string?"),
    ToolSchema("codex", ("shell_command",), "Execute", "command string?, description string?, timeout integer?"),
    ToolSchema("codex", ("read_mcp_resource",), "FileRead", "server string!, uri string!"),
    ToolSchema("gemini", ("read_file",), "FileRead", "file_path string!"),
    ToolSchema("gemini", ("write_file",), "FileWrite", "content string!, file_path string!"),
    ToolSchema("gemini", ("replace",), "FileEdit", "file_path string!, instruction string?, old_string string!, new_string string!"),
    ToolSchema("gemini", ("run_shell_command",), "Execute", "command string!, description string?"),
    ToolSchema("gemini", ("google_web_search",), "Search", "query string!"),
)


def schema_table(spark: SparkSession, schemas: tuple[ToolSchema, ...] = SCHEMAS) -> DataFrame:
    """provider, tool_name, schema_variant and takes (name, type, required and nullable of each argument): a row a tool, as listed."""
    def argument(told: str) -> Column:
        name, kind = told.split()
        return F.struct(F.lit(name).alias("name"), F.lit(kind.rstrip("!?")).alias("type"), F.lit(kind.endswith("!")).alias("required"), F.lit(kind.endswith("?")).alias("nullable"))

    none = "array<struct<name:string,type:string,required:boolean,nullable:boolean>>"
    rows = [F.struct(F.lit(s.provider).alias("provider"), F.lit(tool).alias("tool_name"), F.lit(s.variant).alias("schema_variant"),
                     F.array(*[argument(a) for a in s.arguments.split(",") if a.strip()]).cast(none).alias("takes")) for s in schemas for tool in s.tools]
    return spark.range(1).select(F.inline(F.array(*rows)))


def fits(arguments: Column, takes: Column) -> Column:
    """Whether arguments (a variant) are an object with what ``takes`` lists."""
    def one(a: Column) -> Column:
        value = F.try_variant_get(arguments, F.concat(F.lit("$['"), a["name"], F.lit("']")), "variant")
        kind, wanted = F.schema_of_variant(value), a["type"]
        whole = (kind == "BIGINT") & (F.try_variant_get(value, "$", "long") >= 0)
        typed = (F.when(wanted == "string", kind == "STRING").when(wanted == "boolean", kind == "BOOLEAN").when(wanted == "integer", whole)
                 .when(wanted == "strings", (kind == "ARRAY<STRING>") | (F.size(F.try_variant_get(value, "$", "array<variant>")) == 0)))
        return F.when(value.isNull(), ~a["required"]).when(kind == "VOID", a["nullable"]).otherwise(typed)

    return F.coalesce(is_object(arguments) & F.forall(takes, lambda a: F.coalesce(one(a), F.lit(False))), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
