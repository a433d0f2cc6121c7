"""Tool classification, shell intents and model limits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tool names of each log format, with their kind; all are of the system's origin.
CLASSES = {
    "claude_code": {
        "ask": ["AskUserQuestion"], "execute": ["Bash", "KillShell", "BashOutput", "Skill", "SlashCommand"],
        "write": ["Edit", "Write", "NotebookEdit"], "read": ["Read"], "search": ["Glob", "Grep", "WebFetch", "WebSearch"],
        "plan": ["Task", "TaskCreate", "TaskUpdate", "TaskGet", "TaskList", "TaskStop", "TaskOutput", "TodoWrite", "EnterPlanMode", "ExitPlanMode"]},
    "codex": {"write": ["apply_patch"], "read": ["read_mcp_resource"], "execute": ["shell", "shell_command"], "plan": ["update_plan"]},
    "gemini": {"search": ["google_web_search"], "read": ["read_file"], "write": ["replace", "write_file"], "execute": ["run_shell_command"], "plan": ["write_todos"]},
}
# Words in a name that tell the kind of an unlisted tool, in this order.
COMMON = [("plan", "todo|plan"), ("search", "search|grep|find"), ("ask", "ask|prompt|question"), ("read", "read|get|fetch"),
          ("write", "write|edit|update|patch"), ("execute", "shell|bash|exec|run|command")]
# Prefixes of model names, context window and share of it (percent) kept free for compaction.
MODEL_LIMITS = [
    *[(p, 200_000, 22.5) for p in ("claude-sonnet-4-5", "claude-haiku-4-5", "claude-opus-4-5", "claude-sonnet-4", "claude-haiku-4", "claude-opus-4", "claude-3-5", "claude-3")],
    *[(p, 400_000, 0.0) for p in ("gpt-5.2", "gpt-5.1-codex-max", "gpt-5.1-codex-mini", "gpt-5.1-codex", "gpt-5.1", "gpt-5-codex-mini", "gpt-5-codex", "gpt-5")],
    *[(p, 1_048_576, 0.0) for p in ("gemini-2.5-pro", "gemini-2.5-flash", "gemini-2.5-flash-lite", "gemini-2.0-flash", "gemini-2.0-flash-lite")],
]
# First words of commands that read.
READERS = ("cat", "head", "tail", "less", "more", "ls", "find", "tree", "fd", "wc", "diff", "stat", "file")
SEARCHERS = ("grep", "rg", "ag", "ack")
WRITERS = ("rm", "mv", "cp", "mkdir", "rmdir", "touch")


def kind_by_words(name: Column) -> Column:
    out = F.lit("other")
    for kind, words in reversed(COMMON):
        out = F.when(F.lower(name).rlike(words), kind).otherwise(out)
    return out


def origin_of(name: Column) -> Column:
    return F.when(name.startswith("mcp__"), "mcp").otherwise("system")


def classify(provider: Column, name: Column) -> Column:
    """The kind of a tool by its name: listed for the format, else of another server, else by words in the name."""
    out = F.when(name.startswith("mcp__"), "other").otherwise(kind_by_words(name))
    for p, kinds in CLASSES.items():
        for kind, names in kinds.items():
            out = F.when((provider == p) & name.isin(names), kind).otherwise(out)
    return out


def mcp_name(name: Column) -> tuple[Column, Column]:
    """Server and tool of ``mcp__server__tool``; null for other names."""
    pattern = r"^mcp__(.*?)__(.*)$"
    return tuple(F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k)) for k in (1, 2))


def has_option(command: Column, option: str) -> Column:
    """Whether a word of the command is the option, or starts with it and goes on with a sign."""
    return command.rlike(rf"(^|\s)\Q{option}\E($|[^\p{{L}}\p{{N}}])")


def unwrap_shell(command: Column, depth: int = 3) -> Column:
    """The command inside ``bash -lc`` or ``bash -c``; deeper nesting than ``depth`` stays wrapped."""
    out = F.trim(command)
    for _ in range(depth):
        out = F.trim(F.regexp_replace(out, r"(?s)^bash\s(?:(?=.*-lc).*?-lc|(?!.*-lc).*?-c)(.*)$", "$1"))
    return F.coalesce(out, F.lit(""))


def first_word(command: Column) -> Column:
    return F.regexp_extract(command, r"^\s*(\S*)", 1)


def _edits_in_place(c: Column) -> Column:
    return has_option(c, "-i") | has_option(c, "--in-place")


def execute_intent(command: Column) -> Column:
    """read, write, build, test, git or other."""
    inner, outer = unwrap_shell(command), F.trim(command)
    word = first_word(inner)
    reads = word.isin(*READERS, *SEARCHERS) | ((word == "sed") & ~_edits_in_place(inner)) | ((word == "awk") & ~inner.contains(">"))
    writes = word.isin(*WRITERS) | (word.isin("echo", "printf", "awk") & inner.contains(">")) | ((word == "sed") & _edits_in_place(inner))
    return (F.when(reads, "read").when(writes, "write").when(outer.rlike("build|compile") | (first_word(outer) == "make"), "build")
            .when(outer.rlike("test|jest"), "test").when(first_word(outer).isin("git", "gh"), "git").otherwise("other"))


def shell_intent(command: Column) -> Column:
    """search or read for a shell command that only does so; else null."""
    c = unwrap_shell(command)
    word = first_word(c)
    lists = has_option(c, "--files") | has_option(c, "-l") | has_option(c, "--files-with-matches")
    return (F.when(word.isin("grep", "ag", "ack") | ((word == "rg") & ~lists), "search")
            .when(word.isin(*READERS) | (word == "rg") | ((word == "sed") & ~_edits_in_place(c)) | ((word == "awk") & ~c.contains(">")), "read"))


#: An argument of a search: behind options, in double or single quotes, or one bare word.
_ARGUMENT = r"^\S+\s+(?:-[^ ]* +)*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'-]\S*))"


def search_pattern_of(command: Column) -> Column:
    """What a search command looks for: its first argument that isn't an option, without quotes; null for other commands and open quotes."""
    c = unwrap_shell(command)
    parts = [F.regexp_extract(c, _ARGUMENT, k) for k in (1, 2, 3)]
    return F.when(first_word(c).isin(*SEARCHERS) & c.rlike(_ARGUMENT), F.concat(*parts))


def file_path_of(command: Column) -> Column:
    """The file that a reading command names: its last word that isn't an option (with sed, nor a range), the third word of a search; else null."""
    c = unwrap_shell(command)
    words, name = F.split(F.trim(c), r"\s+"), first_word(c)
    plain = F.filter(words, lambda w: ~w.startswith("-"))
    edited = F.filter(F.slice(words, 2, F.size(words)), lambda w: ~w.startswith("-") & ~w.contains(","))  # a file may be named as the command is
    # The commands whose last argument is a file.
    return (F.when(name.isin("cat", "head", "tail", "less", "more", "wc", "file"), F.try_element_at(plain, F.lit(-1)))
            .when(name == "sed", F.try_element_at(edited, F.lit(-1))).when(name.isin(*SEARCHERS), F.get(words, F.lit(2))))


# The arguments that tell what a call of each kind is about.
SUMMARY_KEYS = {"execute": ("command", "cmd"), "read": ("file_path", "path", "uri"), "write": ("file_path", "path", "uri"), "search": ("pattern", "query", "input"),
                "plan": ("description", "explanation"), "ask": ("prompt", "question")}


def tool_summary(kind: Column, arguments: Column, n: int = 80) -> Column:
    """The first argument that tells what a call is about, cut at ``n`` characters; ``(args...)`` if there is none."""
    v, out = F.try_parse_json(arguments), F.lit(None).cast("string")
    for k, keys in SUMMARY_KEYS.items():
        said = [x for key in keys for x in (F.array_join(F.try_variant_get(v, f"$.{key}", "array<string>"), " "), F.try_variant_get(v, f"$.{key}", "string"))]
        out = F.when(kind == k, F.coalesce(*said)).otherwise(out)
    return F.coalesce(F.when(F.octet_length(out) > n, F.concat(F.substring(out, 1, n - 3), F.lit("..."))).otherwise(out), F.lit("(args...)"))


def model_limits(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(p).alias("prefix"), F.lit(n).cast("long").alias("max_tokens"), F.lit(b).cast("double").alias("buffer_pct")) for p, n, b in MODEL_LIMITS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def join_model_limit(models: DataFrame, model: str = "model") -> DataFrame:
    """``models`` with max_tokens and buffer_pct of the longest prefix of the model's name (null if none).

    The prefix join runs over distinct names; the 21 prefixes are broadcast.
    """
    names = models.select(F.col(model).alias("_model")).where("_model is not null").distinct()
    fit = names.join(F.broadcast(model_limits(models.sparkSession)), F.col("_model").startswith(F.col("prefix")))
    best = fit.groupBy("_model").agg(F.max_by(F.struct("max_tokens", "buffer_pct"), F.length("prefix")).alias("_l"))
    return models.join(best, models[model] == best["_model"], "left").select(
        *models.columns, F.col("_l.max_tokens").alias("max_tokens"), F.col("_l.buffer_pct").alias("buffer_pct"))


def effective_limit(limit: Column, buffer_pct: Column) -> Column:
    """What a limit leaves when ``buffer_pct`` percent are kept free, 1 at least; a share that isn't 0 to 100 is an error."""
    buffer_pct = F.when(buffer_pct.isNull() | buffer_pct.between(0, 100), buffer_pct).otherwise(F.raise_error(F.lit("a buffer must be 0 to 100 percent")).cast("double"))
    return F.when(limit.isNotNull(), F.greatest(F.lit(1), F.floor(limit * (100 - buffer_pct) / 100))).cast("long")
