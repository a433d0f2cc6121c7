"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_OID = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


def truncate_marked(text: Column, n: int, mark: str = "...(truncated)") -> Column:
    """The first n characters and a mark, if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def truncate_snippet(text: Column, n: int) -> Column:
    return truncate_marked(text, n, "...")


def truncate_ellipsis(text: Column, n: int) -> Column:
    """At most n characters, the last three dots if cut; a bare prefix for n of 3 or less."""
    return F.when(F.length(text) <= n, text).otherwise(
        F.substring(text, 1, n) if n <= 3 else F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def truncate_by_bytes(text: Column, n: int) -> Column:
    """The first n characters and dots if the text has more than n bytes."""
    return F.when(F.octet_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def clean_snippet(text: Column) -> Column:
    """Without the blocks that agents add to a prompt, white space collapsed."""
    # The tags of those blocks and what stands for them.
    for tag in ("environment_context", "command_output", "changed_files"):
        text = F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", " [..meta..] ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slash_command(text: Column) -> tuple[Column, Column]:
    """Name and arguments of a tagged slash command; null if there is none."""
    name = F.trim(F.regexp_extract(text, r"(?s)<command-name>(.*?)</command-name>", 1))
    args = F.trim(F.regexp_extract(text, r"(?s)<command-args>(.*?)</command-args>", 1))
    return F.when(name.startswith("/"), name), F.when(name.startswith("/") & (args != ""), args)


def exit_code(text: Column) -> Column:
    """The number after ``Exit Code:``; null if there is none."""
    found = F.regexp_extract(text, r"(?i)Exit Code:\s*(\d+)", 1)
    return F.when(found != "", found.try_cast("int"))


def patch_header(patch: Column) -> tuple[Column, Column]:
    """Operation (Add or Update) and path of the first file of a patch."""
    pattern = r"(?m)^\*\*\* (Add|Update) File: (.*)$"
    return tuple(F.when(patch.rlike(pattern), F.trim(F.regexp_extract(patch, pattern, k))) for k in (1, 2))


def uuid5(namespace: Column, name: Column) -> Column:
    """Version 5 UUID of a name in a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    parts = F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-5$3-#$4-$5")  # the hash appears twice only: plans stay small
    return F.replace(parts, F.lit("#"), variant)


def session_uuid(raw: Column) -> Column:
    return uuid5(F.lit(NAMESPACE_OID), raw)


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``*`` stays inside a path part, ``**`` doesn't."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"
