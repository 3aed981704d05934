"""Risky calls in lines of code, as column expressions over exploded lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: (pattern, rule, severity)
PATTERNS = [
    (r"\bstrcpy\s*\(", "unsafe_string_copy", "medium"),
    (r"\bstrcat\s*\(", "unsafe_string_concat", "medium"),
    (r"\bsprintf\s*\(", "unsafe_sprintf", "medium"),
    (r"\bvsprintf\s*\(", "unsafe_vsprintf", "medium"),
    (r"\bgets\s*\(", "unsafe_gets", "high"),
    (r"\bsystem\s*\(", "shell_command_execution", "medium"),
    (r"\bpopen\s*\(", "shell_command_execution", "medium"),
    (r"\beval\s+", "shell_eval", "medium"),
    (r"`[^`]+`", "shell_backtick_execution", "low"),
    (r"\bcopy_from_user\s*\(", "kernel_user_boundary", "medium"),
    (r"\bcopy_to_user\s*\(", "kernel_user_boundary", "medium"),
    (r"\bnla_data\s*\(", "netlink_input_boundary", "medium"),
]
# fixed values: languages that are scanned, by how their comments begin, and those whose backticks quote text
SCANNED = "bazel c csharp dockerfile elixir erlang go groovy html java javascript kotlin lua make objective_c objective_cpp patch perl php python powershell ruby rust scala shell starlark svelte swift sql terraform typescript ucode vue zig".split()
HASH_COMMENTS = "python ruby perl shell make dockerfile powershell yaml".split()
SLASH_COMMENTS = "c csharp go groovy java javascript kotlin objective_c objective_cpp php rust scala swift typescript zig".split()
QUOTING_BACKTICKS = "go javascript kotlin python svelte typescript vue".split()
#: Strings in triple quotes that begin a line of Python, to the end of the line that closes them.
BLOCK = r"(?m)^[ \t]*(?:\"\"\"[\s\S]*?(?:\"\"\"[^\n]*|\z)|'''[\s\S]*?(?:'''[^\n]*|\z))"


def _breaks(text) -> F.Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def code_lines(language, text) -> F.Column:
    """Lines of text; those of Python's strings in triple quotes that begin a line are empty."""
    between, blocks = F.split(text, BLOCK), F.regexp_extract_all(text, F.lit(BLOCK), 0)
    bare = F.array_join(F.zip_with(between, blocks, lambda p, q: F.concat(p, F.coalesce(F.repeat(F.lit("\n"), _breaks(q)), F.lit("")))), "")
    return F.split(F.when(language == "python", bare).otherwise(text), "\n")


def scan_security(files: DataFrame) -> DataFrame:
    """(file_id, line, rule_id, severity) of files (file_id, language, text): a pattern in a line of code, or one whose name
    stands in the line and that is complete within three; once a line and rule. Null texts have none."""
    lines = code_lines(F.col("language"), F.regexp_replace("text", "\r\n?", "\n"))
    one = files.filter(F.col("language").isin(*SCANNED) & F.col("text").isNotNull()).select("file_id", "language", lines.alias("lines"))
    near = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("t"), F.array_join(F.slice(F.col("lines"), i + 1, 3), "\n").alias("w")))
    one = one.select("file_id", "language", F.inline(near))
    names = "|".join(m[1] for p, _, _ in PATTERNS if (m := re.match(r"\\b(\w+)", p)))
    bare = F.trim("t")
    comment = F.col("language").isin(*HASH_COMMENTS) & bare.startswith("#")
    comment = comment | F.col("language").isin(*SLASH_COMMENTS) & bare.rlike(r"^(?://|/\*|\*)") | (F.col("language") == "sql") & bare.startswith("--")
    one = one.filter(F.col("t").rlike(rf"\b(?:{names})\b|`") & ~comment)

    def hit(pattern: str) -> F.Column:
        name = re.match(r"\\b(\w+)", pattern)
        if not name:
            return F.col("t").rlike(pattern) & ~F.col("language").isin(*QUOTING_BACKTICKS)
        return F.col("t").rlike(rf"\b{name[1]}\b") & F.col("w").rlike(pattern)

    found = F.array(*[F.when(hit(p), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for p, r, s in PATTERNS])
    return one.select("file_id", "line", F.inline(F.array_distinct(F.array_compact(found))))
