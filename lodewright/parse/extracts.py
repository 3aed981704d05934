"""Extracts that built-in functions can express: one pass over the text, no Python."""

from __future__ import annotations

import keyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.parse.profiles import PROFILES

NON_CALLS = "if for while switch return sizeof defined do else case catch func function typeof instanceof new delete void throw yield await fn match loop lambda".split()  # fixed values


def _sorted_set(text, pattern: str, group: int = 1, limit: int | None = None) -> Column:
    got = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), group)))
    return F.slice(got, 1, limit) if limit else got


def referenced_symbols(text, language=None, limit: int = 160) -> Column:
    """Sorted names before a parenthesis that are no words of the language."""
    got = F.array_except(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1), F.array(*[F.lit(k) for k in NON_CALLS]))
    if language is not None:
        got = F.when(language == "python", F.array_except(got, F.array(*[F.lit(k) for k in keyword.kwlist]))).otherwise(got)
    return F.slice(F.array_sort(F.array_distinct(got)), 1, limit)


def common_extracts(text) -> dict[str, Column]:
    strings = F.filter(_sorted_set(text, r'"([^"\n]{4,160})"'), lambda s: ~s.startswith("$("))
    logs = r'\b(?:pr_err|pr_warn|pr_info|dev_err|dev_warn|fprintf|printf|syslog|ulog)\s*\([^"\n]*"([^"\n]{4,180})"'
    return {
        "config_symbols": _sorted_set(text, r"\b(CONFIG_[A-Za-z0-9_]+)\b", 1, 120),
        "includes": _sorted_set(text, r"(?m)^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]", 1, 80),
        "string_literals": F.slice(strings, 1, 80),
        "log_error_messages": _sorted_set(text, logs, 1, 80),
    }


def doc_sections(files: DataFrame) -> DataFrame:
    """(key columns, ordinal, line_start, title, body) of Markdown texts (..., text), a section per heading of one to four
    marks; the part before the first heading is section 0 if it has text."""
    keys = [c for c in files.columns if c != "text"]
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n?", "\n")), r"\n(?=#{1,4} )")
    s = files.filter("text IS NOT NULL").select(*keys, parts.alias("parts")).select(*keys, "parts", F.posexplode("parts").alias("ordinal", "p"))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("ordinal")), F.lit(0), lambda acc, x: acc + F.length(x) - F.length(F.replace(x, F.lit("\n"))) + 1)
    title = F.regexp_extract("p", r"^#{1,4} ([^\n]*)", 1)
    body = F.when(F.col("ordinal") > 0, F.regexp_replace("p", r"^[^\n]*\n?", "")).otherwise(F.col("p"))
    out = s.select(*keys, "ordinal", F.greatest(before, F.lit(1)).alias("line_start"), F.when(F.col("ordinal") > 0, title).otherwise("").alias("title"), F.trim(F.regexp_replace(body, r"^\n+|\n+$", "")).alias("body"))
    return out.filter("ordinal > 0 OR body <> ''")


def first_sentence(text) -> Column:
    return F.regexp_extract(F.regexp_replace(F.trim(text), r"\s+", " "), r"^(.*?[.!?](?=\s|$)|.*$)", 1)


def json_members(files: DataFrame) -> DataFrame:
    """Top-level keys of JSON objects (..., text) with their values as text; texts that are no valid JSON as a whole have none."""
    keys = [c for c in files.columns if c != "text"]
    whole = F.json_array_length(F.concat(F.lit("["), "text", F.lit("]"))) == 1  # the readers pass over what follows a value, but not inside an array
    return files.filter(whole & F.from_json("text", "map<string,string>").isNotNull()).select(*keys, F.explode(F.from_json("text", "map<string,string>")).alias("key", "value"))


def profile(text, language: str) -> dict[str, Column]:
    """The metadata keys of a language as columns of at most 80 values in first-seen order."""
    return {k: F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(p), 1)), 1, 80) for k, p in PROFILES.get(language, [])}


def profile_rows(files: DataFrame, language: str) -> DataFrame:
    """(key columns, key, values) of files (..., text) of one language, empty ones dropped."""
    keys = [c for c in files.columns if c != "text"]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("values")) for k, v in profile(F.col("text"), language).items()])
    return files.select(*keys, F.inline(pairs)).filter("size(values) > 0")
