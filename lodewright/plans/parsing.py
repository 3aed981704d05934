"""Queries that parse the raw files and documents."""

from __future__ import annotations

import keyword

from pyspark.sql import functions as F

from lodewright import tables as T
from lodewright.functions.classify import language
from lodewright.parse import chunks as C
from lodewright.parse import extracts as X
from lodewright.parse import security as Y
from lodewright.parse.profiles import module_name


def _raw(spark, d):
    return T.table(spark, d, "raw_files").dropDuplicates(["raw_id"]).select(F.col("raw_id").alias("file_id"), F.col("source_path").alias("path"), language(F.col("source_path")).alias("language"), F.col("content").alias("text"))


def referenced_symbols(spark, d):
    f = _raw(spark, d)
    return f.select("file_id", F.array_join(X.referenced_symbols(F.col("text"), F.col("language")), ",").alias("symbols"))


def common_extracts(spark, d):
    f = _raw(spark, d)
    e = X.common_extracts(F.col("text"))
    return f.select("file_id", F.array_join(e["config_symbols"], ",").alias("config_symbols"), F.array_join(e["includes"], ",").alias("includes"), F.size(e["string_literals"]).alias("n_strings"))


def doc_sections(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    return X.doc_sections(docs).select("doc_id", "ordinal", "title", F.length("body").alias("n_chars"))


def json_members(spark, d):
    f = _raw(spark, d).filter("language = 'json'").select("file_id", "text")
    return X.json_members(f).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def profile_python(spark, d):
    f = _raw(spark, d).filter("language = 'python'").select("file_id", "text")
    return X.profile_rows(f, "python").select("file_id", "key", F.array_join("values", ",").alias("vals"))


def profile_go(spark, d):
    f = _raw(spark, d).filter("language = 'go'").select("file_id", "text")
    return X.profile_rows(f, "go").select("file_id", "key", F.array_join("values", ",").alias("vals"))


def profile_javascript(spark, d):
    f = _raw(spark, d).filter("language = 'javascript'").select("file_id", "text")
    return X.profile_rows(f, "javascript").select("file_id", "key", F.array_join("values", ",").alias("vals"))


def profile_c(spark, d):
    f = _raw(spark, d).filter("language = 'c'").select("file_id", "text")
    return X.profile_rows(f, "c").select("file_id", "key", F.array_join("values", ",").alias("vals"))


def profile_split(spark, d):
    """What files of Go keep of their metadata, and what their records take over."""
    from lodewright.parse.assemble import record_metadata
    from lodewright.parse.profiles import FILE_ONLY

    f = _raw(spark, d).filter("language = 'go'").select("file_id", "text")
    m = X.profile_rows(f, "go").groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("m"))
    kept = record_metadata(F.col("m"), FILE_ONLY)
    return m.select("file_id", F.size("m").alias("n_file_keys"), F.array_join(F.map_keys(kept), ",").alias("record_keys"), F.try_element_at(F.try_element_at(kept, F.lit("go_package")), F.lit(1)).alias("go_package"))


def profile_module(spark, d):
    return _raw(spark, d).filter("language = 'python'").select("file_id", F.expr(module_name("path")).alias("python_module"))


def profile_doc(spark, d):
    f = T.table(spark, d, "documents").select("doc_id", "text")
    return X.profile_rows(f, "doc").select("doc_id", "key", F.size("values").alias("n_vals"))


def parse_records(spark, d):
    """Records of all raw files by language and type."""
    f = _raw(spark, d)
    r = C.parse_files(f).join(f.select("file_id", "language"), "file_id")
    return r.groupBy("language", "record_type", F.coalesce("symbol_kind", F.lit("-")).alias("symbol_kind")).agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.size("refs")).alias("n_refs"))


def line_windows(spark, d):
    f = _raw(spark, d).filter("language NOT IN ('python', 'go', 'c', 'javascript')")
    return C.parse_files(f).select("file_id", "record_id", "line_start", "line_end")


def security_scan(spark, d):
    return Y.scan_security(_raw(spark, d)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n_hits"))


def patch_hunks(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit("").alias("path"), F.lit("patch").alias("language"), "text")
    return C.scan_patches(docs)


QUERIES = {f.__name__: f for f in (referenced_symbols, common_extracts, doc_sections, json_members, profile_python, profile_go, profile_javascript, profile_c, profile_split, profile_module, profile_doc, parse_records, line_windows, security_scan, patch_hunks)}

_RAW = "WITH raw AS (SELECT DISTINCT ON (raw_id) raw_id file_id, lower(regexp_extract(source_path, '[^/.](\\.[^./]+)$', 1)) ext, content AS text FROM raw_files)"


def _profile(lang, ext):
    parts = " UNION ALL ".join(f"SELECT file_id, '{k}' AS key, list_distinct_ordered(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1)) v FROM raw WHERE ext = '{ext}'" for k, p in X.PROFILES[lang])
    return _RAW + f"SELECT file_id, key, array_to_string(v[:80], ',') vals FROM ({parts}) WHERE len(v) > 0".replace("list_distinct_ordered(", "(SELECT list(x ORDER BY i) FROM (SELECT x, min(i) i FROM (SELECT unnest(l) x, generate_subscripts(l, 1) i FROM (SELECT ").replace(", 1)) v", ", 1) l)) GROUP BY x)) v")


# Lines of the documents, with the heading that each stands under.
_DOCS = r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(l) line, generate_subscripts(l, 1) i FROM t),
h AS (SELECT *, regexp_matches(line, '^#{1,4} ') head, sum(regexp_matches(line, '^#{1,4} ')::INT) OVER (PARTITION BY doc_id ORDER BY i) ordinal FROM x),
g AS (SELECT doc_id, ordinal::INT ordinal, coalesce(max(regexp_extract(line, '^#{1,4} (.*)$', 1)) FILTER (WHERE head), '') title, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head), '') body FROM h GROUP BY ALL)
SELECT doc_id, ordinal, title, length(trim(regexp_replace(body, '^\n+|\n+$', '', 'g'), ' '))::INT n_chars FROM g WHERE ordinal > 0 OR trim(regexp_replace(body, '^\n+|\n+$', '', 'g'), ' ') <> ''"""
_HUNKS = r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(l) line, generate_subscripts(l, 1) i, len(l) n FROM t),
y AS (SELECT *, CASE WHEN starts_with(line, '+++ ') THEN regexp_replace(split_part(substr(line, 5), chr(9), 1), '^b/', '') END f, starts_with(line, '@@') OR starts_with(line, 'diff --git') OR starts_with(line, '--- ') stop FROM x),
z AS (SELECT *, coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '') file FROM y),
s AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) nxt FROM z WHERE stop)
SELECT doc_id file_id, file, i::INT line_start, (coalesce(nxt, n + 1) - 1)::INT line_end, line hunk FROM s WHERE starts_with(line, '@@')"""


# A window ends at the last line that fits after those it repeats; the next begins with the last six lines.
_WINDOWS = r"""WITH RECURSIVE t AS (SELECT DISTINCT ON (raw_id) raw_id file_id, source_path path, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) l FROM raw_files WHERE content IS NOT NULL AND NOT regexp_matches(source_path, '\.(py|go|c|h|js)$')),
x AS (SELECT *, list_transform(l, lambda s: CASE WHEN length(s) > 2400 THEN length(rtrim(s[:2378])) + 17 ELSE length(s) END + 1) n FROM t),
p AS (SELECT *, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[:i])) s FROM x),
w AS (SELECT file_id, 1::BIGINT b, greatest(1, len(list_filter(s, lambda v: v <= 2400))) e FROM p
  UNION ALL SELECT w.file_id, greatest(w.b, w.e - 5), greatest(w.e + 1, len(list_filter(p.s, lambda v: v <= 2400 + coalesce(p.s[greatest(w.b, w.e - 5) - 1], 0)))) FROM w JOIN p ON p.file_id = w.file_id WHERE w.e < len(p.s))
SELECT w.file_id, path || '::chunk::' || lpad(b::VARCHAR, 6, '0') || '-' || lpad(e::VARCHAR, 6, '0') record_id, b::INT line_start, e::INT line_end FROM w JOIN p ON p.file_id = w.file_id WHERE trim(array_to_string(p.l[b:e], ''), E' \t\n\r\f\v') <> ''"""


def _scan() -> str:
    """Every line with the two after it, the strings in triple quotes taken out by their own numbers of breaks."""
    quoted = Y.BLOCK.replace("'", "''")
    names = "|".join(p[2:].split("\\s")[0] for p, _, _ in Y.PATTERNS if p.startswith("\\b"))
    hit = lambda p: f"regexp_matches(line, '\\b{p[2:].split(chr(92) + 's')[0]}\\b') AND regexp_matches(w, '{p}')" if p.startswith("\\b") else f"regexp_matches(line, '{p}') AND language NOT IN ({', '.join(map(repr, Y.QUOTING_BACKTICKS))})"
    rules = " UNION ALL ".join(f"SELECT file_id, i, '{r}' rule_id, '{v}' severity FROM c WHERE {hit(p)}" for p, r, v in Y.PATTERNS)
    return _RAW + f""", l AS (SELECT file_id, CASE ext WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.js' THEN 'javascript' WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' WHEN '.sh' THEN 'shell' END AS language, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM raw),
b AS (SELECT file_id, language, t, regexp_extract_all(t, '{quoted}') q, string_split_regex(t, '{quoted}') p FROM l WHERE language IS NOT NULL),
u AS (SELECT file_id, language, CASE WHEN language = 'python' THEN array_to_string(list_transform(range(1, len(p) + 1), lambda k: p[k] || repeat(chr(10), length(coalesce(q[k], '')) - length(replace(coalesce(q[k], ''), chr(10), '')))), '') ELSE t END AS t FROM b),
x AS (SELECT file_id, language, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) i FROM u),
w AS (SELECT *, concat_ws(chr(10), line, lead(line) OVER o, lead(line, 2) OVER o) w FROM x WINDOW o AS (PARTITION BY file_id ORDER BY i)),
c AS (SELECT * FROM w WHERE regexp_matches(line, '\\b(?:{names})\\b|`') AND NOT (language IN ('python', 'shell') AND starts_with(trim(line, ' '), '#')) AND NOT (language IN ('go', 'javascript', 'c') AND regexp_matches(trim(line, ' '), '^(?://|/\\*|\\*)'))),
f AS (SELECT DISTINCT * FROM ({rules}))
SELECT rule_id, severity, count(*) n_hits FROM f GROUP BY ALL"""


_SCAN = _scan()
SQL = {
    "referenced_symbols": _RAW + f"SELECT file_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)), lambda x: x NOT IN ({', '.join(repr(k) for k in X.NON_CALLS)}) AND NOT (ext = '.py' AND x IN ({', '.join(repr(k) for k in keyword.kwlist)}))))[:160], ',') symbols FROM raw",
    "common_extracts": _RAW + "SELECT file_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(CONFIG_[A-Za-z0-9_]+)\\b', 1)))[:120], ',') config_symbols, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?m)^\\s*#\\s*include\\s+[<\"]([^>\"]+)[>\"]', 1)))[:80], ',') includes, len(list_filter(list_distinct(regexp_extract_all(text, '\"([^\"\\n]{4,160})\"', 1)), lambda x: NOT starts_with(x, '$('))[:80])::INT n_strings FROM raw",
    "json_members": _RAW + "SELECT key, count(*) n FROM (SELECT unnest(json_keys(text)) AS key FROM raw WHERE ext = '.json' AND json_valid(text) AND json_type(text) = 'OBJECT' AND NOT regexp_matches(text, ',\\s*[}\\]]')) GROUP BY 1",
    "profile_doc": "SELECT doc_id, key, least(80, len(list_distinct(v)))::INT n_vals FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key, regexp_extract_all(text, '{p}', 1) v FROM documents" for k, p in X.PROFILES["doc"]) + ") WHERE len(v) > 0",
    "profile_python": _profile("python", ".py"),
    "profile_go": _profile("go", ".go"),
    "profile_javascript": _profile("javascript", ".js"),
    "profile_c": _profile("c", ".c"),
    "profile_split": f"SELECT file_id, count(*)::INT n_file_keys, coalesce(max('go_package') FILTER (WHERE key = 'go_package'), '') record_keys, max(split_part(vals, ',', 1)) FILTER (WHERE key = 'go_package') go_package FROM ({_profile('go', '.go')}) GROUP BY 1",
    "profile_module": "SELECT DISTINCT ON (raw_id) raw_id file_id, " + module_name("source_path").replace("'(?:/__init__)?[.]py$', '')", "'(?:/__init__)?[.]py$', '')").replace("'/', '.')", "'/', '.', 'g')") + " python_module FROM raw_files WHERE source_path LIKE '%.py'",
    "line_windows": _WINDOWS,
    "doc_sections": _DOCS,
    "patch_hunks": _HUNKS,
    "security_scan": _SCAN,
}
