"""Whole records and call edges from parsed pieces, as column expressions: texts, frames, digests, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.parse import extracts as X
from lodewright.parse.security import PATTERNS

EMBEDDED_BODY, MAX_EDGES, LISTED = 4000, 80, 40  # fixed values
#: Metadata that stand in the embedding text, in this order (fixed values).
EMBEDDED = "symbol symbol_kind target subtarget config_symbols symbols_defined symbols_referenced includes dts_compatibles security_sensitive_apis security_contexts boundary_candidates log_error_messages".split()
PLAIN_FENCE = ("doc", "text")
#: Of a file's profile metadata only these go on to its records (fixed value).
PROPAGATED = ("go_package",)


def fence(body) -> Column:
    """A fence longer than any run of backticks in body."""
    longest = F.array_max(F.transform(F.regexp_extract_all(body, F.lit("`+"), 0), lambda x: F.length(x)))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def display(title, repo, role, file_role, content_class, line_start, line_end, symbol, rule_id, language, body) -> Column:
    """The record as Markdown: heading, list of facts, fenced body. Null facts have no line."""
    fact = lambda name, v: F.concat(F.lit(f"- {name}: `"), v, F.lit("`"))
    lines = F.concat(F.lit("- Lines: "), line_start.cast("string"), F.lit("-"), line_end.cast("string"))
    given = lambda c: F.when(c != "", c)
    head = F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), fact("Repo", repo), fact("Role", role), fact("File role", file_role), fact("Content class", content_class), lines, fact("Symbol", given(symbol)), fact("Rule", given(rule_id)))
    info = F.when(language.isin(*PLAIN_FENCE), "").otherwise(F.coalesce(language, F.lit("")))
    return F.concat(head, F.lit("\n\n"), fence(body), info, F.lit("\n"), body, F.lit("\n"), fence(body))


def embedding_text(record_type, title, summary, body, metadata: dict[str, Column] | None = None) -> Column:
    """What is embedded: type, title, summary, the named metadata that are set, the first EMBEDDED_BODY characters of the body.

    Metadata columns are strings or arrays of strings, of which LISTED are named.
    """
    meta = [F.when(F.length(v) > 0, F.concat(F.lit(f"{k}: "), v)) for k in EMBEDDED if (v := (metadata or {}).get(k)) is not None]
    content = F.when(F.length(body) > 0, F.concat(F.lit("content:\n"), F.left(body, F.lit(EMBEDDED_BODY))))
    return F.concat_ws("\n", F.concat(F.lit("type: "), record_type), F.concat(F.lit("title: "), title), F.concat(F.lit("summary: "), summary), *meta, content)


def record_metadata(file_metadata, file_only: list[str]) -> Column:
    """The part of a file's metadata map that its records take over."""
    return F.map_filter(file_metadata, lambda k, v: ~k.isin(*[x for x in file_only if x not in PROPAGATED]))


def security_apis(body) -> Column:
    """Rules whose pattern stands in body, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(r)) for p, r, _ in PATTERNS]))))


def assemble(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Whole records of parsed (file_id, record_type, record_id, parent_record_id, symbol, symbol_kind, line_start, line_end,
    body, refs) and files (file_id, collection, repo, repo_role, source_path, language, file_role, content_class, file_sha256).

    embedding and updated_at are left to the stores; hashes are of the texts as they are. A file's row is joined once.
    """
    r = parsed.join(files, "file_id")
    path, lines = F.col("source_path"), F.concat(F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    named, kind = F.col("symbol").isNotNull(), F.col("symbol_kind")
    place = F.concat(F.lit(" in "), path, F.lit(":"), lines)
    title = (
        F.when(named & (F.col("record_type") == "code_chunk"), F.concat("symbol", F.lit(" body"), place))
        .when(named, F.concat("symbol", place))
        .otherwise(F.concat(path, F.lit(":"), lines))
    )
    summary = (
        F.when(named & (F.col("record_type") == "code_chunk"), F.concat("language", F.lit(" "), kind, F.lit(" chunk for "), "symbol"))
        .when(named, F.concat("language", F.lit(" "), kind, F.lit(" definition "), "symbol", F.lit(" in "), path))
        .otherwise(F.concat(F.col("language"), F.lit(" "), F.replace("record_type", F.lit("_"), F.lit(" ")), F.lit(" of "), path))
    )
    e = X.common_extracts(F.col("body"))
    lists = {"config_symbols": e["config_symbols"], "symbols_defined": F.when(named, F.array("symbol")), "symbols_referenced": F.when(F.size("refs") > 0, F.col("refs")), "includes": e["includes"], "security_sensitive_apis": security_apis(F.col("body")), "log_error_messages": e["log_error_messages"]}
    shown = {"symbol": F.col("symbol"), "symbol_kind": kind} | {k: F.array_join(F.slice(v, 1, LISTED), ", ") for k, v in lists.items()}
    meta = F.to_json(F.struct(F.col("symbol"), kind, *[F.when(F.size(v) > 0, v).alias(k) for k, v in lists.items()]))
    none = F.lit(None).cast("string")
    r = r.withColumns({"title": title, "summary": summary})
    r = r.withColumns({
        "metadata": meta,
        "embedding_text": embedding_text(F.col("record_type"), F.col("title"), F.col("summary"), F.col("body"), shown),
        "display_content": display(F.col("title"), F.col("repo"), F.col("repo_role"), F.col("file_role"), F.col("content_class"), F.col("line_start"), F.col("line_end"), F.col("symbol"), none, F.col("language"), F.col("body")),
    })
    hashes = {"embedding_text_hash": F.sha2("embedding_text", 256), "display_hash": F.sha2("display_content", 256), "confidence_kind": F.when(F.col("record_type") == "symbol_definition", "high_confidence_fact").otherwise("approximate_fact"), "parser": F.col("language")}
    return r.withColumns(hashes).drop("body", "refs")


def call_edges(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of the definitions of parsed: at most MAX_EDGES names each, the definition's own left out."""
    d = parsed.filter("record_type = 'symbol_definition'").select("file_id", F.col("record_id").alias("source_record_id"), F.col("symbol").alias("source_symbol"), F.slice(F.array_sort(F.array_distinct("refs")), 1, MAX_EDGES).alias("refs"))
    d = d.select("file_id", "source_record_id", "source_symbol", F.explode("refs").alias("target_symbol"))
    d = d.filter((F.col("target_symbol") != F.col("source_symbol")) & (F.col("target_symbol") != F.substring_index("source_symbol", ".", -1)))
    kind = F.when(F.contains("target_symbol", F.lit(".")), "member").otherwise("direct")
    out = d.join(files.select("file_id", "collection", "repo", "source_path"), "file_id")
    return out.withColumns({"target_record_id": F.lit(None).cast("string"), "edge_type": F.lit("call_candidate"), "confidence_kind": F.lit("heuristic_candidate"), "metadata": F.to_json(F.struct(kind.alias("call_kind")))})
