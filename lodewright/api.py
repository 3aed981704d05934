"""The ten questions as functions over an index folder; each gives a DataFrame, limits are clamped, filters checked."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright import tables as T
from lodewright.operators import findings as X
from lodewright.operators import graph as G
from lodewright.operators import mining as M
from lodewright.operators import search as S
from lodewright.operators import semantic as V
from lodewright.operators import versions as W

EQUAL = ("collection", "repo", "record_type", "language", "file_role", "content_class", "confidence_kind", "symbol", "parent_record_id")
FLAGS = ("is_generated", "is_vendor", "is_test", "is_source", "is_build", "is_config", "is_doc")
MOST, MOST_FILES, MOST_TARGETS = 50, 500, 25


def clamp(n: int, most: int) -> int:
    return max(1, min(int(n), most))


def normal_path(path: str, name: str = "source_path") -> str:
    """Slashes forward, no leading ./, no slash at the ends; absolute paths are refused."""
    p = path.replace("\\", "/")
    if p.startswith("/") or p[1:3] == ":/":
        raise ValueError(f"{name} must be relative")
    while p.startswith("./"):
        p = p[2:]
    return p.strip("/")


def conditions(df: DataFrame, filters: dict) -> DataFrame:
    """df where filters hold: equal columns, source_path or source_path_prefix, flags (false counts), metadata_key with
    metadata_value, metadata_contains (a JSON object of plain values)."""
    known = {*EQUAL, *FLAGS, "source_path", "source_path_prefix", "metadata_key", "metadata_value", "metadata_contains"}
    if extra := set(filters) - known:
        raise ValueError(f"unknown filters: {sorted(extra)}")
    if filters.get("source_path") and filters.get("source_path_prefix"):
        raise ValueError("source_path and source_path_prefix exclude each other")
    tests = [F.col(c) == filters[c] for c in EQUAL if filters.get(c) not in (None, "")]
    tests += [F.coalesce(F.col(c), F.lit(False)) == bool(filters[c]) for c in FLAGS if filters.get(c) is not None]
    p = F.col("source_path")
    if filters.get("source_path"):
        q = normal_path(filters["source_path"])
        repo = filters.get("repo")
        tests.append(p.isin(q, f"{repo}/{q}") if repo else (p == q) | p.endswith("/" + q))
    if filters.get("source_path_prefix"):
        q = normal_path(filters["source_path_prefix"], "source_path_prefix") + "/"
        repo = filters.get("repo")
        tests.append(p.startswith(q) | p.startswith(f"{repo}/{q}") if repo else p.startswith(q) | F.contains(p, F.lit("/" + q)))
    at = lambda key: F.get_json_object("metadata", f"$['{key}']")
    if filters.get("metadata_key"):
        key = filters["metadata_key"].replace("'", "")
        has = F.array_contains(F.json_object_keys("metadata"), key)
        tests.append(at(key) == str(filters["metadata_value"]) if filters.get("metadata_value") is not None else has)
    for key, value in (filters.get("metadata_contains") or {}).items():
        tests.append(at(key.replace("'", "")) == (str(value).lower() if isinstance(value, bool) else str(value)))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


@dataclass
class Index:
    """An index folder read at the newest snapshot of each repo, at one snapshot, or with all history."""

    spark: SparkSession
    folder: str
    snapshot_id: int | None = None
    historical: bool = False
    warnings: list[str] = field(default_factory=list)

    def scope(self) -> DataFrame | None:
        if self.historical:
            return None
        s = T.snapshots(self.spark, self.folder)
        return s.filter(F.col("id") == self.snapshot_id).select(F.col("id").alias("snapshot_id")) if self.snapshot_id else W.latest_scope(s)

    def files(self, *cols: str) -> DataFrame:
        return T.files(self.spark, self.folder, *cols, scope=self.scope())

    def records(self, filters: dict | None = None) -> DataFrame:
        """Records with their file's flags; with history a row per snapshot that lists them, and unlisted ones too."""
        f = self.files("collection", "repo", "file_sha256", *FLAGS).withColumn("file_sha256", F.coalesce("file_sha256", F.lit("")))
        r = T.records(self.spark, self.folder)
        return conditions(r.join(f, ["collection", "repo", "source_path", "file_sha256"], "left" if self.historical else "inner"), filters or {})

    def edges(self) -> DataFrame:
        return T.edges(self.spark, self.folder, scope=self.scope())

    def definitions(self) -> DataFrame:
        return self.records({"record_type": "symbol_definition"})

    def code_intel_status(self) -> DataFrame:
        f = self.files("collection", "repo", "skipped_reason", "size_bytes").groupBy("collection", "repo").agg(F.count(F.lit(1)).alias("n_files"), F.count("skipped_reason").alias("n_skipped"), F.sum("size_bytes").alias("n_bytes"))
        r = T.records(self.spark, self.folder, "collection", "repo", "CASE WHEN embedding IS NOT NULL THEN 1 END AS e").groupBy("collection", "repo").agg(F.count(F.lit(1)).alias("n_records"), F.count("e").alias("n_embedded"))
        e = self.edges().groupBy("collection", "repo").agg(F.count(F.lit(1)).alias("n_edges"), F.count("target_record_id").alias("n_resolved"))
        return f.join(r, ["collection", "repo"], "full").join(e, ["collection", "repo"], "full")

    def search_code_intel_text(self, query: str, limit: int = 20, filters: dict | None = None) -> DataFrame:
        stage, df = S.planned_search(self.records(filters), query, clamp(limit, MOST))
        self.warnings = [] if stage in ("websearch", "list") else [f"fallback: {stage}"]
        return df.withColumn("snippet", S.snippet(F.col("display_content"), S.query_terms(query)))

    def search_code_intel_semantic(self, query: str, vector: list[float], limit: int = 20, filters: dict | None = None, diversify: bool | None = None) -> DataFrame:
        filters = filters or {}
        spread = diversify if diversify is not None else not (filters.get("parent_record_id") or filters.get("source_path"))
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
        return V.semantic_search(self.records(filters).filter((F.size("embedding") == len(vector)) & fine), vector, query, filters, clamp(limit, MOST), spread)

    def get_code_intel_record(self, record_ids: list[str], most_chars: int = 32_768) -> DataFrame:
        """The newest row of each id in the order asked, with found and truncated."""
        asked = self.spark.createDataFrame(list(enumerate(record_ids)), "place int, record_id string")
        one = W.newest_per(T.records(self.spark, self.folder, "record_id", "record_type", "title", "source_path", "line_start", "line_end", "display_content", "updated_at", where=F.col("record_id").isin(*record_ids)), "record_id", order=("updated_at", "id"))
        out = asked.join(one, "record_id", "left").orderBy("place")
        return out.withColumns({"found": F.col("id").isNotNull(), "truncated": F.length("display_content") > most_chars, "display_content": F.left("display_content", F.lit(most_chars))})

    def related_code_intel(self, symbol: str, limit: int = 20, include_unresolved: bool = True) -> DataFrame:
        return G.related(self.edges(), symbol, clamp(limit, MOST), include_unresolved)

    def blast_radius(self, symbol: str, source_path: str | None = None, line: int | None = None) -> DataFrame:
        """For at most 25 definitions of a symbol, or of a member of that name."""
        d = self.definitions().filter((F.col("symbol") == symbol) | F.col("symbol").endswith("." + symbol))
        if source_path:
            d = d.filter(F.col("source_path").endswith(normal_path(source_path)))
        if line is not None:
            d = d.filter(F.lit(line).between(F.col("line_start"), F.col("line_end")))
        d = d.orderBy("source_path", "line_start", "id").limit(MOST_TARGETS)
        return G.blast_radius(d, self.edges(), self.files("is_test"))

    def find_redundancy(self, threshold: float = M.THRESHOLD, limit: int = 20) -> DataFrame:
        scores = M.motif_scores(M.function_nodes(self.definitions(), self.edges()), threshold)
        act = F.col("recommendation") != "leave-as-is"
        return scores.orderBy(F.desc(act), F.desc("net"), F.desc("k"), F.desc_nulls_last("est_loc"), "cluster").limit(clamp(limit, MOST))

    def list_code_intel_files(self, limit: int = 100, only_skipped: bool = False, filters: dict | None = None) -> DataFrame:
        f = conditions(self.files(), filters or {})
        return (f.filter("skipped_reason IS NOT NULL") if only_skipped else f).orderBy("source_path", "snapshot_id").limit(clamp(limit, MOST_FILES))

    @staticmethod
    def search_static_findings(findings: DataFrame, rule_id: str | None = None, level: str | None = None, tool: str | None = None, limit: int = 20) -> DataFrame:
        for c, v in (("rule_id", rule_id), ("level", level), ("tool", tool)):
            findings = findings.filter(F.col(c) == v) if v else findings
        return findings.orderBy("path", "run_index", "result_index").limit(clamp(limit, MOST))

    @staticmethod
    def get_static_finding(findings: DataFrame, finding_key: str) -> dict[str, DataFrame]:
        """The finding, its locations, and its code flows."""
        one = findings.filter(F.col("finding_key") == finding_key)
        return {"finding": one, "locations": X.sarif_locations(one), "code_flows": X.sarif_code_flows(one)}


def register(spark: SparkSession) -> None:
    """Table functions for SQL: line_windows(text) and definitions(language, text)."""
    from pyspark.sql.functions import udtf

    from lodewright.parse import chunks

    class LineWindows:
        def eval(self, text: str):
            for w in chunks.line_windows(list(enumerate((text or "").split("\n"), 1))):
                yield w[0][0], w[-1][0], "\n".join(x for _, x in w)

    class Definitions:
        def eval(self, language: str, text: str):
            try:
                found = chunks.python_definitions(text or "") if language == "python" else chunks.brace_definitions(text or "", language) if language in chunks.BRACES else []
            except (SyntaxError, ValueError):
                found = []
            yield from found

    spark.udtf.register("line_windows", udtf(LineWindows, returnType="line_start int, line_end int, body string"))
    spark.udtf.register("definitions", udtf(Definitions, returnType="symbol string, kind string, line_start int, line_end int"))
