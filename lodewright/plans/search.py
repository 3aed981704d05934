"""Queries of text and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright import tables as T
from lodewright.operators import search as S
from lodewright.operators import semantic as M
from lodewright.operators import versions as V
from lodewright.plans.index import VIEWS

COLS = ["collection", "repo", "source_path", "file_sha256", "file_role", "content_class", "record_type", "record_id", "parent_record_id", "title", "summary", "embedding_text", "display_content", "line_start", "line_end", "symbol", "symbol_kind", "updated_at"]
_USABLE_VECTOR = "size(embedding) = 48 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
QUERY, LIMIT = "emit_event store wallet", 40


def latest_records(spark, d, *more, where=None):
    """Records visible in the newest snapshot of their repo, one row each, with its flags; only those where a condition on them holds."""
    f = T.files(spark, d, "collection", "repo", "file_sha256", "is_generated", "is_test", scope=V.latest_scope(T.snapshots(spark, d))).filter("file_sha256 IS NOT NULL").drop("snapshot_id")
    return T.records(spark, d, *COLS, *more, where=where).join(f, ["collection", "repo", "source_path", "file_sha256"])


def _matching(spark, d, query, mode="any"):
    """Records that search may return: what a search filters on is tested before anything is shuffled."""
    terms = S.query_terms(query)
    return latest_records(spark, d, where=S.all_terms(terms) if mode == "all" else S.any_terms(terms))


def text_any_terms(spark, d):
    return S.text_search(_matching(spark, d, QUERY), QUERY, LIMIT, "any").select("id", "rank", "match_score")


def text_all_terms(spark, d):
    return S.text_search(_matching(spark, d, "emit_event limit", "all"), "emit_event limit", LIMIT, "all").select("id", "match_score")


def text_match_score(spark, d):
    r = latest_records(spark, d)
    return r.groupBy(S.match_score(S.query_terms(QUERY)).alias("match_score")).agg(F.count(F.lit(1)).alias("n"))


def text_enumerate(spark, d):
    return S.planned_search(latest_records(spark, d), "and or", LIMIT)[1].select("id", "source_path", "line_start")


def text_planned(spark, d):
    return S.planned_search(latest_records(spark, d), "emit_event", LIMIT)[1].select("id", "match_score")


FULL = '"emit event" OR renames -python'


def text_full(spark, d):
    return S.full_text(latest_records(spark, d), FULL, LIMIT).select("id", "rank", "match_score")


def text_location_dedupe(spark, d):
    top = S.text_search(_matching(spark, d, QUERY), QUERY, LIMIT, "any")
    return S.location_dedupe(top, [F.desc("rank"), F.desc("match_score"), F.desc("updated_at"), F.desc("id")]).select("id", "record_type", "source_path", "line_start", "line_end")


def text_snippet(spark, d):
    r = T.records(spark, d, "display_content", where="record_type = 'code_chunk'")
    return r.select("id", S.snippet(F.col("display_content"), ["emit_event", "store"]).alias("snippet"))


def record_fetch(spark, d):
    """Newest row of each record_id by (updated_at, id), with content cut at FETCHED characters and a flag."""
    r = T.records(spark, d, "record_id", "updated_at", "display_content")
    one = V.newest_per(r, "record_id", order=("updated_at", "id"))
    return one.select("id", "record_id", F.left("display_content", F.lit(FETCHED)).alias("content"), (F.length("display_content") > FETCHED).alias("truncated"))


def metadata_filter(spark, d):
    """Records whose metadata has a key, and those that hold a value."""
    r = T.records(spark, d, "record_type", "metadata")
    keys = F.json_object_keys("metadata")
    has = F.array_contains(keys, "symbols_defined")
    holds = F.array_contains(F.from_json(F.get_json_object("metadata", "$.symbols_defined"), "array<string>"), "emit_event")
    return r.groupBy("record_type").agg(F.count_if(has).alias("n_key"), F.count_if(holds).alias("n_value"))


def metadata_equals(spark, d):
    e = T.edges(spark, d)
    kind = F.get_json_object("metadata", "$.call_kind")
    return e.filter(kind == "member").groupBy("repo").agg(F.count(F.lit(1)).alias("n_edges"))


def _vector(spark, d):
    """The query vector: the embedding of the least usable record, one row."""
    return T.table(spark, d, "project_code_intel_records").filter("size(embedding) = 48 AND exists(embedding, x -> x <> 0)").orderBy("id").select("embedding").first()[0]


def semantic_knn(spark, d):
    r = T.records(spark, d, "embedding", where=_USABLE_VECTOR)
    v = F.array(*[F.lit(float(x)) for x in _vector(spark, d)])
    out = r.select("id", (1 - M.cosine(F.col("embedding"), v)).alias("distance")).filter("distance IS NOT NULL").orderBy("distance", "id").limit(50)
    return out.select("id", F.round("distance", 6).alias("distance"))


def semantic_blended_rank(spark, d):
    r = latest_records(spark, d, "embedding", where=_USABLE_VECTOR)
    out = M.semantic_search(r, _vector(spark, d), "build and render wallet", {}, 30, diversify=False)
    return out.select("id", F.round("key", 6).alias("key"))


def semantic_diversified(spark, d):
    r = latest_records(spark, d, "embedding", where=_USABLE_VECTOR)
    return M.semantic_search(r, _vector(spark, d), "build and render wallet", {}, 30).select("id", F.round("similarity", 6).alias("similarity"))


def pairwise_cosine_by_label(spark, d):
    e = T.table(spark, d, "embeddings")
    return M.pairwise_by_group(e, "label", "vec_id", "embedding").select("label", "n_pairs", F.round("mean_cosine", 9).alias("mean_cosine"))


ASKS, FETCHED = "vec_id % 100 = 0", 32_768  # the vectors that ask, against all rows; the most characters of a fetched record


def _neighbours(spark, d, k, most):
    e = T.table(spark, d, "embeddings")
    q = e.filter(ASKS).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return M.nearest_to(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k, most)


def neighbours_threshold(spark, d):
    return _neighbours(spark, d, 10, 0.7).select("query_id", "id", F.round("distance", 6).alias("distance"))


def addside_nearest(spark, d):
    """The four nearest of each new definition under the gate, then the three best over all."""
    near = _neighbours(spark, d, 4, 0.75)
    return near.orderBy("distance", "query_id", "id").limit(3).select("query_id", "id", F.round("distance", 6).alias("distance"))


def semantic_low_match(spark, d):
    """Queries whose best neighbour is below the similarity that tells of a match."""
    near = _neighbours(spark, d, 1, None)
    return near.select("query_id", (1 - F.col("distance") < M.LOW_MATCH).alias("low_match"))


QUERIES = {f.__name__: f for f in (
    text_any_terms, text_all_terms, text_match_score, text_enumerate, text_planned, text_full, text_location_dedupe, text_snippet, record_fetch, metadata_filter, metadata_equals,
    semantic_knn, semantic_blended_rank, semantic_diversified, pairwise_cosine_by_label, neighbours_threshold, addside_nearest, semantic_low_match)}

_LR = VIEWS + ", lr AS (SELECT r.*, lf.is_generated FROM r JOIN lf ON lf.collection = r.collection AND lf.repo = r.repo AND lf.source_path = r.source_path AND lf.file_sha256 = r.file_sha256)"


def _score(terms, config=True):
    def one(t):
        low = t.lower()
        has = lambda c: f"contains(lower(coalesce({c}, '')), '{low}')"
        parts = [(f"coalesce(symbol, '') = '{t}'", 120), (f"lower(coalesce(symbol, '')) = '{low}'", 80), (f"lower(coalesce(title, '')) = '{low}'", 32), (f"starts_with(lower(coalesce(symbol, '')), '{low}')", 20), (has("title"), 12), (has("source_path"), 8), (has("record_id"), 6), (has("summary"), 4), (has("display_content"), 1)]
        return " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in parts)

    return " + ".join(one(t) for t in terms)


_WHOLE = "lower(concat_ws(' ', title, summary, symbol, source_path, record_id, display_content))"
_TERMS = ["emit_event", "store", "wallet"]
_RANK = " + ".join(f"contains({_WHOLE}, '{t}')::INT" for t in _TERMS)
_ANY = f"SELECT *, {_RANK} rank, {_score(_TERMS)} match_score FROM lr WHERE record_type <> 'security_pattern' AND ({_RANK}) > 0 ORDER BY rank DESC, match_score DESC, updated_at DESC, id DESC LIMIT {LIMIT}"
_USABLE = "len(embedding) = 48 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_V = ", v AS (SELECT embedding::DOUBLE[48] q FROM r WHERE len(embedding) = 48 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY id LIMIT 1)"
_BOOST = ["build", "render", "wallet", "generate", "add", "config", "configuration", "template"]
_VALID = " OR ".join(f"contains(lower(coalesce({c}, '')), 'validat')" for c in ("symbol", "title", "source_path", "record_id"))
_KEYED = _LR + _V + f", u AS (SELECT lr.*, 1 - array_cosine_similarity(embedding::DOUBLE[48], q) d FROM lr, v WHERE {_USABLE}), kd AS (SELECT *, round(d + CASE WHEN record_type = 'code_chunk' AND symbol IS NULL AND line_end - line_start + 1 <= 3 AND length(display_content) < 120 THEN 0.35 ELSE 0 END - 0.01 * least({_score(_BOOST)}, 80) - CASE WHEN symbol_kind IN ('function', 'method', 'shell_function') THEN 0.12 ELSE 0 END + CASE WHEN symbol_kind IN ('struct', 'interface', 'type') THEN 0.18 ELSE 0 END + CASE WHEN {_VALID} THEN 0.16 ELSE 0 END - CASE WHEN file_role = 'source' THEN 0.16 ELSE 0 END + CASE WHEN content_class <> 'source' THEN 0.18 ELSE 0 END + CASE WHEN coalesce(is_generated, false) THEN 0.24 ELSE 0 END, 9) AS key FROM u)"
_NEAR = "WITH n AS (SELECT a.vec_id query_id, b.vec_id id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"
_BODY = r"nullif(rtrim(regexp_extract(display_content, '(?s)(?:^|\n)`{3,}[^\n`]*\n(.*?)\n?`{3,}\s*$', 1), ' '), '')"

_STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 3 THEN left(w, length(w) - {len(e)}) || '{to}'" for e, to in S._SUFFIX) + " ELSE w END"
_STOP = ", ".join(f"'{w}'" for w in sorted(S.STOP))
_FIELDS = {"title": (1.0, True), "source_path": (1.0, False), "symbol": (1.0, False), "summary": (0.4, True), "record_type": (0.4, False), "embedding_text": (0.2, True)}


def _lexemes(c: str, stemmed: bool) -> str:
    words = f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
    return f"list_transform(list_filter({words}, lambda w: w NOT IN ({_STOP})), lambda w: {_STEM})" if stemmed else words


def _hit(parts: list[str], c: str) -> str:
    return f"list_contains(l_{c}, '{parts[0]}')" if len(parts) == 1 else f"contains(' ' || array_to_string(l_{c}, ' ') || ' ', ' {' '.join(parts)} ')"


def _full() -> str:
    alternatives = S.parse_web_query(FULL)
    some = lambda p: "(" + " OR ".join(_hit(p, c) for c in _FIELDS) + ")"
    match = " OR ".join("(" + " AND ".join(some(p) if want else f"NOT {some(p)}" for want, p in alt) + ")" for alt in alternatives)
    hits = " + ".join(f"CASE WHEN {_hit(p, c)} THEN {w} ELSE 0 END" for alt in alternatives for want, p in alt if want for c, (w, _) in _FIELDS.items())
    lists = ", ".join(f"{_lexemes(c, stemmed)} l_{c}" for c, (_, stemmed) in _FIELDS.items())
    ranked = f"SELECT *, round(({hits}) / (1 + ln(1 + len(l_embedding_text))), 9) rank, {_score(S.query_terms(FULL))} match_score FROM lx WHERE {match}"
    return _LR + f", lx AS (SELECT *, {lists} FROM lr) SELECT id, rank, match_score FROM ({ranked}) ORDER BY rank DESC, match_score DESC, updated_at DESC, id DESC LIMIT {LIMIT}"


SQL = {
    "text_full": _full(),
    "text_any_terms": _LR + f"SELECT id, rank, match_score FROM ({_ANY})",
    "text_all_terms": _LR + f"SELECT id, {_score(['emit_event', 'limit'])} match_score FROM lr WHERE record_type <> 'security_pattern' AND contains({_WHOLE}, 'emit_event') AND contains({_WHOLE}, 'limit') ORDER BY match_score DESC, updated_at DESC, id DESC LIMIT {LIMIT}",
    "text_match_score": _LR + f"SELECT {_score(_TERMS)} match_score, count(*) n FROM lr GROUP BY 1",
    "text_enumerate": _LR + f"SELECT id, source_path, line_start FROM lr ORDER BY source_path NULLS LAST, line_start NULLS LAST, id LIMIT {LIMIT}",
    "text_planned": _LR + f"SELECT id, {_score(['emit_event'])} match_score FROM lr WHERE record_type <> 'security_pattern' AND contains({_WHOLE}, 'emit_event') ORDER BY match_score DESC, updated_at DESC, id DESC LIMIT {LIMIT}",
    "text_location_dedupe": _LR + f"SELECT id, record_type, source_path, line_start, line_end FROM ({_ANY}) QUALIFY row_number() OVER (PARTITION BY source_path, line_start, line_end ORDER BY CASE record_type WHEN 'code_chunk' THEN 0 WHEN 'symbol_definition' THEN 1 ELSE 99 END, rank DESC, match_score DESC, updated_at DESC, id DESC) = 1 OR line_start IS NULL OR line_end IS NULL",
    "text_snippet": VIEWS + f", b AS (SELECT id, {_BODY} body FROM r WHERE record_type = 'code_chunk'), p AS (SELECT *, length(body) n, least(nullif(instr(lower(body), 'emit_event'), 0), nullif(instr(lower(body), 'store'), 0)) - 1 p FROM b), w AS (SELECT *, greatest(0, least(p - 100, n - 200)) s0 FROM p), x AS (SELECT *, 200 - CASE WHEN s0 > 0 THEN 3 ELSE 0 END - CASE WHEN s0 + 200 < n THEN 3 ELSE 0 END wd FROM w), y AS (SELECT *, greatest(0, least(p - wd // 2, n - wd)) st FROM x) SELECT id, CASE WHEN n <= 200 OR p IS NULL THEN rtrim(left(body, 200), ' ') ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || rtrim(substr(body, (st + 1)::BIGINT, wd::BIGINT), ' ') || CASE WHEN st + wd < n THEN '...' ELSE '' END END snippet FROM y",
    "record_fetch": VIEWS + "SELECT DISTINCT ON (record_id) id, record_id, left(display_content, 32768) AS content, length(display_content) > 32768 truncated FROM r ORDER BY record_id, updated_at DESC, id DESC",
    "metadata_filter": VIEWS + "SELECT record_type, count(*) FILTER (WHERE json_exists(metadata, '$.symbols_defined')) n_key, count(*) FILTER (WHERE list_contains(json_extract_string(metadata, '$.symbols_defined[*]'), 'emit_event')) n_value FROM r GROUP BY 1",
    "metadata_equals": VIEWS + "SELECT repo, count(*) n_edges FROM e WHERE json_extract_string(metadata, '$.call_kind') = 'member' GROUP BY 1",
    "semantic_knn": VIEWS + _V + f"SELECT id, round(d, 6) distance FROM (SELECT id, 1 - array_cosine_similarity(embedding::DOUBLE[48], q) d FROM r, v WHERE {_USABLE} ORDER BY d, id LIMIT 50)",
    "semantic_blended_rank": _KEYED + "SELECT id, round(key, 6) AS key FROM (SELECT * FROM kd ORDER BY key, d, id DESC LIMIT 30)",
    "semantic_diversified": _KEYED + "SELECT id, round(1 - d, 6) similarity FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(parent_record_id, record_id) ORDER BY key, d, id DESC) > 1 late FROM (SELECT * FROM kd ORDER BY key, d, id DESC LIMIT 120)) ORDER BY late, key, d, id DESC LIMIT 30",
    "pairwise_cosine_by_label": "SELECT a.label, count(*) n_pairs, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) mean_cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1",
    "neighbours_threshold": _NEAR + "SELECT query_id, id, round(distance, 6) distance FROM n WHERE distance <= 0.7 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10",
    "addside_nearest": _NEAR + "SELECT query_id, id, round(distance, 6) distance FROM (SELECT * FROM n WHERE distance <= 0.75 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 4) ORDER BY n.distance, query_id, id LIMIT 3".replace("n.distance", "distance"),
    "semantic_low_match": _NEAR + "SELECT query_id, max(1 - distance) < 0.4 low_match FROM n GROUP BY 1",
}
