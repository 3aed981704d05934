"""Queries over the index tables: classification, scopes, retention, merges, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright import tables as T
from lodewright.functions import classify as C
from lodewright.operators import versions as V

VIEWS = """
WITH s AS (SELECT DISTINCT ON (id) * FROM project_code_intel_snapshots),
f AS (SELECT * REPLACE (lower(file_sha256) AS file_sha256, lower(git_blob_sha) AS git_blob_sha) FROM (SELECT DISTINCT ON (snapshot_id, source_path) * FROM project_code_intel_files ORDER BY snapshot_id, source_path, created_at DESC, id DESC)),
r AS (SELECT * REPLACE (lower(file_sha256) AS file_sha256) FROM (SELECT DISTINCT ON (id) * FROM project_code_intel_records)),
e AS (SELECT * REPLACE (nullif(source_record_id, '') AS source_record_id, nullif(target_record_id, '') AS target_record_id, nullif(source_symbol, '') AS source_symbol, nullif(target_symbol, '') AS target_symbol, nullif(target_path, '') AS target_path) FROM (SELECT DISTINCT ON (id) * FROM project_code_intel_edges)),
latest AS (SELECT DISTINCT ON (collection, repo) id AS snapshot_id, collection, repo FROM s ORDER BY collection, repo, created_at DESC, id DESC),
lf AS (SELECT f.* FROM f JOIN latest USING (snapshot_id))
"""


def latest_files(spark, d, *cols):
    return T.files(spark, d, *cols, scope=V.latest_scope(T.snapshots(spark, d)))


def files_classify(spark, d):
    p = F.col("repo_rel_path")
    paths = T.table(spark, d, "project_code_intel_files").select("repo_rel_path").distinct()
    lang = C.language(p)
    fl = C.flags(p, lang)
    return paths.select("repo_rel_path", lang.alias("language"), *[v.alias(k) for k, v in fl.items()], C.content_class(lang, fl).alias("content_class"), C.file_role(p, C.content_class(lang, fl)).alias("file_role"))


def content_flags(spark, d):
    raw = T.table(spark, d, "raw_files").dropDuplicates(["raw_id"])
    lang = C.refined_language(F.col("source_path"), F.col("content"))
    return raw.select("raw_id", lang.alias("language"), C.flags(F.col("source_path"), lang, F.col("content"))["is_generated"].alias("is_generated"))


def file_signatures(spark, d):
    f = T.files(spark, d, "file_sha256", "git_blob_sha", "size_bytes", "skipped_reason")
    return f.select("snapshot_id", "source_path", C.signature(F.col("file_sha256"), F.col("git_blob_sha"), F.col("size_bytes"), F.col("skipped_reason")).alias("signature"))


def collection_slugs(spark, d):
    return T.snapshots(spark, d).select("collection", "repo").distinct().select("repo", C.slug(F.concat_ws("/", "collection", "repo")).alias("slug"))


def files_list_filtered(spark, d):
    """The file list tool: source files that are no tests, first 500 by path."""
    f = latest_files(spark, d, "repo", "language", "file_role", "size_bytes", "is_source", "is_test", "skipped_reason").filter("is_source AND NOT coalesce(is_test, false) AND skipped_reason IS NULL AND language = 'python'")
    return f.select("source_path", "repo", "language", "file_role", "size_bytes").orderBy("source_path", "repo").limit(500)


def path_prefix_filter(spark, d):
    f, p = T.files(spark, d, "id"), F.col("source_path")
    under = p.startswith("src/") | F.contains(p, F.lit("/src/"))
    exact = p.endswith("/README.md") | (p == "README.md")
    return f.filter(under | exact).groupBy("snapshot_id").agg(F.count_if(under).alias("n_under"), F.count_if(exact).alias("n_exact"))


def _member(spark, d, cols, how="inner"):
    r = T.records(spark, d, "collection", "repo", "source_path", "file_sha256", *cols).withColumnRenamed("id", "record_pk")
    f = T.files(spark, d, "collection", "repo", "file_sha256").withColumn("file_sha256", F.coalesce("file_sha256", F.lit("")))
    return r.join(f, ["collection", "repo", "source_path", "file_sha256"], how)


def membership_join(spark, d):
    return _member(spark, d, ["record_type"]).groupBy("snapshot_id", "record_type").agg(F.count(F.lit(1)).alias("n_records"))


def membership_left(spark, d):
    """Records per type that no snapshot lists, and rows with history."""
    m = _member(spark, d, ["record_type"], "left")
    return m.groupBy("record_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("snapshot_id").isNull()).alias("n_unlisted"))


def snapshot_latest_per_repo(spark, d):
    return V.newest_per(T.snapshots(spark, d), "collection", "repo").select("collection", "repo", "id", "commit_sha")


def snapshot_latest_per_branch(spark, d):
    return V.newest_per(T.snapshots(spark, d), "collection", "repo", "branch").select("collection", "repo", "branch", "id")


def snapshot_branch_preferred(spark, d):
    return V.branch_preferred(T.snapshots(spark, d), "main").select("collection", "repo", "branch", "id")


def snapshot_prune(spark, d):
    return V.prune(T.snapshots(spark, d), 2).select("collection", "repo", "id")


def snapshot_dead_branches(spark, d):
    return V.prune_dead_branches(T.snapshots(spark, d), ["main"]).select("collection", "repo", "branch", "id")


def change_detection(spark, d):
    """The newest snapshot of each repo against the one before it on any branch, by file signature."""
    from pyspark.sql import Window

    s = T.snapshots(spark, d).select("id", "collection", "repo", "created_at")
    r = s.withColumn("n", F.row_number().over(Window.partitionBy("collection", "repo").orderBy(F.desc("created_at"), F.desc("id")))).filter("n <= 2").select(F.col("id").alias("snapshot_id"), "n")
    sig = file_signatures(spark, d).join(r, "snapshot_id").join(T.snapshots(spark, d).select(F.col("id").alias("snapshot_id"), "collection", "repo"), "snapshot_id")
    keys = ["collection", "repo", "source_path"]
    return V.changed_paths(sig.filter("n = 2"), sig.filter("n = 1"), keys).groupBy("collection", "repo", "state").agg(F.count(F.lit(1)).alias("n_paths"))


RECORD_KEY = ["collection", "repo", "source_path", "file_sha256", "record_type", "record_id", "embedding_text_hash"]


def records_upsert_merge(spark, d):
    """Records of even ids merged with those of odd ids, by the content key; an embedding is kept if the new one is null."""
    r = T.records(spark, d, *RECORD_KEY, "title", "summary", "CASE WHEN embedding IS NOT NULL THEN true END AS has_embedding")
    m = V.merge_latest(r.filter("id % 2 = 0"), r.filter("id % 2 = 1"), RECORD_KEY, "id", ["summary"], ("has_embedding",))
    return m.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.count("has_embedding").alias("n_embedded"), F.sum("id").alias("sum_id"), F.sum(F.length("summary")).alias("summary_chars"))


EDGE_KEY = ["snapshot_id", "source_record_id", "target_record_id", "edge_type", "source_symbol", "target_symbol", "source_path", "target_path"]


def edges_insert_dedupe(spark, d):
    e = T.edges(spark, d).select("id", *EDGE_KEY)
    out = V.insert_new(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), EDGE_KEY, "id")
    return out.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("id").alias("sum_id"))


def edges_copy_forward(spark, d):
    """Edges of the previous snapshot whose source path is unchanged, under the newest snapshot's id."""
    from pyspark.sql import Window

    s = T.snapshots(spark, d).select("id", "collection", "repo", "created_at")
    w = Window.partitionBy("collection", "repo").orderBy(F.desc("created_at"), F.desc("id"))
    pair = s.withColumn("n", F.row_number().over(w)).withColumn("prev", F.lead("id").over(w)).filter("n = 1 AND prev IS NOT NULL").select(F.col("id").alias("new_id"), F.col("prev").alias("snapshot_id"))
    sig = file_signatures(spark, d)
    same = pair.join(sig, "snapshot_id").join(sig.select(F.col("snapshot_id").alias("new_id"), "source_path", "signature"), ["new_id", "source_path", "signature"]).select("snapshot_id", "new_id", "source_path")
    e = T.edges(spark, d).select("id", "snapshot_id", "source_path")
    return e.join(same, ["snapshot_id", "source_path"]).groupBy(F.col("new_id").alias("snapshot_id")).agg(F.count(F.lit(1)).alias("n_copied"))


def orphan_sweep(spark, d):
    """Records that no counting file row of any snapshot lists."""
    r = T.records(spark, d, "collection", "repo", "source_path", "file_sha256", "record_type")
    f = T.files(spark, d, "collection", "repo", "file_sha256").select("collection", "repo", "source_path", F.coalesce("file_sha256", F.lit("")).alias("file_sha256")).distinct()
    return r.join(f, ["collection", "repo", "source_path", "file_sha256"], "left_anti").select("id", "record_type")


def status_counts(spark, d):
    r = T.records(spark, d, "collection", "repo", "record_type", "CASE WHEN embedding IS NOT NULL THEN 1 END AS e")
    return r.groupBy("collection", "repo", "record_type").agg(F.count(F.lit(1)).alias("n_records"), F.count("e").alias("n_embedded"))


def status_filtered_counts(spark, d):
    f = latest_files(spark, d, "collection", "repo", "skipped_reason", "is_untracked", "indexed_dirty", "is_generated", "size_bytes")
    return f.groupBy("collection", "repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("skipped_reason").isNotNull()).alias("n_skipped"), F.count_if("is_untracked").alias("n_untracked"),
        F.count_if("indexed_dirty").alias("n_dirty"), F.count_if("is_generated").alias("n_generated"), F.sum("size_bytes").alias("n_bytes"),
    )


def edges_by_type(spark, d):
    e = T.edges(spark, d)
    return e.groupBy("collection", "repo", "edge_type").agg(F.count(F.lit(1)).alias("n_edges"), F.count("target_record_id").alias("n_resolved"))


def language_breakdown(spark, d):
    return latest_files(spark, d, "collection", "repo", "language", "size_bytes").groupBy("collection", "repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("n_bytes"))


def directory_breakdown(spark, d):
    """Files per directory of depth two; files of the root count under '.'; the 100 largest."""
    parts = F.split("repo_rel_path", "/")
    deep = F.least(F.lit(2), F.size(parts) - 1)
    where = F.when(F.size(parts) <= 1, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(deep, F.lit(1))), "/"))
    return latest_files(spark, d, "repo", "repo_rel_path").groupBy("repo", where.alias("directory")).agg(F.count(F.lit(1)).alias("n_files")).orderBy(F.desc("n_files"), "repo", "directory").limit(100)


def dimension_values(spark, d):
    f = latest_files(spark, d, "language", "file_role", "content_class")
    pair = F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("language", "file_role", "content_class")]))
    return f.select(pair).filter("value <> ''").distinct()


def queryable_types(spark, d):
    """Per repo the record types without any embedding, and with some."""
    r = T.records(spark, d, "collection", "repo", "record_type", "CASE WHEN embedding IS NOT NULL THEN 1 END AS e")
    t = r.groupBy("collection", "repo", "record_type").agg(F.count("e").alias("n"))
    every, some = F.collect_set("record_type"), F.collect_set(F.when(F.col("n") > 0, F.col("record_type")))
    g = t.groupBy("collection", "repo").agg(every.alias("a"), some.alias("s"))
    return g.select("collection", "repo", F.array_join(F.array_sort("s"), ",").alias("queryable"), F.array_join(F.array_sort(F.array_except("a", "s")), ",").alias("not_queryable"))


def ingest_report(spark, d):
    f = latest_files(spark, d, "skipped_reason", "language", "content_class")
    pair = F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c), F.lit("-")).alias("value")) for c in ("skipped_reason", "language", "content_class")]))
    files = f.select(pair)
    r = T.records(spark, d, "record_type", "confidence_kind")
    more = r.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in ("record_type", "confidence_kind")])))
    return files.unionByName(more).groupBy("counter", "value").agg(F.count(F.lit(1)).alias("n"))


def embedding_contract(spark, d):
    """Distinct vector lengths per repo, and whether there is exactly one."""
    r = T.records(spark, d, "collection", "repo", "size(embedding) AS dim", where="embedding IS NOT NULL")
    g = r.groupBy("collection", "repo").agg(F.countDistinct("dim").alias("n_dims"), F.min("dim").alias("least_dim"), F.max("dim").alias("most_dim"))
    return g.withColumn("consistent", F.col("n_dims") == 1)


def text_percentiles(spark, d):
    """Nearest-rank percentiles of text lengths per kind of document."""
    t = T.table(spark, d, "documents").filter("text IS NOT NULL").select("doc_kind", F.length("text").alias("n"))
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)").cast("long")
    return t.groupBy("doc_kind").agg(F.min("n").cast("long").alias("n_min"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("n").cast("long").alias("n_max"), F.round(F.avg("n"), 4).alias("n_mean"), F.sum(F.ceil(F.col("n") / 4)).alias("tokens_estimated"))


def embedding_pending(spark, d):
    """Chunks and sections still without an embedding, with the text that would be sent, cut at 3000 characters."""
    r = T.records(spark, d, "record_type", "embedding_text", where="record_type IN ('code_chunk', 'doc_section') AND embedding IS NULL")
    text = F.when(F.length("embedding_text") > 3000, F.concat(F.rtrim(F.left("embedding_text", F.lit(2980))), F.lit("\n[truncated]"))).otherwise(F.col("embedding_text"))
    return r.select("id", "record_type", F.length(text).alias("n_chars"))


_SQL_PATH = "repo_rel_path"
_SQL_NAME = "regexp_extract(repo_rel_path, '[^/]*$')"
_SQL_LANG = "CASE " + f"WHEN lower(regexp_extract({_SQL_NAME}, '^.+(\\.[^.]+)$', 1)) IN ({', '.join(repr(x) for x in C.C_SUFFIXES)}) THEN 'c' WHEN {_SQL_NAME} = 'Makefile' THEN 'make' " + f"WHEN {_SQL_NAME} IN ('Dockerfile', 'Containerfile') THEN 'dockerfile' " + " ".join(f"WHEN lower(regexp_extract({_SQL_NAME}, '^.+(\\.[^.]+)$', 1)) IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in C.SUFFIXES.items()) + " ELSE 'text' END"


def _in(vals):
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


_CLASSIFY = f"""
WITH p AS (SELECT DISTINCT repo_rel_path, {_SQL_NAME} AS name, string_split(repo_rel_path, '/') AS parts, {_SQL_LANG} AS language FROM project_code_intel_files),
q AS (SELECT *, list_has_any(list_transform(parts, lambda x: lower(x)), ['generated', 'autogenerated']) OR contains(lower(name), 'generated')
    OR language = 'go' AND list_has_any(list_transform(parts, lambda x: lower(x)), ['applyconfiguration', 'clientset', 'informers', 'listers']) AND list_has_any(list_transform(parts, lambda x: lower(x)), ['client', 'pkg']) AS is_generated,
  list_has_any(parts, ['vendor', 'third_party', '3rdparty']) AS is_vendor, list_has_any(parts, ['test', 'tests', 'testing', 'selftests']) OR contains(lower(name), 'test') AS is_test,
  language IN {_in(C.SOURCE)} AS is_source, language IN {_in(C.BUILD_LANGUAGES)} OR contains(repo_rel_path, '/cmake/') OR lower(name) IN {_in(C.BUILD_NAMES)} AS is_build,
  language IN {_in(C.CONFIG_LANGUAGES)} OR contains(name, 'Config') AS is_config, language = 'doc' OR parts[1] IN ('docs', 'doc', 'Documentation') AS is_doc FROM p),
c AS (SELECT *, CASE WHEN language = 'patch' THEN 'patch' WHEN is_doc THEN 'doc' WHEN is_build THEN 'build' WHEN is_config THEN 'config' WHEN is_test THEN 'test' WHEN is_vendor THEN 'vendor' WHEN is_generated THEN 'generated' WHEN is_source THEN 'source' ELSE 'other' END AS content_class FROM q)
SELECT repo_rel_path, language, is_generated, is_vendor, is_test, is_source, is_build, is_config, is_doc, content_class,
  CASE WHEN contains(repo_rel_path, '/init.d/') THEN 'runtime-service' WHEN starts_with(repo_rel_path, 'package/') THEN 'package' WHEN starts_with(repo_rel_path, 'include/') THEN 'source-include'
    WHEN starts_with(repo_rel_path, 'scripts/') OR starts_with(repo_rel_path, 'tools/') THEN 'tooling' ELSE content_class END AS file_role FROM c
"""
_SIG = VIEWS + ", sig AS (SELECT snapshot_id, source_path, CASE WHEN coalesce(file_sha256, '') <> '' THEN 'sha256:' || file_sha256 WHEN coalesce(git_blob_sha, '') <> '' THEN 'blob:' || git_blob_sha ELSE 'meta:' || size_bytes || ':' || coalesce(skipped_reason, '') END AS signature FROM f)"
_PAIR = ", rn AS (SELECT id, collection, repo, row_number() OVER w n, lead(id) OVER w prev FROM s WINDOW w AS (PARTITION BY collection, repo ORDER BY created_at DESC, id DESC))"
_MEMBER = "r {how} JOIN f ON f.collection = r.collection AND f.repo = r.repo AND f.source_path = r.source_path AND r.file_sha256 = coalesce(f.file_sha256, '')"

QUERIES = {f.__name__: f for f in (
    files_classify, content_flags, file_signatures, collection_slugs, files_list_filtered, path_prefix_filter, membership_join, membership_left, snapshot_latest_per_repo,
    snapshot_latest_per_branch, snapshot_branch_preferred, snapshot_prune, snapshot_dead_branches, change_detection, records_upsert_merge, edges_insert_dedupe,
    edges_copy_forward, orphan_sweep, status_counts, status_filtered_counts, edges_by_type, language_breakdown, directory_breakdown, dimension_values, queryable_types,
    ingest_report, embedding_contract, text_percentiles, embedding_pending)}

_FLAGS = f"""WITH w AS (SELECT DISTINCT ON (raw_id) raw_id, source_path AS repo_rel_path, content FROM raw_files),
x AS (SELECT raw_id, content, {_SQL_NAME} AS name, string_split(lower(repo_rel_path), '/') AS parts, repo_rel_path, {_SQL_LANG} AS by_path FROM w),
y AS (SELECT *, CASE WHEN content IS NULL THEN by_path WHEN by_path = 'c' AND repo_rel_path ILIKE '%.h' AND regexp_matches(left(content, 8192), '@interface|@protocol|@implementation|#import') THEN 'objective_c' ELSE by_path END AS language FROM x)
SELECT raw_id, language, list_has_any(parts, ['generated', 'autogenerated']) OR contains(lower(name), 'generated') OR language = 'go' AND list_has_any(parts, ['applyconfiguration', 'clientset', 'informers', 'listers']) AND list_has_any(parts, ['client', 'pkg'])
  OR coalesce(regexp_matches(left(content, 4096), '{C.GENERATED_HEADER}'), false) AS is_generated FROM y"""

SQL = {
    "files_classify": _CLASSIFY,
    "content_flags": _FLAGS,
    "file_signatures": _SIG + "SELECT * FROM sig",
    "collection_slugs": VIEWS + "SELECT repo, CASE WHEN length(p) <= 63 THEN p ELSE left(p, 54) || '_' || left(sha256(t), 8) END slug FROM (SELECT repo, t, trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_') p FROM (SELECT DISTINCT repo, concat_ws('/', collection, repo) t FROM s))",
    "files_list_filtered": VIEWS + "SELECT source_path, repo, language, file_role, size_bytes FROM lf WHERE is_source AND NOT coalesce(is_test, false) AND skipped_reason IS NULL AND language = 'python' ORDER BY source_path, repo LIMIT 500",
    "path_prefix_filter": VIEWS + "SELECT snapshot_id, count(*) FILTER (WHERE u) n_under, count(*) FILTER (WHERE x) n_exact FROM (SELECT snapshot_id, source_path LIKE 'src/%' OR source_path LIKE '%/src/%' u, source_path = 'README.md' OR source_path LIKE '%/README.md' x FROM f) WHERE u OR x GROUP BY 1",
    "membership_join": VIEWS + f"SELECT f.snapshot_id, r.record_type, count(*) n_records FROM {_MEMBER.format(how='')} GROUP BY ALL",
    "membership_left": VIEWS + f"SELECT r.record_type, count(*) n_rows, count(*) FILTER (WHERE f.snapshot_id IS NULL) n_unlisted FROM {_MEMBER.format(how='LEFT')} GROUP BY ALL",
    "snapshot_latest_per_repo": VIEWS + "SELECT DISTINCT ON (collection, repo) collection, repo, id, commit_sha FROM s ORDER BY collection, repo, created_at DESC, id DESC",
    "snapshot_latest_per_branch": VIEWS + "SELECT DISTINCT ON (collection, repo, branch) collection, repo, branch, id FROM s ORDER BY collection, repo, branch, created_at DESC, id DESC",
    "snapshot_branch_preferred": VIEWS + "SELECT DISTINCT ON (collection, repo) collection, repo, branch, id FROM s ORDER BY collection, repo, coalesce(branch = 'main', false) DESC, id DESC",
    "snapshot_prune": VIEWS + "SELECT collection, repo, id FROM (SELECT *, row_number() OVER (PARTITION BY collection, repo ORDER BY created_at DESC, id DESC) k FROM (SELECT *, row_number() OVER (PARTITION BY collection, repo, coalesce(branch, '') ORDER BY created_at DESC, id DESC) b FROM s) WHERE b > 1) WHERE k > 2",
    "snapshot_dead_branches": VIEWS + "SELECT collection, repo, branch, id FROM s WHERE branch <> 'main' AND id NOT IN (SELECT snapshot_id FROM latest)",
    "change_detection": _SIG + _PAIR + ", n1 AS (SELECT rn.collection, rn.repo, sig.* FROM rn JOIN sig ON sig.snapshot_id = rn.id WHERE n = 1), n2 AS (SELECT rn.collection, rn.repo, sig.* FROM rn JOIN sig ON sig.snapshot_id = rn.id WHERE n = 2) SELECT coalesce(n1.collection, n2.collection) collection, coalesce(n1.repo, n2.repo) repo, CASE WHEN n2.signature IS NULL THEN 'new' WHEN n1.signature IS NULL THEN 'deleted' WHEN n1.signature <> n2.signature THEN 'changed' ELSE 'unchanged' END state, count(*) n_paths FROM n1 FULL JOIN n2 ON n1.collection = n2.collection AND n1.repo = n2.repo AND n1.source_path = n2.source_path GROUP BY ALL",
    "records_upsert_merge": VIEWS + f", k AS (SELECT id, {', '.join(RECORD_KEY)}, summary, embedding IS NOT NULL h FROM r), o AS (SELECT * FROM k WHERE id % 2 = 0), n AS (SELECT DISTINCT ON ({', '.join(RECORD_KEY)}) * FROM k WHERE id % 2 = 1 ORDER BY {', '.join(RECORD_KEY)}, id DESC) SELECT coalesce(o.record_type, n.record_type) record_type, count(*) n, count(*) FILTER (WHERE coalesce(o.h, false) OR coalesce(n.h, false)) n_embedded, sum(coalesce(o.id, n.id)) sum_id, sum(length(coalesce(n.summary, o.summary))) summary_chars FROM o FULL JOIN n ON {' AND '.join(f'o.{c} IS NOT DISTINCT FROM n.{c}' for c in RECORD_KEY)} GROUP BY 1",
    "edges_insert_dedupe": VIEWS + f", k AS (SELECT id, snapshot_id, concat_ws('|', {', '.join(f'coalesce({c}::VARCHAR, {chr(39)*2})' for c in EDGE_KEY)}) key FROM e), n AS (SELECT DISTINCT ON (key) * FROM k WHERE id % 2 = 1 AND key NOT IN (SELECT key FROM k WHERE id % 2 = 0) ORDER BY key, id) SELECT snapshot_id, count(*) n_edges, sum(id) sum_id FROM (SELECT * FROM k WHERE id % 2 = 0 UNION ALL SELECT * FROM n) GROUP BY 1",
    "edges_copy_forward": _SIG + _PAIR + "SELECT rn.id snapshot_id, count(*) n_copied FROM rn JOIN sig a ON a.snapshot_id = rn.prev JOIN sig b ON b.snapshot_id = rn.id AND b.source_path = a.source_path AND b.signature = a.signature JOIN e ON e.snapshot_id = rn.prev AND e.source_path = a.source_path WHERE n = 1 GROUP BY 1",
    "orphan_sweep": VIEWS + "SELECT id, record_type FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.collection = r.collection AND f.repo = r.repo AND f.source_path = r.source_path AND r.file_sha256 = coalesce(f.file_sha256, ''))",
    "status_counts": VIEWS + "SELECT collection, repo, record_type, count(*) n_records, count(embedding) n_embedded FROM r GROUP BY ALL",
    "status_filtered_counts": VIEWS + "SELECT collection, repo, count(*) n_files, count(skipped_reason) n_skipped, count(*) FILTER (WHERE is_untracked) n_untracked, count(*) FILTER (WHERE indexed_dirty) n_dirty, count(*) FILTER (WHERE is_generated) n_generated, sum(size_bytes)::BIGINT n_bytes FROM lf GROUP BY ALL",
    "edges_by_type": VIEWS + "SELECT collection, repo, edge_type, count(*) n_edges, count(target_record_id) n_resolved FROM e GROUP BY ALL",
    "language_breakdown": VIEWS + "SELECT collection, repo, language, count(*) n_files, sum(size_bytes)::BIGINT n_bytes FROM lf GROUP BY ALL",
    "directory_breakdown": VIEWS + "SELECT repo, CASE WHEN len(p) <= 1 THEN '.' ELSE array_to_string(p[1:greatest(1, least(2, len(p) - 1))], '/') END directory, count(*) n_files FROM (SELECT repo, string_split(repo_rel_path, '/') p FROM lf) GROUP BY ALL ORDER BY n_files DESC, repo, directory LIMIT 100",
    "dimension_values": VIEWS + "SELECT DISTINCT dimension, value FROM (SELECT language, file_role, content_class FROM lf) UNPIVOT (value FOR dimension IN (language, file_role, content_class)) WHERE value <> ''",
    "queryable_types": VIEWS + ", t AS (SELECT collection, repo, record_type, count(embedding) n FROM r GROUP BY ALL) SELECT collection, repo, coalesce(string_agg(record_type, ',' ORDER BY record_type) FILTER (WHERE n > 0), '') queryable, coalesce(string_agg(record_type, ',' ORDER BY record_type) FILTER (WHERE n = 0), '') not_queryable FROM t GROUP BY ALL",
    "ingest_report": VIEWS + "SELECT counter, value, count(*) n FROM (SELECT 'skipped_reason' counter, coalesce(skipped_reason, '-') AS value FROM lf UNION ALL SELECT 'language', coalesce(language, '-') FROM lf UNION ALL SELECT 'content_class', coalesce(content_class, '-') FROM lf UNION ALL SELECT 'record_type', record_type FROM r UNION ALL SELECT 'confidence_kind', confidence_kind FROM r) GROUP BY ALL",
    "embedding_contract": VIEWS + "SELECT collection, repo, count(DISTINCT len(embedding)) n_dims, min(len(embedding))::INT least_dim, max(len(embedding))::INT most_dim, count(DISTINCT len(embedding)) = 1 consistent FROM r WHERE embedding IS NOT NULL GROUP BY ALL",
    "text_percentiles": "SELECT doc_kind, min(n) n_min, quantile_disc(n, 0.5) p50, quantile_disc(n, 0.95) p95, max(n) n_max, round(avg(n), 4) n_mean, sum(ceil(n / 4))::BIGINT tokens_estimated FROM (SELECT doc_kind, length(text) n FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "embedding_pending": VIEWS + "SELECT id, record_type, CASE WHEN length(embedding_text) > 3000 THEN length(rtrim(left(embedding_text, 2980), ' ')) + 12 ELSE length(embedding_text) END n_chars FROM r WHERE record_type IN ('code_chunk', 'doc_section') AND embedding IS NULL",
}
