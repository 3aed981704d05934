"""Queries over writes, assembled records and the shape of answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodewright import tables as T
from lodewright.functions import classify as C
from lodewright.operators import graph as G
from lodewright.operators import mining as M
from lodewright.operators import shaping as H
from lodewright.operators import stores as S
from lodewright.operators import versions as V
from lodewright.parse import assemble as A
from lodewright.plans import code as Q
from lodewright.plans import ops as O
from lodewright.plans.index import _PAIR, VIEWS
from lodewright.plans.search import latest_records

CALLERS, CALLEES, PAGE = 25, 40, 500
BODY = r"(?s)\n`{3,}[^\n]*\n(.*)\n`{3,}$"


def snapshots_upsert(spark, d):
    """Every third snapshot scanned again, on another branch and with a new schema; even ones hold an embedding contract."""
    s = T.snapshots(spark, d).select("id", *S.SNAPSHOT_KEY, "repo_role", "branch", "dirty", "metadata")
    old = s.withColumn("metadata", F.when(F.col("id") % 2 == 0, S.merged_json(F.col("metadata"), F.lit('{"embedding_contract":{"dimension":48}}'))).otherwise(F.col("metadata")))
    new = s.filter("id % 3 = 0").withColumns({"branch": F.lit("again"), "dirty": F.lit(True), "metadata": F.lit('{"schema_version":"next"}')})
    out = S.upsert_snapshots(old, new)
    field = lambda k: F.get_json_object("metadata", f"$.{k}")
    return out.select("id", "branch", "dirty", field("schema_version").alias("schema_version"), field("parser_version").alias("parser_version"), field("embedding_contract.dimension").alias("dimension"))


def failures_insert(spark, d):
    """Skipped files as failures with long errors, those of even snapshots known before."""
    f = T.files(spark, d, "language", "skipped_reason").filter("skipped_reason IS NOT NULL")
    f = f.select("snapshot_id", "source_path", "language", F.lit(None).cast("string").alias("parser"), F.repeat("skipped_reason", F.lit(200)).alias("error"))
    out = S.insert_failures(f.filter("snapshot_id % 2 = 0"), f)
    return out.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_failures"), F.max(F.length("error")).alias("longest"), F.min("parser").alias("parser"))


def embeddings_update(spark, d):
    """Chunks and sections without a vector: even ids get one, odd ones are marked as skipped."""
    r = T.records(spark, d, "record_type", "metadata", "embedding", where="record_type IN ('code_chunk', 'doc_section')")
    due = r.filter("embedding IS NULL")
    done = due.filter("id % 2 = 0").select("id", F.array_repeat(F.lit(0.5).cast("float"), 48).alias("embedding"), F.lit("unit").alias("model"))
    skip = due.filter("id % 2 = 1").select("id", F.repeat(F.lit("too long; "), 80).alias("reason"), F.lit(800).alias("max_chars"))
    out = S.update_embeddings(r, done, skip)
    has = lambda k: F.get_json_object("metadata", f"$.{k}")
    return out.groupBy("record_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("embedding").alias("n_embedded"), F.count(has("embedding_model")).alias("n_stamped"), F.count_if(has("embedding_skipped") == "true").alias("n_skipped"),
        F.max(F.length(has("embedding_skip_reason"))).alias("longest_reason"), F.count(has("symbols_defined")).alias("n_defining"),
    )


def snapshots_stamp(spark, d):
    s = T.snapshots(spark, d)
    ids = V.latest_scope(s).select(F.col("snapshot_id").alias("id"))
    out = S.stamp_types(s.select("id", "metadata"), ids, ["doc_section", "code_chunk"])
    return out.select("id", F.get_json_object("metadata", "$.embed_record_types").alias("types"), F.get_json_object("metadata", "$.schema_version").alias("schema_version"))


def _scoped_findings(spark, d):
    f = O._findings(spark, d)
    return f.select((F.col("user_id") % 5).cast("string").alias("collection"), F.lit("r").alias("repo"), F.when(F.col("user_id") % 2 == 1, "main").alias("branch"), "fingerprint", "rule_id", "level", "ts")


def baseline_freeze(spark, d):
    """Baselines of the first half of the time, those of three collections frozen again with the second half."""
    f = _scoped_findings(spark, d)
    old, new = f.filter(f"ts < TIMESTAMP_NTZ '{O.SPLIT}'").drop("ts"), f.filter(f"ts >= TIMESTAMP_NTZ '{O.SPLIT}' AND collection < '3'").drop("ts")
    return S.freeze_baseline(old, new).groupBy("collection", "branch").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("fingerprint").alias("n_fingerprints"))


def repo_replace(spark, d):
    """Rows left without the first repo of the largest collection."""
    s = T.snapshots(spark, d).select("id", "collection", "repo")
    one = s.groupBy("collection", "repo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "collection", "repo").first()
    f = T.table(spark, d, "project_code_intel_files").select("snapshot_id", "collection", "repo")
    out = S.without_repo(one["collection"] if one else "", one["repo"] if one else "", s, files=f, edges=T.edges(spark, d).select("snapshot_id", "collection", "repo"), records=T.records(spark, d, "collection", "repo"))
    parts = [t.agg(F.lit(k).alias("table_name"), F.count(F.lit(1)).alias("n_left")) for k, t in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def scan_reuse(spark, d):
    """Files of the newest snapshot of each repo whose text need not be read again, against the snapshot before it."""
    s = T.snapshots(spark, d).select("id", "collection", "repo", "created_at")
    w = Window.partitionBy("collection", "repo").orderBy(F.desc("created_at"), F.desc("id"))
    pair = s.withColumn("n", F.row_number().over(w)).withColumn("prev", F.lead("id").over(w)).filter("n = 1 AND prev IS NOT NULL").select(F.col("id").alias("snapshot_id"), "prev")
    f = T.files(spark, d, "git_blob_sha", "indexed_dirty")
    key = F.concat_ws("\t", F.col("snapshot_id").cast("string"), "source_path")
    now = f.join(pair.select("snapshot_id"), "snapshot_id").select("snapshot_id", key.alias("source_path"), "git_blob_sha", "indexed_dirty")
    before = f.join(pair.select(F.col("prev").alias("snapshot_id"), F.col("snapshot_id").alias("now")), "snapshot_id").select(F.concat_ws("\t", F.col("now").cast("string"), "source_path").alias("source_path"), "git_blob_sha")
    out = S.reusable_files(before, now, now.filter("indexed_dirty"))
    return out.groupBy("snapshot_id").agg(F.count_if("reused").alias("n_reused"), F.count_if(~F.col("reused")).alias("n_read"))


def snapshot_headers(spark, d):
    """The id of each snapshot's tree, with a fingerprint of what is dirty in it."""
    dirty = T.files(spark, d, "indexed_dirty", "file_sha256").filter("indexed_dirty")
    dirty = dirty.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "source_path", F.coalesce("file_sha256", F.lit("-"))))).alias("p"))
    print_ = dirty.select(F.col("snapshot_id").alias("id"), F.sha2(F.array_join("p", "\n"), 256).alias("fingerprint"))
    out = T.snapshots(spark, d).select("id", "tree_sha").join(print_, "id", "left")
    return out.select("id", S.tree_id(F.col("tree_sha"), F.col("fingerprint")).alias("tree_sha"), F.col("fingerprint").isNotNull().alias("dirty"))


def parse_gate(spark, d):
    f = T.files(spark, d, "repo_rel_path", "language", "skipped_reason")
    return f.groupBy("language", C.should_parse(F.col("repo_rel_path"), F.col("language"), F.col("skipped_reason")).alias("parsed")).agg(F.count(F.lit(1)).alias("n_files"))


def record_texts(spark, d):
    """The embedding text and the frame of every record, assembled anew from its facts and its body."""
    r = T.records(spark, d, "record_type", "title", "summary", "repo", "file_role", "content_class", "line_start", "line_end", "symbol", "symbol_kind", "rule_id", "language", "display_content", "metadata")
    body = F.regexp_extract("display_content", BODY, 1)
    defined = F.array_join(F.from_json(F.get_json_object("metadata", "$.symbols_defined"), "array<string>"), ", ")
    text = A.embedding_text(F.col("record_type"), F.col("title"), F.col("summary"), body, {"symbol": F.col("symbol"), "symbol_kind": F.col("symbol_kind"), "symbols_defined": defined})
    shown = A.display(F.col("title"), F.col("repo"), F.lit("library"), F.col("file_role"), F.col("content_class"), F.col("line_start"), F.col("line_end"), F.col("symbol"), F.col("rule_id"), F.col("language"), body)
    return r.select("id", F.md5(text).alias("embedding_md5"), F.md5(shown).alias("display_md5"))


def _assembled(spark, d):
    from lodewright.functions.classify import content_class, file_role, flags, language
    from lodewright.parse.chunks import parse_files

    raw = T.table(spark, d, "raw_files").dropDuplicates(["raw_id"])
    p = F.regexp_replace("source_path", "^[^/]*/", "")
    lang = language(p)
    fl = flags(p, lang)
    klass = content_class(lang, fl)
    files = raw.select(F.col("raw_id").alias("file_id"), "collection", "repo", F.lit("").alias("repo_role"), "source_path", lang.alias("language"), file_role(p, klass).alias("file_role"), klass.alias("content_class"), "file_sha256")
    parsed = parse_files(raw.select(F.col("raw_id").alias("file_id"), F.col("source_path").alias("path"), lang.alias("language"), F.col("content").alias("text")))
    return parsed, files


def assembled_records(spark, d):
    """Whole records of all raw files, by language and type."""
    r = A.assemble(*_assembled(spark, d))
    return r.groupBy("language", "record_type").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("embedding_text_hash").alias("n_texts"), F.countDistinct("display_hash").alias("n_displays"), F.sum(F.length("embedding_text")).alias("n_chars"))


def assembled_edges(spark, d):
    """Call edges of all raw files, by repo and kind of call."""
    e = A.call_edges(*_assembled(spark, d))
    return e.groupBy("repo", F.get_json_object("metadata", "$.call_kind").alias("call_kind")).agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("target_symbol").alias("n_targets"))


def definition_bodies(spark, d):
    """The chunks of each definition of the newest snapshots as one text, in order of their lines."""
    c = latest_records(spark, d, where="record_type = 'code_chunk' AND parent_record_id IS NOT NULL")
    g = c.groupBy("collection", "repo", "source_path", "file_sha256", "parent_record_id").agg(F.array_sort(F.collect_list(F.struct("line_start", "id", "display_content"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["display_content"]), "\n")
    return g.select("collection", "repo", "source_path", "parent_record_id", F.size("c").alias("n_chunks"), F.md5(text).alias("text_md5"))


def evidence_lists(spark, d):
    """Callers of each definition and what it calls, the first 25 and 40 by name with totals."""
    e = Q._edges(spark, d).filter("edge_type = 'call_candidate' AND NOT source_record_id <=> target_record_id")
    callers = H.with_total(e.filter("target_record_id IS NOT NULL AND source_symbol IS NOT NULL").withColumnRenamed("target_record_id", "record_id"), ["snapshot_id", "record_id"], "source_symbol", CALLERS, "callers")
    callees = H.with_total(e.filter("source_record_id IS NOT NULL AND target_symbol IS NOT NULL").withColumnRenamed("source_record_id", "record_id"), ["snapshot_id", "record_id"], "target_symbol", CALLEES, "callees")
    both = callers.join(callees, ["snapshot_id", "record_id"], "full")
    return both.select("snapshot_id", "record_id", F.array_join("callers", ",").alias("callers"), "n_callers", "callers_cut", F.array_join("callees", ",").alias("callees"), "n_callees", "callees_cut")


def compact_records(spark, d):
    """Which fields the compact form of each record of the newest snapshots has, and its length."""
    r = latest_records(spark, d, "language", "metadata", where="record_type <> 'module_chunk'")
    fields = {c: F.col(c) for c in ("record_type", "record_id", "parent_record_id", "title", "source_path", "language", "symbol", "symbol_kind", "line_start", "is_generated", "metadata")}
    flags = ("is_generated",)
    return r.select("id", F.array_join(H.compact_keys(fields, flags), ",").alias("keys"), F.size(F.json_object_keys(H.compact(fields, flags))).alias("n_keys"))


def embedding_probe(spark, d):
    r = latest_records(spark, d, "language", "CASE WHEN embedding IS NOT NULL THEN 1 END AS e").withColumnRenamed("e", "embedding")
    return H.not_embedded(r, "repo", "language", "record_type")


def runs_shown(spark, d):
    from lodewright.operators.runs import run_state

    r = O._runs(spark, d)
    r = r.withColumn("state", run_state(F.col("finished_at"), F.col("heartbeat_at").cast("timestamp"), F.col("interrupted"), F.col("exit_code"), F.expr(O._NOW), 3600 * 8))
    out = H.runs_shown(r)
    return out.groupBy("collection").agg(F.count_if("shown").alias("n_shown"), F.count_if(~F.col("shown")).alias("n_hidden"), F.sum(F.when(F.col("shown"), F.col("id"))).alias("sum_id"))


def snapshots_shown(spark, d):
    """A snapshot is current if it is the newest of its branch and not dirty."""
    s = T.snapshots(spark, d).select("id", F.concat_ws("/", "collection", "repo").alias("repo"), "branch", "dirty", "created_at")
    newest = V.newest_per(s, "repo", "branch").select("id", F.lit(True).alias("top"))
    s = s.join(newest, "id", "left").withColumn("head_status", F.when(F.col("top") & ~F.col("dirty"), "current").otherwise("behind"))
    return H.snapshots_shown(s).select("id", "shown")


def run_progress(spark, d):
    """Rates of runs so far, and the seconds to go if each had a third more to do."""
    e = T.table(spark, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("done"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("seconds"))
    selected = F.ceil(F.col("done") * 4 / 3)
    return g.select("user_id", "done", F.round(H.rate(F.col("done"), F.col("seconds")) * 3600, 6).alias("per_hour"), F.round(H.remaining_seconds(F.col("done"), selected, F.col("seconds")), 3).alias("remaining"), F.round(100 * F.col("done") / selected, 4).alias("percent"))


def edges_page(spark, d):
    """The second batch of unresolved edges in order of symbol and id."""
    e = G.resolvable(T.edges(spark, d)).select("id", "target_symbol")
    first = H.page_after(e, ["target_symbol", "id"], ["", 0], PAGE).agg(F.max(F.struct("target_symbol", "id")).alias("c")).first()["c"]
    return H.page_after(e, ["target_symbol", "id"], [first["target_symbol"], first["id"]] if first else ["", 0], PAGE)


def groups_under_prefix(spark, d):
    """Names that several files define, where one of the files lies under src/."""
    defs = Q._definitions(spark, d).select("snapshot_id", G.last_part(F.col("symbol")).alias("name"), "source_path").distinct()
    g = defs.groupBy("snapshot_id", "name").agg(F.count(F.lit(1)).alias("n_paths"), F.max(H.under_prefix(F.col("source_path"), "src/")).alias("hit"))
    return g.filter("n_paths > 1 AND hit").select("snapshot_id", "name", "n_paths")


def audit_snapshots(spark, d):
    """The audit of each newest snapshot: definitions, names of several files, folded clones, orphans, unresolved calls."""
    defs = Q._definitions(spark, d)
    names = defs.filter("symbol IS NOT NULL").groupBy("snapshot_id", G.last_part(F.col("symbol")).alias("name")).agg(F.countDistinct("source_path").alias("n"))
    names = names.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("names_total"), F.count_if(F.col("n") > 1).alias("n_duplicates"))
    folded = M.fold_clones(Q._nodes(spark, d)).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_functions"), F.sum(F.col("n_folded") - 1).alias("n_folded"))
    orphans = Q.orphan_flags(spark, d).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_orphans"))
    open_ = G.resolvable(Q._edges(spark, d)).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_unresolved"))
    out = names.join(folded, "snapshot_id", "left").join(orphans, "snapshot_id", "left").join(open_, "snapshot_id", "left")
    return out.select("snapshot_id", "names_total", "n_duplicates", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_functions", "n_folded", "n_orphans", "n_unresolved")])


def reindex_due(spark, d):
    """Snapshots whose commit is that of the one before it on the branch: their reindex would be passed over."""
    w = Window.partitionBy("collection", "repo", "branch").orderBy("created_at", "id")
    s = T.snapshots(spark, d).select("id", "collection", "repo", "branch", "created_at", "commit_sha")
    return s.select("id", (~F.coalesce(F.lag("commit_sha").over(w) == F.col("commit_sha"), F.lit(False))).alias("due"))


QUERIES = {f.__name__: f for f in (
    snapshots_upsert, failures_insert, embeddings_update, snapshots_stamp, baseline_freeze, repo_replace, scan_reuse, snapshot_headers, parse_gate, record_texts, assembled_records, assembled_edges,
    definition_bodies, evidence_lists, compact_records, embedding_probe, runs_shown, snapshots_shown, run_progress, edges_page, groups_under_prefix, audit_snapshots, reindex_due)}

_LR = VIEWS + ", lr AS (SELECT r.*, lf.is_generated FROM r JOIN lf ON lf.collection = r.collection AND lf.repo = r.repo AND lf.source_path = r.source_path AND lf.file_sha256 = r.file_sha256)"
_FENCE = "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(b, '`+'), lambda x: length(x))), 0) + 1)::INT)"
_OPEN = "target_record_id IS NULL AND target_symbol IS NOT NULL AND lower(coalesce(json_extract_string(metadata, '$.target_resolvable'), 'true')) <> 'false'"
_KNOWN = [e for ends in C.SUFFIXES.values() for e in ends.split()] + C.C_SUFFIXES + [".s", ".S"]
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_STATE = "CASE WHEN finished_at IS NULL THEN CASE WHEN epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(heartbeat_at) > 86400 THEN 'stalled' ELSE 'running' END WHEN interrupted THEN 'interrupted' WHEN exit_code = 0 THEN 'ok' ELSE 'failed' END"

SQL = {
    "snapshots_upsert": VIEWS + "SELECT id, CASE WHEN id % 3 = 0 THEN 'again' ELSE branch END branch, id % 3 = 0 OR dirty AS dirty, CASE WHEN id % 3 = 0 THEN 'next' ELSE json_extract_string(metadata, '$.schema_version') END schema_version, CASE WHEN id % 3 <> 0 THEN json_extract_string(metadata, '$.parser_version') END parser_version, CASE WHEN id % 2 = 0 THEN '48' END dimension FROM s",
    "failures_insert": VIEWS + "SELECT snapshot_id, count(*) n_failures, max(least(2000, 200 * length(skipped_reason)))::INT longest, 'unknown' parser FROM f WHERE skipped_reason IS NOT NULL GROUP BY 1",
    "embeddings_update": VIEWS + "SELECT record_type, count(*) n, count(*) FILTER (WHERE embedding IS NOT NULL OR id % 2 = 0) n_embedded, count(*) FILTER (WHERE embedding IS NULL AND id % 2 = 0) n_stamped, count(*) FILTER (WHERE embedding IS NULL AND id % 2 = 1) n_skipped, max(CASE WHEN embedding IS NULL AND id % 2 = 1 THEN 500 END)::INT longest_reason, count(*) FILTER (WHERE json_exists(metadata, '$.symbols_defined')) n_defining FROM r WHERE record_type IN ('code_chunk', 'doc_section') GROUP BY 1",
    "snapshots_stamp": VIEWS + """SELECT id, CASE WHEN id IN (SELECT snapshot_id FROM latest) THEN '["code_chunk","doc_section"]' END types, json_extract_string(metadata, '$.schema_version') schema_version FROM s""",
    "baseline_freeze": O._F + ", x AS (SELECT (user_id % 5)::VARCHAR collection, CASE WHEN user_id % 2 = 1 THEN 'main' END branch, fp0, base FROM fp), sc AS (SELECT DISTINCT collection, branch FROM x WHERE NOT base AND collection < '3') SELECT collection, branch, count(*) n_findings, count(DISTINCT fp0) n_fingerprints FROM x WHERE CASE WHEN EXISTS (SELECT 1 FROM sc WHERE sc.collection = x.collection AND sc.branch IS NOT DISTINCT FROM x.branch) THEN NOT base ELSE base END GROUP BY ALL",
    "repo_replace": VIEWS + ", o AS (SELECT collection, repo FROM s GROUP BY ALL ORDER BY count(*) DESC, collection, repo LIMIT 1), g AS (SELECT id FROM s JOIN o USING (collection, repo)) SELECT 'snapshots' table_name, count(*) n_left FROM s WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'files', count(*) FROM project_code_intel_files WHERE snapshot_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'edges', count(*) FROM e WHERE snapshot_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'records', count(*) FROM r WHERE (collection, repo) NOT IN (SELECT (collection, repo) FROM o)",
    "scan_reuse": VIEWS + _PAIR + ", n AS (SELECT f.*, prev FROM rn JOIN f ON f.snapshot_id = rn.id WHERE n = 1 AND prev IS NOT NULL), u AS (SELECT n.snapshot_id, NOT n.indexed_dirty AND n.git_blob_sha IS NOT NULL AND EXISTS (SELECT 1 FROM f p WHERE p.snapshot_id = n.prev AND p.source_path = n.source_path AND p.git_blob_sha = n.git_blob_sha) reused FROM n) SELECT snapshot_id, count(*) FILTER (WHERE reused) n_reused, count(*) FILTER (WHERE NOT reused) n_read FROM u GROUP BY 1",
    "snapshot_headers": VIEWS + ", p AS (SELECT snapshot_id, sha256(string_agg(x, chr(10) ORDER BY x)) fp FROM (SELECT snapshot_id, source_path || ':' || coalesce(file_sha256, '-') x FROM f WHERE indexed_dirty) GROUP BY 1) SELECT id, tree_sha || coalesce(':dirty:' || left(fp, 16), '') tree_sha, fp IS NOT NULL dirty FROM s LEFT JOIN p ON snapshot_id = id",
    "parse_gate": VIEWS + f"SELECT language, coalesce(skipped_reason, '') = '' AND coalesce(regexp_extract(repo_rel_path, '[^/](\\.[^./]+)$', 1) IN {_LIST(_KNOWN)} OR regexp_extract(repo_rel_path, '[^/]*$') IN {_LIST(C.PARSED_NAMES)} OR contains(repo_rel_path, '/files/') OR contains(repo_rel_path, '/base-files/') OR language IN {_LIST(C.PARSED_LANGUAGES)}, false) parsed, count(*) n_files FROM f GROUP BY ALL",
    "record_texts": VIEWS + f""", x AS (SELECT *, regexp_extract(display_content, '{BODY}', 1) b, array_to_string(json_extract_string(metadata, '$.symbols_defined[*]'), ', ') sd FROM r)
SELECT id, md5(concat_ws(chr(10), 'type: ' || record_type, 'title: ' || title, 'summary: ' || summary, 'symbol: ' || nullif(symbol, ''), 'symbol_kind: ' || nullif(symbol_kind, ''), 'symbols_defined: ' || nullif(sd, ''), 'content:' || chr(10) || nullif(left(b, 4000), ''))) embedding_md5,
md5(concat_ws(chr(10), '# ' || title, '', '- Repo: `' || repo || '`', '- Role: `library`', '- File role: `' || file_role || '`', '- Content class: `' || content_class || '`', '- Lines: ' || line_start || '-' || line_end, '- Symbol: `' || nullif(symbol, '') || '`', '- Rule: `' || nullif(rule_id, '') || '`') || chr(10) || chr(10) || {_FENCE} || CASE WHEN language IN ('doc', 'text') THEN '' ELSE coalesce(language, '') END || chr(10) || b || chr(10) || {_FENCE}) display_md5 FROM x""",
    "definition_bodies": _LR + "SELECT collection, repo, source_path, parent_record_id, count(*)::INT n_chunks, md5(string_agg(display_content, chr(10) ORDER BY line_start NULLS FIRST, id)) text_md5 FROM lr WHERE record_type = 'code_chunk' AND parent_record_id IS NOT NULL GROUP BY collection, repo, source_path, file_sha256, parent_record_id",
    "evidence_lists": VIEWS + ", c AS (SELECT e.* FROM e JOIN latest USING (snapshot_id) WHERE edge_type = 'call_candidate' AND source_record_id IS DISTINCT FROM target_record_id), a AS (SELECT snapshot_id, target_record_id record_id, list_sort(list(DISTINCT source_symbol)) l FROM c WHERE target_record_id IS NOT NULL AND source_symbol IS NOT NULL GROUP BY 1, 2), b AS (SELECT snapshot_id, source_record_id record_id, list_sort(list(DISTINCT target_symbol)) l FROM c WHERE source_record_id IS NOT NULL AND target_symbol IS NOT NULL GROUP BY 1, 2) SELECT snapshot_id, record_id, array_to_string(a.l[:25], ',') callers, len(a.l) n_callers, len(a.l) > 25 callers_cut, array_to_string(b.l[:40], ',') callees, len(b.l) n_callees, len(b.l) > 40 callees_cut FROM a FULL JOIN b USING (snapshot_id, record_id)",
    "compact_records": _LR + ", k AS (SELECT id, [CASE WHEN record_type IS NOT NULL THEN 'record_type' END, CASE WHEN record_id IS NOT NULL THEN 'record_id' END, CASE WHEN parent_record_id IS NOT NULL THEN 'parent_record_id' END, CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN source_path IS NOT NULL THEN 'source_path' END, CASE WHEN language IS NOT NULL THEN 'language' END, CASE WHEN symbol IS NOT NULL THEN 'symbol' END, CASE WHEN symbol_kind IS NOT NULL THEN 'symbol_kind' END, CASE WHEN line_start IS NOT NULL THEN 'line_start' END, CASE WHEN is_generated THEN 'is_generated' END, CASE WHEN metadata NOT IN ('{}', '[]') THEN 'metadata' END] l FROM lr WHERE record_type <> 'module_chunk') SELECT id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ',') AS keys, len(list_filter(l, lambda x: x IS NOT NULL))::INT n_keys FROM k",
    "embedding_probe": _LR + "SELECT repo, language, record_type, count(*) n_records, count(embedding) n_embedded, count(embedding) = 0 nothing_to_find FROM lr GROUP BY ALL",
    "runs_shown": O._RUNS + f", t AS (SELECT *, {_STATE} st FROM ru), q AS (SELECT *, st <> 'ok' OR row_number() OVER (PARTITION BY collection, st ORDER BY started_at DESC, id DESC) = 1 shown FROM t) SELECT collection, count(*) FILTER (WHERE shown) n_shown, count(*) FILTER (WHERE NOT shown) n_hidden, sum(id) FILTER (WHERE shown)::BIGINT sum_id FROM q GROUP BY 1",
    "snapshots_shown": VIEWS + ", h AS (SELECT id, concat_ws('/', collection, repo) k, row_number() OVER (PARTITION BY collection, repo, branch ORDER BY created_at DESC, id DESC) = 1 AND NOT dirty cur FROM s) SELECT id, cur OR NOT bool_or(cur) OVER (PARTITION BY k) shown FROM h",
    "run_progress": "WITH g AS (SELECT user_id, count(*) done, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 sec, ceil(count(*) * 4 / 3) sel FROM events GROUP BY 1) SELECT user_id, done, round(CASE WHEN sec > 0 THEN done / sec END * 3600, 6) per_hour, round(CASE WHEN sel > done AND sec > 0 THEN (sel - done) * sec / done END, 3) remaining, round(100 * done / sel, 4) percent FROM g",
    "edges_page": VIEWS + f"SELECT id, target_symbol FROM e WHERE {_OPEN} ORDER BY target_symbol, id LIMIT {PAGE} OFFSET {PAGE}",
    "groups_under_prefix": Q._NEW + f"SELECT snapshot_id, {Q._TAIL.format('symbol')} AS name, count(DISTINCT source_path) n_paths FROM d GROUP BY 1, 2 HAVING count(DISTINCT source_path) > 1 AND bool_or(starts_with(source_path, 'src/') OR regexp_matches(source_path, '^[^/]*/src/'))",
    "audit_snapshots": Q._BLAST + ", " + Q._NODES.split(", nd AS", 1)[1].join(["nd AS", ""]) + f""", nm AS (SELECT snapshot_id, count(*) names_total, count(*) FILTER (WHERE n > 1) n_duplicates FROM (SELECT snapshot_id, {Q._TAIL.format('symbol')} AS x, count(DISTINCT source_path) n FROM d WHERE symbol IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
fd AS (SELECT snapshot_id, count(*) n_functions, sum(n_folded - 1)::BIGINT n_folded FROM fo GROUP BY 1), orp AS (SELECT snapshot_id, count(*) n_orphans FROM b2 WHERE looks_orphaned GROUP BY 1), op AS (SELECT snapshot_id, count(*) n_unresolved FROM le WHERE {_OPEN} GROUP BY 1)
SELECT snapshot_id, names_total, n_duplicates, coalesce(n_functions, 0) n_functions, coalesce(fd.n_folded, 0) n_folded, coalesce(n_orphans, 0) n_orphans, coalesce(n_unresolved, 0) n_unresolved FROM nm LEFT JOIN fd USING (snapshot_id) LEFT JOIN orp USING (snapshot_id) LEFT JOIN op USING (snapshot_id)""",
    "reindex_due": VIEWS + "SELECT id, NOT coalesce(lag(commit_sha) OVER (PARTITION BY collection, repo, branch ORDER BY created_at, id) = commit_sha, false) due FROM s",
}
