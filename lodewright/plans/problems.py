"""Queries of the core problems over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.operators.orphans import orphan_references, orphan_report
from lodewright.operators.snapshot_diff import snapshot_changes
from lodewright.tables import table

FILES, RECORDS, EDGES, SNAPSHOTS = (f"project_code_intel_{t}" for t in ("files", "records", "edges", "snapshots"))


def _orphans(spark, d):
    return orphan_references(table(spark, d, EDGES), table(spark, d, FILES), table(spark, d, RECORDS))


def p3_found(spark, d):
    return _orphans(spark, d).filter("origin = 'direct'").select("table_name", "row_id", "field_name")


def p3_cascade(spark, d):
    return _orphans(spark, d).select("table_name", "row_id", "field_name", "origin")


def p3_report(spark, d):
    return orphan_report(_orphans(spark, d))


def p4_found(spark, d):
    return snapshot_changes(table(spark, d, SNAPSHOTS), table(spark, d, FILES))


def p4_summary(spark, d):
    return p4_found(spark, d).groupBy("snapshot_id", "change").agg(F.count(F.lit(1)).alias("n_paths"))


_P3 = """
WITH RECURSIVE f AS (
  SELECT DISTINCT ON (snapshot_id, source_path) snapshot_id, source_path, collection, repo, lower(file_sha256) sha
  FROM project_code_intel_files ORDER BY snapshot_id, source_path, created_at DESC, id DESC),
r AS (SELECT DISTINCT ON (id) id, collection, repo, source_path, lower(file_sha256) sha, record_type, record_id, parent_record_id, symbol, created_at FROM project_code_intel_records),
o0 AS (SELECT id, collection, repo, sha, record_id, created_at FROM r WHERE parent_record_id <> '' AND NOT EXISTS (
  SELECT 1 FROM r p WHERE p.collection IS NOT DISTINCT FROM r.collection AND p.repo IS NOT DISTINCT FROM r.repo AND p.sha IS NOT DISTINCT FROM r.sha AND p.record_id = r.parent_record_id)),
o AS (SELECT id, collection, repo, sha, record_id FROM o0 UNION
  SELECT c.id, c.collection, c.repo, c.sha, c.record_id FROM r c JOIN o ON c.collection IS NOT DISTINCT FROM o.collection AND c.repo IS NOT DISTINCT FROM o.repo AND c.sha IS NOT DISTINCT FROM o.sha AND c.parent_record_id = o.record_id),
v AS (SELECT f.snapshot_id, r.record_id, r.record_type, regexp_extract(r.symbol, '[^.]*$') tail, r.created_at, r.id IN (SELECT id FROM o) bad
  FROM r JOIN f USING (collection, repo, source_path, sha)),
byid AS (SELECT snapshot_id, record_id k, min(created_at) t, min(created_at) FILTER (WHERE NOT bad) g FROM v GROUP BY 1, 2),
bysym AS (SELECT snapshot_id, tail k, min(created_at) t, min(created_at) FILTER (WHERE NOT bad) g FROM v WHERE record_type = 'symbol_definition' GROUP BY 1, 2),
e AS (SELECT DISTINCT ON (id) * FROM project_code_intel_edges),
refs AS (
  SELECT id, snapshot_id, created_at, 'source_record_id' field_name, source_record_id k FROM e WHERE source_record_id <> ''
  UNION ALL SELECT id, snapshot_id, created_at, 'target_record_id', target_record_id FROM e WHERE target_record_id <> ''),
syms AS (SELECT id, snapshot_id, created_at, regexp_extract(target_symbol, '[^.]*$') k FROM e
  WHERE target_symbol <> '' AND coalesce(target_record_id, '') = '' AND coalesce(json_extract_string(metadata, '$.target_resolvable'), 'true') <> 'false'),
found AS (
  SELECT 'project_code_intel_edges' table_name, id row_id, field_name, created_at,
    CASE WHEN NOT coalesce(t <= created_at, false) THEN 'direct' WHEN NOT coalesce(g <= created_at, false) THEN 'inherited' END origin
  FROM refs LEFT JOIN byid USING (snapshot_id, k)
  UNION ALL SELECT 'project_code_intel_edges', id, 'target_symbol', created_at,
    CASE WHEN NOT coalesce(t <= created_at, false) THEN 'direct' WHEN NOT coalesce(g <= created_at, false) THEN 'inherited' END
  FROM syms LEFT JOIN bysym USING (snapshot_id, k)
  UNION ALL SELECT 'project_code_intel_records', id, 'parent_record_id', created_at, CASE WHEN id IN (SELECT id FROM o0) THEN 'direct' ELSE 'inherited' END
  FROM r WHERE id IN (SELECT id FROM o))
"""

_P4 = """
WITH s AS (SELECT id, lag(id) OVER (PARTITION BY collection, repo, branch ORDER BY created_at, id) prev
  FROM (SELECT DISTINCT ON (id) * FROM project_code_intel_snapshots)),
f AS (SELECT DISTINCT ON (snapshot_id, source_path) snapshot_id, source_path, lower(file_sha256) sha, lower(git_blob_sha) blob, size_bytes
  FROM project_code_intel_files ORDER BY snapshot_id, source_path, created_at DESC, id DESC),
p AS (SELECT * FROM s WHERE prev IS NOT NULL),
a AS (SELECT p.id, f.* FROM p JOIN f ON f.snapshot_id = p.prev),
b AS (SELECT p.id, f.* FROM p JOIN f ON f.snapshot_id = p.id),
found AS (SELECT coalesce(a.id, b.id) snapshot_id, coalesce(a.source_path, b.source_path) source_path,
  CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed'
    WHEN a.sha IS NOT NULL AND b.sha IS NOT NULL THEN CASE WHEN a.sha <> b.sha THEN 'changed' END
    WHEN a.blob IS NOT NULL AND b.blob IS NOT NULL THEN CASE WHEN a.blob <> b.blob THEN 'changed' END
    WHEN a.size_bytes IS DISTINCT FROM b.size_bytes THEN 'changed' END change
  FROM a FULL JOIN b ON a.id = b.id AND a.source_path = b.source_path)
"""

QUERIES = {"p3_found": p3_found, "p3_cascade": p3_cascade, "p3_report": p3_report, "p4_found": p4_found, "p4_summary": p4_summary}
SQL = {
    "p3_found": _P3 + "SELECT table_name, row_id, field_name FROM found WHERE origin = 'direct'",
    "p3_cascade": _P3 + "SELECT table_name, row_id, field_name, origin FROM found WHERE origin IS NOT NULL",
    "p3_report": _P3 + "SELECT table_name, field_name, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, origin, count(*) n_orphans FROM found WHERE origin IS NOT NULL GROUP BY ALL",
    "p4_found": _P4 + "SELECT * FROM found WHERE change IS NOT NULL",
    "p4_summary": _P4 + "SELECT snapshot_id, change, count(*) n_paths FROM found WHERE change IS NOT NULL GROUP BY ALL",
}
