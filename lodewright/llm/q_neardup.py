"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.llm.neardup import groups, similar_pairs
from lodewright.tables import table


def _chunks(spark, d):
    return table(spark, d, "project_code_intel_records").filter("record_type = 'code_chunk'").select("id", F.col("display_content").alias("text"))


def p1_found(spark, d):
    return similar_pairs(_chunks(spark, d))


def p1_groups(spark, d):
    return groups(_chunks(spark, d))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
_PAIRS = r"""
WITH t AS MATERIALIZED (SELECT id, regexp_extract_all(regexp_extract(display_content, '(?s)\n`{3,}[^\n]*\n(.*)\n`{3,}$', 1), '[A-Za-z0-9_]+') w
  FROM (SELECT DISTINCT ON (id) id, display_content FROM project_code_intel_records WHERE record_type = 'code_chunk')),
s AS MATERIALIZED (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) x FROM t WHERE len(w) >= 25),
g AS MATERIALIZED (SELECT id, x, len(x) n, unnest(x) h FROM s),
c AS (SELECT a.id id_a, b.id id_b, count(*) m, any_value(a.n) na, any_value(b.n) nb FROM g a JOIN g b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2)
"""
# All pairs by shared runs, counted in full: no signature, no prefix.
# Groups by the reach of every class over its links.
_GROUPS = (
    _PAIRS.replace("WITH t AS", "WITH RECURSIVE t AS", 1)
    + """, k AS (SELECT id, min(id) OVER (PARTITION BY x) class_id FROM s),
l AS (SELECT DISTINCT a.class_id u, b.class_id v FROM c JOIN k a ON a.id = id_a JOIN k b ON b.id = id_b WHERE m >= 0.5 * (na + nb - m) AND a.class_id <> b.class_id),
b AS (SELECT u, v FROM l UNION SELECT v, u FROM l), r AS (SELECT DISTINCT class_id node, class_id root FROM k UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node)
SELECT id, class_id, g.root group_id, coalesce(n, 0) n_links FROM k JOIN (SELECT node, min(root) root FROM r GROUP BY 1) g ON g.node = class_id LEFT JOIN (SELECT u, count(*) n FROM b GROUP BY 1) d ON d.u = class_id"""
)
SQL = {"p1_found": _PAIRS + "SELECT id_a, id_b FROM c WHERE m >= 0.5 * (na + nb - m)", "p1_groups": _GROUPS}
