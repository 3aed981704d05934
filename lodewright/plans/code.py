"""Queries over the call graph and repeated call shapes, of the newest snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright import tables as T
from lodewright.operators import graph as G
from lodewright.operators import mining as M
from lodewright.operators import versions as V
from lodewright.plans.index import VIEWS

LIKE = 0.3  # the operators' default is 0.6, at which these tables have hardly a pair


def _definitions(spark, d, latest=True):
    r = T.records(spark, d, "collection", "repo", "source_path", "file_sha256", "record_type", "record_id", "symbol", "symbol_kind", "line_start", "line_end", where="record_type = 'symbol_definition'")
    f = T.files(spark, d, "collection", "repo", "file_sha256", scope=V.latest_scope(T.snapshots(spark, d)) if latest else None).filter("file_sha256 IS NOT NULL")
    return r.join(f, ["collection", "repo", "source_path", "file_sha256"])


def _edges(spark, d):
    return T.edges(spark, d, scope=V.latest_scope(T.snapshots(spark, d)))


def edge_resolve(spark, d):
    return G.resolve_targets(T.edges(spark, d), _definitions(spark, d, False))


def edge_unresolved_count(spark, d):
    return G.resolvable(T.edges(spark, d)).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_unresolved"))


def related_edges_any(spark, d):
    return G.related(_edges(spark, d), "emit_event", 40).select("id", "direction", "place")


def blast_radius(spark, d):
    tests = T.files(spark, d, "is_test", scope=V.latest_scope(T.snapshots(spark, d)))
    return G.blast_radius(_definitions(spark, d), _edges(spark, d), tests)


def orphan_flags(spark, d):
    return blast_radius(spark, d).filter("looks_orphaned").select("snapshot_id", "record_id")


def _nodes(spark, d):
    return M.function_nodes(_definitions(spark, d), _edges(spark, d))


def function_nodes(spark, d):
    n = _nodes(spark, d)
    return n.select("snapshot_id", "record_id", "loc", F.array_join("roles", ",").alias("roles"), F.size("callees").alias("n_callees"))


def clone_fold(spark, d):
    return M.fold_clones(_nodes(spark, d)).select("snapshot_id", "symbol", "loc", "source_path", "n_folded", F.array_join("roles", ",").alias("roles"))


def role_weights(spark, d):
    return M.role_weights(M.fold_clones(_nodes(spark, d))).select("snapshot_id", "role", F.round("weight", 9).alias("weight"))


def jaccard_pairs(spark, d):
    """Pairs of role sets with weighted Jaccard of at least LIKE."""
    from lodewright.session import cut

    folded = cut(M.fold_clones(_nodes(spark, d)))
    classes = cut(M.role_classes(folded))
    pairs = M.similar_classes(classes, M.role_weights(folded), LIKE)
    name = lambda c: classes.select("snapshot_id", F.col("cls").alias(c), F.array_join("roles", ",").alias(f"r{c}"))
    out = pairs.join(name("a"), ["snapshot_id", "a"]).join(name("b"), ["snapshot_id", "b"])
    return out.select("snapshot_id", F.least("ra", "rb").alias("roles_a"), F.greatest("ra", "rb").alias("roles_b"), F.round("likeness", 6).alias("likeness"))


def motif_clusters(spark, d):
    members, _, _ = M.motif_clusters(_nodes(spark, d), LIKE)
    first = F.min("record_id").alias("first_member")
    return members.groupBy("snapshot_id", "cluster").agg(first, F.count(F.lit(1)).alias("k")).drop("cluster")


def motif_scores(spark, d):
    s = M.motif_scores(_nodes(spark, d), LIKE)
    num = [F.round(c, 6).alias(c) for c in ("shared", "residual", "avg_similarity", "cost", "redundancy", "net", "ratio")]
    return s.select("snapshot_id", "k", "n_dirs", "core_roles", *num, "est_loc", "recommendation")


def common_roles(spark, d):
    return M.motif_scores(_nodes(spark, d), LIKE).select("snapshot_id", "k", "core_roles")


def duplicate_names(spark, d):
    return M.duplicate_names(_definitions(spark, d))


def context_map(spark, d):
    """Public symbols of source files that are no tests, per path."""
    tests = T.files(spark, d, "is_source", "is_test", scope=V.latest_scope(T.snapshots(spark, d))).filter("is_source AND NOT coalesce(is_test, false)").select("snapshot_id", "source_path")
    s = _definitions(spark, d).filter("NOT startswith(symbol, '_') AND NOT contains(symbol, '.')").join(tests, ["snapshot_id", "source_path"], "left_semi")
    return s.groupBy("snapshot_id", "source_path").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))


QUERIES = {f.__name__: f for f in (edge_resolve, edge_unresolved_count, related_edges_any, blast_radius, orphan_flags, function_nodes, clone_fold, role_weights, jaccard_pairs, motif_clusters, motif_scores, common_roles, duplicate_names, context_map)}

_D = VIEWS + """, d AS (SELECT f.snapshot_id, r.* EXCLUDE (source_path), f.source_path FROM r JOIN {f} f ON f.collection = r.collection AND f.repo = r.repo AND f.source_path = r.source_path AND f.file_sha256 = r.file_sha256 WHERE record_type = 'symbol_definition')
, le AS (SELECT e.* FROM e JOIN latest USING (snapshot_id))"""
_ALL, _NEW = _D.format(f="f"), _D.format(f="lf")
_TAIL = "regexp_extract({}, '[^.]*$')"
_DIR = "regexp_replace({}, '/[^/]*$', '')"
_RESOLVE = _ALL + f""", w AS (SELECT id, snapshot_id, target_symbol x, source_path p FROM e WHERE target_record_id IS NULL AND target_symbol IS NOT NULL AND coalesce(json_extract_string(metadata, '$.target_resolvable'), 'true') <> 'false'),
k AS (SELECT DISTINCT snapshot_id, record_id, symbol, source_path, CASE WHEN symbol_kind IN ('function', 'method', 'constant', 'class', 'enum', 'shell_function') THEN 0 WHEN symbol_kind IN ('interface', 'type') THEN 2 ELSE 1 END kind FROM d WHERE symbol IS NOT NULL),
ex AS (SELECT DISTINCT snapshot_id, symbol FROM k),
tl AS (SELECT snapshot_id, {_TAIL.format('symbol')} tail, min(symbol) symbol FROM k GROUP BY 1, 2 HAVING count(DISTINCT symbol) = 1),
m AS (SELECT w.*, coalesce(ex.symbol, tl.symbol) symbol FROM w LEFT JOIN ex ON ex.snapshot_id = w.snapshot_id AND ex.symbol = x LEFT JOIN tl ON tl.snapshot_id = w.snapshot_id AND tail = {_TAIL.format('x')}),
c AS (SELECT m.id, k.*, CASE WHEN k.source_path = m.p THEN 0 WHEN {_DIR.format('k.source_path')} = {_DIR.format('m.p')} THEN 1 ELSE 2 END tier FROM m JOIN k ON k.snapshot_id = m.snapshot_id AND k.symbol = m.symbol)
SELECT id, record_id AS resolved_record_id FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, CASE WHEN tier < 2 THEN source_path END, kind, source_path, record_id) = 1"""
_BLAST = _NEW + f""", di AS (SELECT DISTINCT snapshot_id, record_id, symbol, source_path, {_TAIL.format('symbol')} bare FROM d),
inb AS (SELECT le.snapshot_id, target_record_id record_id, count(*) n, count(DISTINCT le.source_path) FILTER (WHERE is_test) t FROM le LEFT JOIN f ON f.snapshot_id = le.snapshot_id AND f.source_path = le.source_path WHERE edge_type = 'call_candidate' AND target_record_id IS NOT NULL AND source_record_id IS DISTINCT FROM target_record_id GROUP BY 1, 2),
cal AS (SELECT snapshot_id, source_record_id record_id, count(DISTINCT target_symbol) n FROM le WHERE edge_type = 'call_candidate' AND target_symbol IS NOT NULL AND source_record_id IS DISTINCT FROM target_record_id GROUP BY 1, 2),
nam AS (SELECT snapshot_id, target_symbol bare, count(*) n FROM le WHERE target_symbol IS NOT NULL GROUP BY 1, 2),
ow AS (SELECT snapshot_id, target_symbol bare, source_record_id record_id, count(*) n FROM le WHERE target_symbol IS NOT NULL GROUP BY 1, 2, 3),
br AS (SELECT di.snapshot_id, di.record_id, symbol, source_path, di.bare, coalesce(inb.n, 0) n_callers, coalesce(inb.t, 0) n_test_files, coalesce(cal.n, 0) n_callees, coalesce(nam.n, 0) - coalesce(ow.n, 0) n_name_refs
  FROM di LEFT JOIN inb USING (snapshot_id, record_id) LEFT JOIN cal USING (snapshot_id, record_id) LEFT JOIN nam ON nam.snapshot_id = di.snapshot_id AND nam.bare = di.bare LEFT JOIN ow ON ow.snapshot_id = di.snapshot_id AND ow.bare = di.bare AND ow.record_id = di.record_id),
b2 AS (SELECT * EXCLUDE (bare), n_callers = 0 AND n_name_refs = 0 AND bare <> 'main' looks_orphaned FROM br)"""
_NODES = _NEW + f""", nd AS (SELECT snapshot_id, record_id, min(symbol) symbol, min(source_path) source_path, min(line_end - line_start + 1) loc FROM d WHERE symbol_kind IN ('function', 'method') GROUP BY 1, 2),
ca AS (SELECT snapshot_id, source_record_id record_id, {_TAIL.format('target_symbol')} callee FROM le WHERE target_symbol IS NOT NULL AND source_record_id IS NOT NULL),
ro AS (SELECT *, lower(string_split(regexp_replace(regexp_replace(regexp_replace(callee, '^_+', ''), '[^A-Za-z0-9]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' ')[1]) role FROM ca),
rs AS (SELECT snapshot_id, record_id, list_sort(list(DISTINCT role) FILTER (WHERE role <> '')) roles, count(DISTINCT callee) n_callees FROM ro GROUP BY 1, 2),
fn AS (SELECT nd.*, coalesce(array_to_string(roles, ','), '') roles, coalesce(n_callees, 0) n_callees FROM nd LEFT JOIN rs USING (snapshot_id, record_id)),
fo AS (SELECT snapshot_id, symbol, loc, roles, min(source_path) source_path, count(*) n_folded FROM fn GROUP BY ALL),
wt AS (SELECT snapshot_id, role, ln(any_value(n) / count(*)) weight FROM (SELECT snapshot_id, unnest(string_split(roles, ',')) role, count(*) OVER (PARTITION BY snapshot_id) n FROM fo) WHERE role <> '' GROUP BY ALL)"""
_WT = ", tot AS (SELECT snapshot_id, count(*) n FROM fo GROUP BY 1), wt2 AS (SELECT x.snapshot_id, role, ln(any_value(tot.n) / count(*)) weight FROM (SELECT snapshot_id, unnest(string_split(roles, ',')) role FROM fo) x JOIN tot USING (snapshot_id) WHERE role <> '' GROUP BY ALL)"

# All pairs of folded nodes, and the reach of every node over their links.
_MOTIF = (_NODES + _WT).replace("WITH s AS", "WITH RECURSIVE s AS", 1) + f""", cs AS (SELECT snapshot_id, record_id, list(DISTINCT callee) cl FROM ca GROUP BY 1, 2),
fk AS (SELECT DISTINCT ON (snapshot_id, symbol, loc, roles) fn.*, coalesce(cl, []) cl FROM fn LEFT JOIN cs USING (snapshot_id, record_id) ORDER BY snapshot_id, symbol, loc, roles, source_path, record_id),
el AS (SELECT *, {_TAIL.format('symbol')} bare FROM fk WHERE roles <> '' AND len(string_split(roles, ',')) >= 3),
ew AS (SELECT x.*, weight FROM (SELECT snapshot_id, record_id, unnest(string_split(roles, ',')) role FROM el) x JOIN wt2 USING (snapshot_id, role)),
tt AS (SELECT snapshot_id, record_id, sum(weight) t FROM ew GROUP BY 1, 2),
pr AS (SELECT a.snapshot_id, a.record_id ra, b.record_id rb, a.roles = b.roles same, list_contains(a.cl, b.bare) OR list_contains(b.cl, a.bare) chain FROM el a JOIN el b ON a.snapshot_id = b.snapshot_id AND a.record_id < b.record_id),
sh AS (SELECT a.snapshot_id, a.record_id ra, b.record_id rb, sum(a.weight) s FROM ew a JOIN ew b ON a.snapshot_id = b.snapshot_id AND a.role = b.role AND a.record_id < b.record_id GROUP BY 1, 2, 3),
lk AS (SELECT pr.*, CASE WHEN same THEN 1.0 ELSE coalesce(s, 0) / (x.t + y.t - coalesce(s, 0)) END j FROM pr JOIN tt x ON x.snapshot_id = pr.snapshot_id AND x.record_id = ra JOIN tt y ON y.snapshot_id = pr.snapshot_id AND y.record_id = rb LEFT JOIN sh ON sh.snapshot_id = pr.snapshot_id AND sh.ra = pr.ra AND sh.rb = pr.rb),
ln AS (SELECT snapshot_id, ra u, rb v FROM lk WHERE j >= {LIKE} - 1e-12 AND NOT chain), l2 AS (SELECT * FROM ln UNION SELECT snapshot_id, v, u FROM ln),
rc AS (SELECT DISTINCT snapshot_id, u node, u root FROM l2 UNION SELECT l2.snapshot_id, l2.v, rc.root FROM rc JOIN l2 ON l2.snapshot_id = rc.snapshot_id AND l2.u = rc.node),
mb AS (SELECT el.*, c FROM (SELECT snapshot_id, node, min(root) c FROM rc GROUP BY 1, 2) x JOIN el ON el.snapshot_id = x.snapshot_id AND el.record_id = x.node),
kk AS (SELECT snapshot_id, c, count(*) k, count(DISTINCT CASE WHEN contains(source_path, '/') THEN {_DIR.format('source_path')} ELSE source_path END) n_dirs, CASE WHEN count(loc) >= 2 THEN sum(loc) - max(loc) END::BIGINT est_loc FROM mb GROUP BY 1, 2),
rl AS (SELECT x.snapshot_id, x.c, role, count(*) n FROM (SELECT snapshot_id, c, unnest(string_split(roles, ',')) role FROM mb) x GROUP BY 1, 2, 3),
rw AS (SELECT rl.*, weight, n >= greatest(k / 2, 1.0) AND weight > 0 core FROM rl JOIN wt2 USING (snapshot_id, role) JOIN kk USING (snapshot_id, c)),
ro2 AS (SELECT snapshot_id, c, coalesce(sum(weight) FILTER (WHERE core), 0) shared, coalesce(sum(weight) FILTER (WHERE NOT core), 0) residual, coalesce(string_agg(role, ',' ORDER BY role) FILTER (WHERE core), '') core_roles FROM rw GROUP BY 1, 2),
av AS (SELECT a.snapshot_id, a.c, avg(j) a FROM mb a JOIN mb b ON a.snapshot_id = b.snapshot_id AND a.c = b.c AND a.record_id < b.record_id JOIN lk ON lk.snapshot_id = a.snapshot_id AND lk.ra = a.record_id AND lk.rb = b.record_id GROUP BY 1, 2),
sc AS (SELECT *, 1 + residual + 0.5 * greatest(n_dirs - 1, 0) cost, (k - 1) * shared * a * a redundancy FROM kk JOIN ro2 USING (snapshot_id, c) JOIN av USING (snapshot_id, c))"""
_ADVICE = "CASE WHEN redundancy - cost <= 0 THEN 'leave-as-is' WHEN residual > shared THEN 'parameterize-carefully' ELSE 'worth-collapsing' END"

SQL = {
    "motif_clusters": _MOTIF + "SELECT snapshot_id, min(record_id) first_member, count(*) k FROM mb GROUP BY snapshot_id, c",
    "motif_scores": _MOTIF + f"SELECT snapshot_id, k, n_dirs, core_roles, round(shared, 6) shared, round(residual, 6) residual, round(a, 6) avg_similarity, round(cost, 6) AS cost, round(redundancy, 6) redundancy, round(redundancy - cost, 6) net, round(redundancy / cost, 6) ratio, est_loc, {_ADVICE} recommendation FROM sc",
    "common_roles": _MOTIF + "SELECT snapshot_id, k, core_roles FROM sc",
    "edge_resolve": _RESOLVE,
    "edge_unresolved_count": VIEWS + "SELECT snapshot_id, count(*) n_unresolved FROM e WHERE target_record_id IS NULL AND target_symbol IS NOT NULL AND coalesce(json_extract_string(metadata, '$.target_resolvable'), 'true') <> 'false' GROUP BY 1",
    "related_edges_any": _NEW + ", x AS (SELECT * FROM le WHERE target_record_id IS NULL OR source_record_id IS DISTINCT FROM target_record_id), y AS (SELECT id, 0 direction, row_number() OVER (ORDER BY target_record_id IS NOT NULL DESC, id DESC) place FROM x WHERE target_symbol = 'emit_event' UNION ALL SELECT id, 1, row_number() OVER (ORDER BY target_record_id IS NOT NULL DESC, id DESC) FROM x WHERE source_symbol = 'emit_event'), z AS (SELECT DISTINCT ON (id) * FROM y WHERE place <= 40 ORDER BY id, place, direction) SELECT id, direction, place FROM z ORDER BY place, direction LIMIT 40",
    "blast_radius": _BLAST + "SELECT * FROM b2",
    "orphan_flags": _BLAST + "SELECT snapshot_id, record_id FROM b2 WHERE looks_orphaned",
    "function_nodes": _NODES + "SELECT snapshot_id, record_id, loc, roles, n_callees FROM fn",
    "clone_fold": _NODES + "SELECT snapshot_id, symbol, loc, source_path, n_folded, roles FROM fo",
    "role_weights": _NODES + _WT + "SELECT snapshot_id, role, round(weight, 9) weight FROM wt2",
    "jaccard_pairs": _NODES + _WT + f", cl AS (SELECT DISTINCT snapshot_id, roles FROM fo WHERE roles <> '' AND len(string_split(roles, ',')) >= 3), cw AS (SELECT c.*, role, weight FROM (SELECT snapshot_id, roles, unnest(string_split(roles, ',')) role FROM cl) c JOIN wt2 USING (snapshot_id, role)), t AS (SELECT snapshot_id, roles, sum(weight) t FROM cw GROUP BY 1, 2), sh AS (SELECT a.snapshot_id, a.roles ra, b.roles rb, sum(a.weight) s FROM cw a JOIN cw b ON a.snapshot_id = b.snapshot_id AND a.role = b.role AND a.roles < b.roles GROUP BY 1, 2, 3) SELECT sh.snapshot_id, ra roles_a, rb roles_b, round(s / (x.t + y.t - s), 6) likeness FROM sh JOIN t x ON x.snapshot_id = sh.snapshot_id AND x.roles = ra JOIN t y ON y.snapshot_id = sh.snapshot_id AND y.roles = rb WHERE s / (x.t + y.t - s) >= {LIKE} - 1e-12",
    "duplicate_names": _NEW + f"SELECT snapshot_id, {_TAIL.format('symbol')} AS name, count(DISTINCT source_path) n_paths, min(source_path) first_path, max(source_path) last_path FROM d GROUP BY 1, 2 HAVING count(DISTINCT source_path) > 1",
    "context_map": _NEW + "SELECT d.snapshot_id, d.source_path, string_agg(DISTINCT symbol, ',' ORDER BY symbol) symbols FROM d JOIN f ON f.snapshot_id = d.snapshot_id AND f.source_path = d.source_path WHERE is_source AND NOT coalesce(is_test, false) AND NOT starts_with(symbol, '_') AND NOT contains(symbol, '.') GROUP BY ALL",
}
