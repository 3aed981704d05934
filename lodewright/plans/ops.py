"""Queries over findings, runs and triage, projected from the events table.

An error event is a finding: rule from its props, level from its value, the user as place, the day's half as run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright import tables as T
from lodewright.operators import findings as X
from lodewright.operators import runs as R

SPLIT = "2024-01-15"


def _findings(spark, d):
    e = T.table(spark, d, "events").filter("event_type = 'error'")
    k = F.concat(F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("-")))
    level = F.when(F.col("value") < 10, "note").when(F.col("value") < 50, "warning").otherwise("error")
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", k.alias("rule_id"), level.alias("level"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("source_path"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.sha2(F.concat_ws("|", k, F.col("user_id").cast("string")), 256).alias("fingerprint"))


def gate_regressions(spark, d):
    f = _findings(spark, d)
    out = X.regressions(X.occurrence_fingerprints(f.filter(f"ts < TIMESTAMP_NTZ '{SPLIT}'"), "event_id"), X.occurrence_fingerprints(f.filter(f"ts >= TIMESTAMP_NTZ '{SPLIT}'"), "event_id"))
    return out.groupBy("rule_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def occurrence_fingerprints(spark, d):
    return X.occurrence_fingerprints(_findings(spark, d)).select("fingerprint")


def static_counts_latest(spark, d):
    """Findings of the newest day by rule and level."""
    f = _findings(spark, d).withColumn("day", F.to_date("ts"))
    last = f.agg(F.max("day").alias("day"))
    return f.join(F.broadcast(last), "day").groupBy("rule_id", F.coalesce("level", F.lit("none")).alias("level")).agg(F.count(F.lit(1)).alias("n_findings"))


def static_by_rule(spark, d):
    return _findings(spark, d).groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("source_path").alias("n_places"))


def static_search(spark, d):
    f = _findings(spark, d).filter("level = 'error' AND rule_id IN ('k1', 'k2', 'k3')")
    return f.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "rule_id", "message")


def finding_detail(spark, d):
    """Each of the newest 20 findings with the number of findings of its rule and of its place."""
    f = _findings(spark, d)
    top = f.orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    rule = f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_rule"))
    place = f.groupBy("source_path").agg(F.count(F.lit(1)).alias("n_place"))
    return top.join(rule, "rule_id").join(place, "source_path").select("event_id", "rule_id", "source_path", "n_rule", "n_place")


def _runs(spark, d):
    """A run per user and day: the first event starts it, the last is its heartbeat, a purchase finishes it, an error fails it."""
    e = T.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")
    g = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("id"), F.min("ts").alias("started_at"), F.max("ts").alias("heartbeat_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("finished_at"), F.max((F.col("event_type") == "error").cast("int")).alias("exit_code"), F.max(F.col("event_type") == "signup").alias("interrupted"))
    return g.select("id", (F.col("user_id") % 7).alias("collection"), "started_at", "heartbeat_at", "finished_at", "exit_code", "interrupted")


_NOW = "TIMESTAMP '2024-01-30 12:00:00'"


def run_state(spark, d):
    r = _runs(spark, d)
    s = R.run_state(F.col("finished_at"), F.col("heartbeat_at").cast("timestamp"), F.col("interrupted"), F.col("exit_code"), F.expr(_NOW), 3600 * 8)
    return r.groupBy("collection", s.alias("state")).agg(F.count(F.lit(1)).alias("n_runs"))


def run_retention(spark, d):
    return R.expired_runs(_runs(spark, d)).groupBy("collection").agg(F.count(F.lit(1)).alias("n_expired"), F.sum("id").alias("sum_id"))


def runs_union_live(spark, d):
    r = _runs(spark, d)
    return R.newest_and_live(r, F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'"), 30).select("id", "collection")


def ledger_latest(spark, d):
    """The last event of each user: what the stream keeps as its state."""
    e = T.table(spark, d, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp_ntz").alias("at"), "event_type")
    return R.latest_state(e).select("run_id", "event_id", "event_type")


def _candidates(spark, d, shift):
    """A candidate per user: the rules of its findings in one half of the time; ids differ between the halves."""
    f = _findings(spark, d).filter(f"ts {'<' if shift else '>='} TIMESTAMP_NTZ '{SPLIT}'")
    g = f.groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat_ws("/", "rule_id", F.col("user_id").cast("string")))).alias("members"))
    return g.select(X.candidate_id(F.lit("c/r"), F.col("members")).alias("id"), F.lit("c/r").alias("scope"), "members", F.when(F.col("user_id") % 2 == 0, "dismissed").otherwise("open").alias("status"))


def triage_reconcile(spark, d):
    return X.reconcile(_candidates(spark, d, False), _candidates(spark, d, True))


def triage_summary(spark, d):
    s = X.triage_summary(_candidates(spark, d, False), _candidates(spark, d, True), True)
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (gate_regressions, occurrence_fingerprints, static_counts_latest, static_by_rule, static_search, finding_detail, run_state, run_retention, runs_union_live, ledger_latest, triage_reconcile, triage_summary)}

_F = """WITH fi AS (SELECT event_id, ts, user_id, 'k' || coalesce(json_extract_string(props, '$.k'), '-') rule_id, CASE WHEN value < 10 THEN 'note' WHEN value < 50 THEN 'warning' ELSE 'error' END AS level, 'user ' || user_id message, 'u/' || user_id source_path FROM events WHERE event_type = 'error'),
fp AS (SELECT *, sha256(rule_id || '|' || user_id) fp0, ts < TIMESTAMP '2024-01-15' base FROM fi)"""
_OCC = ", oc AS (SELECT *, sha256(fp0 || ':' || (row_number() OVER (PARTITION BY {by} ORDER BY rule_id, message, source_path) - 1)) fingerprint FROM fp)"
_RANKOF = "CASE {} WHEN 'note' THEN 1 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 ELSE 0 END"
_RUNS = "WITH ru AS (SELECT min(event_id) id, user_id % 7 collection, min(ts) started_at, max(ts) heartbeat_at, max(ts) FILTER (WHERE event_type = 'purchase') finished_at, max((event_type = 'error')::INT) exit_code, bool_or(event_type = 'signup') interrupted FROM events GROUP BY user_id, ts::DATE)"
_CAND = _F + ", ca AS (SELECT base, user_id, list_sort(list(DISTINCT rule_id || '/' || user_id)) members FROM fp GROUP BY 1, 2), ci AS (SELECT *, 'redundancy-' || left(sha256('c/r' || chr(10) || array_to_string(members, chr(10))), 12) id, CASE WHEN user_id % 2 = 0 THEN 'dismissed' ELSE 'open' END status FROM ca), cu AS (SELECT * FROM ci WHERE NOT base), en AS (SELECT * FROM ci WHERE base)"
SQL = {
    "gate_regressions": _F + _OCC.format(by="base, fp0").replace("source_path)", "source_path, event_id)") + f", g AS (SELECT c.rule_id, CASE WHEN b.fingerprint IS NULL THEN 'new' WHEN {_RANKOF.format('c.level')} > {_RANKOF.format('b.level')} THEN 'worsened' END kind FROM oc c LEFT JOIN oc b ON b.base AND b.fingerprint = c.fingerprint WHERE NOT c.base) SELECT rule_id, kind, count(*) n FROM g WHERE kind IS NOT NULL GROUP BY ALL",
    "occurrence_fingerprints": _F + _OCC.format(by="fp0") + "SELECT fingerprint FROM oc",
    "static_counts_latest": _F + "SELECT rule_id, level, count(*) n_findings FROM fi WHERE ts::DATE = (SELECT max(ts::DATE) FROM fi) GROUP BY ALL",
    "static_by_rule": _F + "SELECT rule_id, level, count(*) n_findings, count(DISTINCT source_path) n_places FROM fi GROUP BY ALL",
    "static_search": _F + "SELECT event_id, rule_id, message FROM fi WHERE level = 'error' AND rule_id IN ('k1', 'k2', 'k3') ORDER BY ts DESC, event_id DESC LIMIT 50",
    "finding_detail": _F + "SELECT event_id, rule_id, source_path, (SELECT count(*) FROM fi b WHERE b.rule_id = a.rule_id) n_rule, (SELECT count(*) FROM fi b WHERE b.source_path = a.source_path) n_place FROM (SELECT * FROM fi ORDER BY ts DESC, event_id DESC LIMIT 20) a",
    "run_state": _RUNS + "SELECT collection, CASE WHEN finished_at IS NULL THEN CASE WHEN epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(heartbeat_at) > 86400 THEN 'stalled' ELSE 'running' END WHEN interrupted THEN 'interrupted' WHEN exit_code = 0 THEN 'ok' ELSE 'failed' END state, count(*) n_runs FROM ru GROUP BY ALL",
    "run_retention": _RUNS + "SELECT collection, count(*) n_expired, sum(id)::BIGINT sum_id FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY started_at DESC, id DESC) n FROM ru WHERE finished_at IS NOT NULL) WHERE n > 20 GROUP BY 1",
    "runs_union_live": _RUNS + "SELECT id, collection FROM (SELECT * FROM (SELECT * FROM ru ORDER BY started_at DESC, id DESC LIMIT 30) UNION SELECT * FROM ru WHERE finished_at IS NULL AND heartbeat_at > TIMESTAMP '2024-01-30 11:00:00')",
    "ledger_latest": "SELECT DISTINCT ON (user_id) user_id run_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC",
    "triage_reconcile": _CAND + ", p AS (SELECT c.id, e.id saved_id FROM cu c JOIN en e ON len(list_intersect(c.members, e.members)) >= 2 WHERE c.id NOT IN (SELECT id FROM en) AND e.id NOT IN (SELECT id FROM cu)) SELECT id, saved_id FROM p WHERE (SELECT count(*) FROM p q WHERE q.id = p.id) = 1 AND (SELECT count(*) FROM p q WHERE q.saved_id = p.saved_id) = 1",
    "triage_summary": _CAND + "SELECT status, count(*) n FROM (SELECT coalesce(en.status, 'open') status FROM cu LEFT JOIN en USING (id) UNION ALL SELECT 'fixed' FROM en WHERE id NOT IN (SELECT id FROM cu)) GROUP BY 1",
}
