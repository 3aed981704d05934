"""Queries over SARIF documents, from their text to findings, records and the gate.

A document is written per user and half of the time from the error events, as a tool would: rules, results with
fingerprints, related places and code flows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.operators import findings as X
from lodewright.parse import assemble as A
from lodewright.plans import ops as O


def _documents(spark, d):
    """(path, text): SARIF documents; every third finding has no fingerprint of the tool, every fifth no level of its own."""
    f = O._findings(spark, d).withColumn("half", F.when(F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{O.SPLIT}'"), "a").otherwise("b"))
    i = F.col("event_id")
    place = lambda path, line: F.struct(F.struct(F.struct(path.alias("uri"), F.when(i % 2 == 0, "SRC").alias("uriBaseId")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))
    line = (i % 97 + 1).cast("int")
    result = F.struct(
        "rule_id",
        F.when(i % 5 != 0, F.col("level")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.when(i % 3 != 0, F.struct(F.sha2(F.concat_ws("|", "rule_id", "source_path", i.cast("string")), 256).alias("primary"))).alias("partialFingerprints"),
        F.array(place(F.concat(F.lit("./"), "source_path", F.lit("/a%20b.py")), line)).alias("locations"),
        F.when(i % 4 == 0, F.array(place(F.col("source_path"), line + 1), place(F.col("source_path"), line + 2))).alias("relatedLocations"),
        F.when(i % 7 == 0, F.array(F.struct(F.array(F.struct(F.array(*[F.struct(place(F.lit(p), F.lit(k)).alias("location")) for k, p in enumerate(("x.py", "y.py"), 1)]).alias("locations"))).alias("threadFlows")))).alias("codeFlows"),
    )
    r = f.select("user_id", "half", "rule_id", result.alias("r"), i.alias("i"))
    docs = r.groupBy("user_id", "half").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("rs"), F.array_sort(F.collect_set("rule_id")).alias("ids"))  # the findings of a user in half a month
    rules = F.transform("ids", lambda x: F.struct(x.alias("id"), F.struct(F.lit("note").alias("level")).alias("defaultConfiguration"), F.struct(F.concat(F.lit("about "), x).alias("text")).alias("shortDescription")))
    results = F.transform("rs", lambda x: F.struct(x["r"]["rule_id"].alias("ruleId"), *[x["r"][c].alias(c) for c in ("level", "message", "partialFingerprints", "locations", "relatedLocations", "codeFlows")]))
    bases = F.struct(F.struct(F.lit("file:///work/").alias("uri")).alias("SRC"))
    run = F.struct(F.struct(F.struct(F.lit("lint").alias("name"), F.lit("2.1").alias("version"), rules.alias("rules")).alias("driver")).alias("tool"), bases.alias("originalUriBaseIds"), results.alias("results"))
    return docs.select(F.concat("half", F.lit("/"), F.col("user_id").cast("string"), F.lit(".sarif")).alias("path"), F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("text"))


def _results(spark, d):
    return X.sarif_findings(X.sarif_runs(_documents(spark, d)))


def sarif_runs(spark, d):
    """Runs of the documents and of one that is none, with their rules."""
    docs = _documents(spark, d).unionByName(spark.createDataFrame([("bad.sarif", "[1")], "path string, text string"))
    r = X.sarif_runs(docs)
    return r.select("path", "run_index", "tool", F.col("version").alias("tool_version"), "error", F.size("run.tool.driver.rules").alias("n_rules"), F.size("run.results").alias("n_results"))


def sarif_findings(spark, d):
    f = _results(spark, d)
    related = F.coalesce(F.size("x.relatedLocations"), F.lit(0))
    steps = F.aggregate(F.flatten(F.transform("x.codeFlows", lambda w: F.transform(w["threadFlows"], lambda t: F.size(t["locations"])))), F.lit(0), lambda a, n: a + n)
    return f.select("path", "result_index", "rule_id", "level", "message", "source_path", "line_start", (F.col("producer_fingerprint").isNotNull()).alias("has_fingerprint"), F.greatest(related, F.lit(0)).alias("n_related"), F.coalesce(steps, F.lit(0)).alias("n_steps"))


def sarif_locations(spark, d):
    loc = X.sarif_locations(_results(spark, d))
    return loc.groupBy("kind", "source_path").agg(F.count(F.lit(1)).alias("n"), F.sum("line_start").alias("sum_line"))


def sarif_records(spark, d):
    """Findings as searchable records: what search shows and embeds."""
    f = _results(spark, d)
    place = F.concat(F.col("source_path"), F.lit(":"), F.coalesce("line_start", F.lit(1)).cast("string"))
    title, summary = F.concat(F.col("rule_id"), F.lit(" at "), place), F.col("message")
    body = F.concat_ws("\n", F.concat(F.lit("Tool: "), F.col("tool")), F.concat(F.lit("Rule: "), F.col("rule_id")), F.concat(F.lit("Level: "), F.col("level")), F.concat(F.lit("Location: "), place), F.concat(F.lit("Message: "), F.col("message")))
    none = F.lit(None).cast("string")
    shown = A.display(title, F.lit("r"), F.lit("app"), F.lit("static-analysis"), F.lit("analysis"), F.col("line_start"), F.col("line_end"), none, F.col("rule_id"), F.lit("text"), body)
    return f.select("path", "result_index", F.md5(A.embedding_text(F.lit("static_finding"), title, summary, body)).alias("embedding_md5"), F.md5(shown).alias("display_md5"))


def sarif_gate(spark, d):
    """The second half's findings against the first half's, by the tool's fingerprint or else rule, place and message."""
    f = _results(spark, d)
    own = F.sha2(F.concat_ws("\n", "rule_id", "source_path", "message"), 256)
    f = f.select("path", "rule_id", "level", "message", "source_path", "line_start", "line_end", F.coalesce("producer_fingerprint", own).alias("fingerprint"))
    one = lambda half: X.occurrence_fingerprints(f.filter(F.startswith("path", F.lit(half))))
    return X.regressions(one("a/"), one("b/")).groupBy("rule_id", "kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (sarif_runs, sarif_findings, sarif_locations, sarif_records, sarif_gate)}

_X = O._F.replace("WITH fi", "WITH fi") + """, x AS (SELECT *, CASE WHEN base THEN 'a' ELSE 'b' END half, (event_id % 97 + 1)::INT line, CASE WHEN event_id % 5 <> 0 THEN level ELSE 'note' END lv,
  CASE WHEN event_id % 2 = 0 THEN '/work/' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN './' ELSE '' END || source_path || '/a b.py' place FROM fp),
y AS (SELECT *, half || '/' || user_id || '.sarif' path, (row_number() OVER (PARTITION BY half, user_id ORDER BY event_id) - 1)::INT result_index FROM x)"""
SQL = {
    "sarif_runs": _X + " SELECT path, 0 run_index, 'lint' tool, '2.1' tool_version, NULL AS error, count(DISTINCT rule_id)::INT n_rules, count(*)::INT n_results FROM y GROUP BY path UNION ALL SELECT 'bad.sarif', NULL, NULL, NULL, 'no runs', NULL, NULL",
    "sarif_findings": _X + " SELECT path, result_index, rule_id, lv AS level, message, place source_path, line line_start, event_id % 3 <> 0 has_fingerprint, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END n_related, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END n_steps FROM y",
    "sarif_locations": _X + " SELECT kind, source_path, count(*) n, sum(l)::BIGINT sum_line FROM (SELECT 'primary' kind, source_path || '/a b.py' source_path, line l FROM y UNION ALL SELECT 'related', source_path, line + k FROM y, (VALUES (1), (2)) v(k) WHERE event_id % 4 = 0) GROUP BY ALL",
    "sarif_records": _X + ", b AS (SELECT *, place || ':' || line p, concat_ws(chr(10), 'Tool: lint', 'Rule: ' || rule_id, 'Level: ' || lv, 'Location: ' || place || ':' || line, 'Message: ' || message) b FROM y) SELECT path, result_index, md5(concat_ws(chr(10), 'type: static_finding', 'title: ' || rule_id || ' at ' || p, 'summary: ' || message, 'content:' || chr(10) || b)) embedding_md5, md5(concat_ws(chr(10), '# ' || rule_id || ' at ' || p, '', '- Repo: `r`', '- Role: `app`', '- File role: `static-analysis`', '- Content class: `analysis`', '- Lines: ' || line || '-' || line, '- Rule: `' || rule_id || '`') || chr(10) || chr(10) || '```' || chr(10) || b || chr(10) || '```') display_md5 FROM b",
    "sarif_gate": _X + ", k AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN 'own' || rule_id || '|' || event_id ELSE rule_id || '|' || place || '|' || message END f0 FROM y), o AS (SELECT *, row_number() OVER (PARTITION BY half, f0 ORDER BY line) n FROM k), g AS (SELECT c.rule_id, CASE WHEN b.f0 IS NULL THEN 'new' WHEN " + O._RANKOF.format("c.lv") + " > " + O._RANKOF.format("b.lv") + " THEN 'worsened' END kind FROM o c LEFT JOIN o b ON b.half = 'a' AND b.f0 = c.f0 AND b.n = c.n WHERE c.half = 'b') SELECT rule_id, kind, count(*) n FROM g WHERE kind IS NOT NULL GROUP BY ALL",
}
