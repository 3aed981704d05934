"""Static findings: SARIF documents flattened, fingerprints, the regression gate, triage of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("none", "note", "warning", "error")  # fixed value: in order of severity

_MESSAGE = "struct<text:string,markdown:string>"
_REGION = "struct<startLine:string,endLine:string,startColumn:string,endColumn:string,snippet:struct<text:string>>"
_PLACE = f"struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>,region:{_REGION}>,message:{_MESSAGE}>"
_STEP = f"struct<location:{_PLACE},importance:string>"
_RESULT = (
    f"struct<ruleId:string,ruleIndex:int,level:string,kind:string,message:{_MESSAGE},baselineState:string,partialFingerprints:map<string,string>,"
    f"fingerprints:map<string,string>,suppressions:array<string>,locations:array<{_PLACE}>,relatedLocations:array<{_PLACE}>,"
    f"codeFlows:array<struct<threadFlows:array<struct<locations:array<{_STEP}>>>>>>"
)
_RULE = "struct<id:string,name:string,shortDescription:struct<text:string>,defaultConfiguration:struct<level:string>,helpUri:string>"
SARIF = (
    f"struct<runs:array<struct<tool:struct<driver:struct<name:string,version:string,semanticVersion:string,rules:array<{_RULE}>>>,"
    f"automationDetails:struct<id:string>,originalUriBaseIds:map<string,struct<uri:string>>,versionControlProvenance:array<struct<revisionId:string>>,results:array<{_RESULT}>>>>"
)


def level_rank(level) -> Column:
    """0 to 3; unknown and null levels count as none."""
    return sum((F.when(level == name, i).otherwise(0) for i, name in enumerate(LEVELS)), F.lit(0)) if level is not None else F.lit(0)


def _rank(level) -> Column:
    return F.coalesce(level_rank(level), F.lit(0))


def sarif_runs(docs: DataFrame) -> DataFrame:
    """One row per run of docs (path, text): path, sha, run_index, tool, version, run (the parsed run), error.

    A document that is no SARIF object gives one row with an error and no run.
    """
    parsed = docs.select("path", F.sha2("text", 256).alias("sha"), F.from_json("text", SARIF).alias("doc"))
    bad = parsed.filter("doc IS NULL OR doc.runs IS NULL").select("path", "sha", F.lit(None).cast("int").alias("run_index"), F.lit("no runs").alias("error"), F.lit(None).cast(SARIF[len("struct<runs:array<") : -2]).alias("run"))
    good = parsed.filter("doc.runs IS NOT NULL").select("path", "sha", F.posexplode("doc.runs").alias("run_index", "run")).select("path", "sha", "run_index", F.lit(None).cast("string").alias("error"), "run")
    out = good.unionByName(bad)
    driver = F.col("run.tool.driver")
    return out.select("path", "sha", "run_index", "error", driver["name"].alias("tool"), F.coalesce(driver["semanticVersion"], driver["version"]).alias("version"), F.col("run.automationDetails.id").alias("automation_id"), F.col("run.versionControlProvenance")[0]["revisionId"].alias("revision"), "run")


def sarif_rules(runs: DataFrame) -> DataFrame:
    r = runs.select("path", "run_index", F.explode("run.tool.driver.rules").alias("r"))
    return r.select("path", "run_index", F.coalesce("r.id", "r.name", F.lit("unknown")).alias("rule_id"), "r.name", F.col("r.shortDescription.text").alias("description"), F.col("r.defaultConfiguration.level").alias("default_level"), F.col("r.helpUri").alias("help_uri"))


def normal_uri(uri) -> Column:
    """Without a file scheme and leading ./, percent signs decoded."""
    plain = F.regexp_replace(F.regexp_replace(uri, "^file:/*(?=/)", ""), r"^(?:\./)+", "")
    return F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def sarif_findings(runs: DataFrame) -> DataFrame:
    """One row per result: rule by id, by index, or unknown; level or the rule's default; first location; key and fingerprint."""
    r = runs.filter("run IS NOT NULL").select("path", "run_index", "tool", F.col("run.tool.driver.rules").alias("rules"), F.col("run.originalUriBaseIds").alias("bases"), F.posexplode("run.results").alias("result_index", "x"))
    by_index = F.try_element_at("rules", F.col("x.ruleIndex") + 1)
    rule_id = F.coalesce("x.ruleId", by_index["id"], by_index["name"], F.lit("unknown"))
    found = F.filter("rules", lambda q: q["id"] == rule_id)
    level = F.coalesce(F.col("x.level"), F.try_element_at(found, F.lit(1))["defaultConfiguration"]["level"], F.lit("warning"))
    message = F.coalesce("x.message.text", "x.message.markdown", F.lit(""))
    place = F.try_element_at("x.locations", F.lit(1))["physicalLocation"]
    base = F.when(place["artifactLocation"]["uriBaseId"].isNotNull(), F.try_element_at("bases", place["artifactLocation"]["uriBaseId"])["uri"])
    uri = place["artifactLocation"]["uri"]
    where = F.when(base.isNotNull(), F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), uri)).otherwise(uri)
    number = lambda c: F.try_to_number(place["region"][c], F.lit("999999999")).cast("int")
    prints = F.when(F.size("x.partialFingerprints") > 0, F.col("x.partialFingerprints")).when(F.size("x.fingerprints") > 0, F.col("x.fingerprints"))
    entries = F.array_sort(F.map_entries(prints))
    least = F.sha2(F.concat_ws(":", entries[0]["key"], entries[0]["value"]), 256)
    stable = F.to_json(F.struct(F.col("run_index").alias("run"), F.col("result_index").alias("idx"), F.col("x.ruleId").alias("rule"), message.alias("message"), F.col("x.locations").alias("locations")))
    out = r.select(
        "path", "run_index", "tool", "result_index", rule_id.alias("rule_id"), level.alias("level"), message.alias("message"), normal_uri(where).alias("source_path"), number("startLine").alias("line_start"),
        F.coalesce(number("endLine"), number("startLine")).alias("line_end"), number("startColumn").alias("column_start"), F.col("x.baselineState").alias("baseline_state"), F.size("x.suppressions").alias("n_suppressions"),
        F.left(F.coalesce(least, F.sha2(stable, 256)), F.lit(32)).alias("finding_key"),
        F.when(prints.isNotNull(), F.sha2(F.to_json(entries), 256)).alias("producer_fingerprint"), "x",
    )
    return out


def sarif_locations(findings: DataFrame) -> DataFrame:
    """Primary and related locations, in order."""
    both = F.concat(*[F.coalesce(F.transform(F.col(f"x.{c}"), lambda p: F.struct(F.lit(k).alias("kind"), p.alias("p"))), F.array().cast(f"array<struct<kind:string,p:{_PLACE}>>")) for c, k in (("locations", "primary"), ("relatedLocations", "related"))])
    out = findings.select("path", "run_index", "result_index", F.posexplode(both).alias("ordinal", "l"))
    place = F.col("l.p.physicalLocation")
    return out.select("path", "run_index", "result_index", "ordinal", F.col("l.kind").alias("kind"), normal_uri(place["artifactLocation"]["uri"]).alias("source_path"), place["region"]["startLine"].cast("int").alias("line_start"), F.coalesce(place["region"]["endLine"], place["region"]["startLine"]).cast("int").alias("line_end"), F.coalesce("l.p.message.text", "l.p.message.markdown").alias("message"))


def sarif_code_flows(findings: DataFrame) -> DataFrame:
    """Steps of the threads of the flows, numbered on all three levels."""
    f = findings.select("path", "run_index", "result_index", F.posexplode("x.codeFlows").alias("flow", "f"))
    t = f.select("path", "run_index", "result_index", "flow", F.posexplode("f.threadFlows").alias("thread", "t"))
    s = t.select("path", "run_index", "result_index", "flow", "thread", F.posexplode("t.locations").alias("step", "s"))
    return s.select("path", "run_index", "result_index", "flow", "thread", "step", normal_uri(F.col("s.location.physicalLocation.artifactLocation.uri")).alias("source_path"), F.col("s.location.physicalLocation.region.startLine").cast("int").alias("line_start"), F.col("s.importance").alias("importance"))


def flow_summary(steps) -> Column:
    """All steps if eight or fewer, else the first three, dots, the last three."""
    return F.when(F.size(steps) <= 8, steps).otherwise(F.concat(F.slice(steps, 1, 3), F.array(F.lit("...")), F.slice(steps, -3, 3)))


def own_fingerprint(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """findings with fingerprint: the producer's, else rule and the stripped lines around (three each way) and column,
    else rule, path, column and message. lines is (source_path, line, text)."""
    near = findings.filter("producer_fingerprint IS NULL AND line_start > 0").select("finding_key", "source_path", "line_start", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_start") - 3), F.col("line_start") + 3)).alias("line"))
    near = near.join(lines, ["source_path", "line"]).filter("trim(text) <> ''").groupBy("finding_key").agg(F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("t")))).alias("c"))
    near = near.select("finding_key", F.array_join(F.transform("c", lambda x: x["t"]), "\n").alias("context"))
    out = findings.join(near, "finding_key", "left")
    column = F.when(F.col("column_start").isNotNull(), F.concat(F.lit("\ncol:"), F.col("column_start").cast("string"))).otherwise("")
    coded = F.sha2(F.concat("rule_id", F.lit("\n"), "context", column), 256)
    plain = F.sha2(F.concat("rule_id", F.lit("\n"), F.coalesce("source_path", F.lit("")), column, F.lit("\n"), "message"), 256)
    return out.withColumn("fingerprint", F.coalesce("producer_fingerprint", coded, plain)).drop("context")


def occurrence_fingerprints(findings: DataFrame, *ties: str) -> DataFrame:
    """fingerprint replaced by one of its own for each occurrence, numbered in content order, then by ties.

    Numbers of a fingerprint are given within its group; ones that so many findings share that this is a large
    task tell nothing apart, and the sort spills.
    """
    order = ["rule_id", "message", F.coalesce("source_path", F.lit("")), F.coalesce("line_start", F.lit(-1)), F.coalesce("line_end", F.lit(-1))]
    n = F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order, *ties)) - 1
    return findings.withColumn("fingerprint", F.sha2(F.concat_ws(":", "fingerprint", n.cast("string")), 256))


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Current findings that are new or worse than in baseline, by fingerprint; fixed and milder ones are none."""
    old = baseline.groupBy("fingerprint").agg(F.max(_rank(F.col("level"))).alias("old"))
    both = current.join(old, "fingerprint", "left")
    kind = F.when(F.col("old").isNull(), "new").when(_rank(F.col("level")) > F.col("old"), "worsened")
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").drop("old")


def candidate_id(scope, members) -> Column:
    return F.concat(F.lit("redundancy-"), F.left(F.sha2(F.concat_ws("\n", scope, F.array_join(F.array_sort(members), "\n")), 256), F.lit(12)))


def reconcile(current: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, saved_id): current candidates (id, scope, members) that take over a saved entry, each the other's only option.

    Options are candidates without an entry and entries without a candidate, of one scope or of none, that share two members.
    """
    c = current.join(entries.select("id"), "id", "left_anti").select("id", "scope", F.explode(F.array_distinct("members")).alias("m"))
    s = entries.join(current.select("id"), "id", "left_anti").select(F.col("id").alias("saved_id"), F.col("scope").alias("saved_scope"), F.explode(F.array_distinct("members")).alias("m"))
    pair = c.join(s, "m").filter("saved_scope IS NULL OR saved_scope = scope").groupBy("id", "saved_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    one = lambda k: pair.groupBy(k).agg(F.count(F.lit(1)).alias("d")).filter("d = 1").select(k)
    return pair.join(one("id"), "id", "left_semi").join(one("saved_id"), "saved_id", "left_semi").select("id", "saved_id")


def triage_summary(current: DataFrame, entries: DataFrame, infer_fixed: bool = False) -> DataFrame:
    """(id, status): open, dismissed, and with infer_fixed the entries whose candidate is gone."""
    now = current.select("id").join(entries.select("id", "status"), "id", "left").select("id", F.coalesce("status", F.lit("open")).alias("status"))
    if not infer_fixed:
        return now
    return now.unionByName(entries.join(current.select("id"), "id", "left_anti").select("id", F.lit("fixed").alias("status")))
