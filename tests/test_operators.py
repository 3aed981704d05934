import itertools
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodewright.functions import classify as C
from lodewright.operators import findings as X
from lodewright.operators import graph as G
from lodewright.operators import mining as M
from lodewright.operators import search as S
from lodewright.operators import semantic as V
from lodewright.operators.components import connected_components
from lodewright.operators.versions import insert_new, merge_latest, newest_per


def test_components(spark):
    random.seed(3)
    pairs = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (None, 3)] + [(5000, 5001 + i) for i in range(300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([(*p, "x") for p in pairs], "u long, v long, component string")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(df.filter("u > 99999")).count() == 0


def test_language_and_flags(spark):
    rows = [("src/a.rs", "rust"), ("a/Dockerfile", "dockerfile"), ("x/Dockerfile.dev", "dockerfile"), ("k/Kconfig", "kconfig"), ("etc/init.d/net", "shell"), ("a.unknown", "text"), ("Makefile", "make"), ("a.S", "asm"), ("a.H", "c"), ("f.pkr.hcl", "packer"), ("config-5.10", "config"), (".bazelrc", "bazel"), (".json", "text"), ("x.tar.gz", "text")]
    df = spark.createDataFrame(rows, "path string, want string").withColumn("got", C.language(F.col("path")))
    assert [(r["path"], r["got"]) for r in df.collect()] == rows
    text = [("a.h", "@interface X"), ("run", "#!/usr/bin/env bash\n"), ("x", "#!/usr/bin/perl"), ("y", "plain"), ("z", None), ("q", "# syntax=docker/dockerfile:1")]
    df = spark.createDataFrame(text, "path string, text string").withColumn("got", C.refined_language(F.col("path"), F.col("text")))
    assert [r["got"] for r in df.collect()] == ["objective_c", "shell", "perl", "text", "text", "dockerfile"]
    df = spark.createDataFrame([("pkg/client/clientset/a.go", "go"), ("vendor/x/test_a.py", "python"), ("docs/a.txt", "text")], "p string, l string")
    fl = C.flags(F.col("p"), F.col("l"))
    got = df.select(*[v.alias(k) for k, v in fl.items()], C.content_class(F.col("l"), fl).alias("klass")).collect()
    assert [r["klass"] for r in got] == ["generated", "test", "doc"] and got[1]["is_vendor"] and got[0]["is_source"]


def test_newest_merge_insert(spark):
    df = spark.createDataFrame([(1, "a", None, 5), (2, "a", None, 5), (3, "a", "b", 1), (4, None, "b", None)], "id long, repo string, branch string, created_at int")
    assert sorted(r["id"] for r in newest_per(df, "repo", "branch").collect()) == [2, 3, 4]
    old = spark.createDataFrame([("k", None, "t1", "e1", 1), ("o", "x", "t", None, 1)], "k string, j string, title string, emb string, n int")
    new = spark.createDataFrame([("k", None, "t2", None, 2), ("k", None, "t3", None, 3), ("p", None, "t", "e", 1)], "k string, j string, title string, emb string, n int")
    got = {r["k"]: (r["title"], r["emb"], r["n"]) for r in merge_latest(old, new, ["k", "j"], "n", ["n"], ("emb",)).collect()}
    assert got == {"k": ("t1", "e1", 3), "o": ("t", None, 1), "p": ("t", "e", 1)}
    e = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "b", "c")], "id long, s string, t string")
    assert sorted(r["id"] for r in insert_new(e.filter("id = 1"), e.filter("id > 1"), ["s", "t"], "id").collect()) == [1, 3]


def test_terms_and_scores(spark):
    assert S.query_terms("foo and BAR or foo x.y") == ["foo", "BAR", "x.y"]
    assert S.looks_like_identifier(["a_b"]) and not S.looks_like_identifier(["word"]) and not S.looks_like_identifier(["a_b", "c"])
    assert S.wants_security("CWE-79 injection") and not S.wants_security("safe")
    row = ("emit_event", "Emit_Event", "x/emit_event.py", "p::emit_event", "the emit_event", "body emit_event", "function")
    df = spark.createDataFrame([row, (None, None, None, None, None, None, None)], "symbol string, title string, source_path string, record_id string, summary string, display_content string, record_type string")
    got = [r[0] for r in df.select(S.match_score(["emit_event"])).collect()]
    assert got == [120 + 80 + 32 + 20 + 12 + 8 + 6 + 4 + 1, 0]


def test_snippet(spark):
    body = "a" * 300 + " needle " + "b" * 300
    df = spark.createDataFrame([(f"# t\n\n```c\n{body}\n```",), ("no fence",), ("```\nshort\n```",), (None,)], "d string")
    got = [r[0] for r in df.select(S.snippet(F.col("d"), ["Needle"], 100)).collect()]
    assert len(got[0]) <= 100 and "needle" in got[0] and got[0].startswith("...") and got[0].endswith("...")
    assert got[1:] == [None, "short", None]


def test_full_text(spark):
    assert S.parse_web_query('"open window" or emitting -java') == [[(True, ["open", "window"])], [(True, ["emitt"]), (False, ["java"])]]
    df = spark.createDataFrame([(1, "open windows", "p", None, "", "x", "", "", 1), (2, "window open", "p", None, "", "x", "", "", 1), (3, "emitted", "p", None, "", "x", "java text", "", 1), (4, "emitted", "p", None, "", "x", "go", "", 1)], "id long, title string, source_path string, symbol string, summary string, record_type string, embedding_text string, display_content string, updated_at long").withColumn("record_id", F.lit("r"))
    assert [r["id"] for r in S.full_text(df, '"open window" or emitted -java', 9).orderBy("id").collect()] == [1, 4]


def test_gates():
    g = V.gates("build the wallet", {})
    assert (g["a"], g["b"], g["s"], g["n"], g["g"]) == (0.12, 0.18, 0.16, 0.18, 0.24)
    assert V.gates("build tests", {})["n"] == 0 and V.gates("build", {"file_role": "test"})["a"] == 0


def test_pairwise_mean(spark):
    rows = [(i % 2, i, [random.Random(i * 5 + k).uniform(-1, 1) for k in range(6)]) for i in range(20)] + [(0, 99, [0.0] * 6), (5, 98, [1.0] * 6)]
    df = spark.createDataFrame(rows, "g int, id int, v array<double>")
    got = {r["g"]: (r["n_pairs"], r["mean_cosine"]) for r in V.pairwise_by_group(df, "g", "id", "v").collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    for g in (0, 1):
        vs = [v for h, _, v in rows if h == g and any(v)]
        c = [cos(a, b) for a, b in itertools.combinations(vs, 2)]
        assert got[g][0] == len(c) and abs(got[g][1] - sum(c) / len(c)) < 1e-9
    assert 5 not in got


def test_resolution(spark):
    d = spark.createDataFrame([(1, "r1", "A.run", "x/a.py", "method"), (1, "r2", "go", "x/a.py", "function"), (1, "r3", "go", "y/b.py", "function"), (1, "r4", "T.dup", "x/a.py", "type"), (1, "r5", "U.dup", "x/a.py", "function")], "snapshot_id long, record_id string, symbol string, source_path string, symbol_kind string")
    e = spark.createDataFrame([(1, "go", "y/b.py", None), (2, "go", "x/z.py", None), (3, "go", "q/z.py", "{}"), (4, "self.run", "q/z.py", None), (5, "dup", "x/a.py", None), (6, "go", "x/a.py", '{"target_resolvable": false}'), (7, "none", "x", None)], "id long, target_symbol string, source_path string, metadata string").withColumns({"snapshot_id": F.lit(1).cast("long"), "target_record_id": F.lit(None).cast("string")})
    assert {r["id"]: r["resolved_record_id"] for r in G.resolve_targets(e, d).collect()} == {1: "r3", 2: "r2", 3: "r2", 4: "r1"}


def brute_clusters(nodes, threshold):
    import math

    folded = {}
    for s, rid, sym, path, loc, roles, callees in nodes:
        k = (s, sym, tuple(roles), loc)
        if k not in folded or (path, rid) < (folded[k][3], folded[k][1]):
            folded[k] = (s, rid, sym, path, loc, roles, callees)
    f = list(folded.values())
    df = {}
    for x in f:
        for r in x[5]:
            df[x[0], r] = df.get((x[0], r), 0) + 1
    n = {s: sum(x[0] == s for x in f) for s in {x[0] for x in f}}
    w = {k: math.log(n[k[0]] / v) for k, v in df.items()}
    ok = [x for x in f if len(x[5]) >= 3]
    root = {x[:2]: x[:2] for x in ok}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        if a[0] != b[0]:
            continue
        u = sum(w[a[0], r] for r in set(a[5]) | set(b[5]))
        j = sum(w[a[0], r] for r in set(a[5]) & set(b[5])) / u if u else 0
        chain = a[2].split(".")[-1] in b[6] or b[2].split(".")[-1] in a[6]
        if j >= threshold and not chain:
            root[find(a[:2])] = find(b[:2])
    groups = {}
    for x in ok:
        groups.setdefault(find(x[:2]), set()).add(x[:2])
    return sorted(map(sorted, (g for g in groups.values() if len(g) > 1)))


def test_motif_clusters(spark):
    rnd = random.Random(5)
    pool = [f"verb{i}" for i in range(14)]
    nodes = []
    for i in range(160):
        roles = sorted(rnd.sample(pool, rnd.randrange(1, 6))) if i % 3 else sorted(pool[:4])
        sym = f"f{i % 50}"
        nodes.append((i % 2 + 1, f"r{i:03d}", sym, f"d{i % 5}/p{i % 9}", i % 4, roles, sorted({f"f{rnd.randrange(50)}" for _ in range(8)})))
    df = spark.createDataFrame(nodes, "snapshot_id long, record_id string, symbol string, source_path string, loc int, roles array<string>, callees array<string>")
    members, _, _ = M.motif_clusters(df, 0.5)
    got = {}
    for r in members.collect():
        got.setdefault(r["cluster"], set()).add((r["snapshot_id"], r["record_id"]))
    assert sorted(map(sorted, got.values())) == brute_clusters(nodes, 0.5)
    s = M.motif_scores(df, 0.5).collect()
    assert len(s) == len(got) and all(abs(r["redundancy"] - (r["k"] - 1) * r["shared"] * r["avg_similarity"] ** 2) < 1e-9 for r in s)


def test_roles(spark):
    df = spark.createDataFrame([("repo.insert_row",), ("_validateUser",), ("HTTPServer",), ("a.b.c",), ("",)], "c string")
    assert [r[0] for r in df.select(M.role(F.col("c"))).collect()] == ["insert", "validate", "httpserver", "c", ""]


SARIF = """{"runs":[{"tool":{"driver":{"name":"lint","version":"1","rules":[{"id":"R1","defaultConfiguration":{"level":"error"}},{"id":"R2"}]}},"originalUriBaseIds":{"ROOT":{"uri":"src/"}},
"results":[{"ruleId":"R1","message":{"text":"bad"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a%20b.py","uriBaseId":"ROOT"},"region":{"startLine":"3","startColumn":5}}}],"relatedLocations":[{"physicalLocation":{"artifactLocation":{"uri":"./c.py"}}}],"codeFlows":[{"threadFlows":[{"locations":[{"location":{"physicalLocation":{"artifactLocation":{"uri":"d.py"},"region":{"startLine":1}}},"importance":"essential"},{"importance":"unimportant"}]}]}]},
{"ruleIndex":1,"level":"note","message":{"markdown":"*m*"},"partialFingerprints":{"b":"2","a":"1"}},{"message":{}}]}]}"""


def test_sarif(spark):
    docs = spark.createDataFrame([("x.sarif", SARIF), ("bad.sarif", "not json"), ("list.sarif", "[]")], "path string, text string")
    runs = X.sarif_runs(docs)
    assert sorted((r["path"], r["tool"], r["error"] is None) for r in runs.collect()) == [("bad.sarif", None, False), ("list.sarif", None, False), ("x.sarif", "lint", True)]
    assert X.sarif_rules(runs).count() == 2
    f = X.sarif_findings(runs)
    got = [(r["rule_id"], r["level"], r["message"], r["source_path"], r["line_start"], r["line_end"], r["column_start"]) for r in f.orderBy("result_index").collect()]
    assert got == [("R1", "error", "bad", "src/a b.py", 3, 3, 5), ("R2", "note", "*m*", None, None, None, None), ("unknown", "warning", "", None, None, None, None)]
    assert [r["kind"] for r in X.sarif_locations(f).orderBy("ordinal").collect()] == ["primary", "related"]
    assert [(r["step"], r["source_path"]) for r in X.sarif_code_flows(f).orderBy("step").collect()] == [(0, "d.py"), (1, None)]
    lines = spark.createDataFrame([("src/a b.py", i, f"  line {i}") for i in range(1, 9)], "source_path string, line int, text string")
    prints = {r["rule_id"]: r["fingerprint"] for r in X.own_fingerprint(f, lines).collect()}
    moved = {r["rule_id"]: r["fingerprint"] for r in X.own_fingerprint(f, lines.withColumn("text", F.concat(F.col("text"), F.lit("  ")))).collect()}
    assert prints == moved and len(set(prints.values())) == 3


def test_gate(spark):
    cols = "fingerprint string, rule_id string, message string, source_path string, line_start int, line_end int, level string"
    base = spark.createDataFrame([("f", "r", "m", "p", 1, 1, "warning"), ("g", "r", "m", "p", 1, 1, "error"), ("gone", "r", "m", "p", 1, 1, "error")], cols)
    now = spark.createDataFrame([("f", "r", "m", "p", 5, 5, "error"), ("f", "r", "m", "p", 9, 9, "note"), ("g", "r", "m", "p", 1, 1, None), ("h", "r", "m", None, None, None, "odd")], cols)
    got = sorted((r["kind"], r["line_start"] or 0) for r in X.regressions(X.occurrence_fingerprints(base), X.occurrence_fingerprints(now)).collect())
    assert got == [("new", 0), ("new", 9), ("worsened", 5)]


def test_triage(spark):
    c = spark.createDataFrame([("n1", "s", ["a", "b", "c"]), ("n2", "s", ["x", "y"]), ("n3", "s", ["x", "y", "z"]), ("same", "s", ["q", "r"])], "id string, scope string, members array<string>")
    e = spark.createDataFrame([("o1", None, ["a", "b"], "dismissed"), ("o2", "s", ["x", "y", "w"], "open"), ("o3", "t", ["a", "b", "c"], "open"), ("same", "s", ["q"], "dismissed")], "id string, scope string, members array<string>, status string")
    assert [tuple(r) for r in X.reconcile(c, e).collect()] == [("n1", "o1")]
    assert sorted(tuple(r) for r in X.triage_summary(c, e, True).collect()) == [("n1", "open"), ("n2", "open"), ("n3", "open"), ("o1", "fixed"), ("o2", "fixed"), ("o3", "fixed"), ("same", "dismissed")]


def test_nearest_of_more_than_a_thousand_queries(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(1300)]
    rows += [(1300 + i, rows[i][1]) for i in range(9)] + [(1400, None), (1401, [0.0] * 6), (1402, [1.0]), (1403, [2.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = v.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    pairs = v.join(q, F.col("id") != F.col("query_id")).select("query_id", "id", (1 - V.cosine(F.col("qvec"), F.col("vec"))).alias("distance")).filter("distance IS NOT NULL AND distance <= 0.3")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    want = sorted(map(tuple, pairs.withColumn("place", place).filter("place <= 4").collect()))
    monkeypatch.setattr(V, "QUERIES", 300)
    monkeypatch.setattr(V, "VECTORS", 200)
    assert sorted(map(tuple, V.nearest_to(q, v, 4, 0.3).collect())) == want and len({r[0] for r in want}) > 1000
    assert V.nearest_to(q.filter("false"), v, 4).count() == V.nearest_to(q, v.filter("false"), 4).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["neighbours_threshold", "addside_nearest", "semantic_low_match"])
def test_neighbours_same_as_sql(spark, name):
    import __spark_entry__ as entry
    from lodewright.compare import difference, duck

    d = "/root/testdata/sf0.001"
    _, _, ours, theirs = difference(entry.queries()[name](spark, d), duck(d), entry.oracle_sql()[name])
    assert not ours and not theirs
