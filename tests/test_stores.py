import json

from pyspark.sql import functions as F

from lodewright.functions.classify import should_parse
from lodewright.operators import shaping as H
from lodewright.operators import stores as S
from lodewright.parse import assemble as A


def one(df):
    return [tuple(r) for r in df.collect()]


def test_merged_json(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": 2}}', '{"b": "x", "d": [1]}'), (None, '{"a": null}'), ("no json", None), ('{"a": 1}', "[1]")], "x string, y string")
    got = [json.loads(r[0]) for r in df.select(S.merged_json(F.col("x"), F.col("y"))).collect()]
    assert got[0] == {"a": 1, "b": "x", "d": [1]} and got[2] == {} and set(got[1]) <= {"a"}


def test_upsert_keeps_the_contract(spark):
    schema = "id long, collection string, repo string, commit_sha string, tree_sha string, repo_role string, branch string, dirty boolean, metadata string"
    old = spark.createDataFrame([(1, "c", "r", "k", "t", "app", "main", False, '{"v": 1, "embedding_contract": {"dim": 4}}'), (2, "c", "r", "k2", "t", "app", None, False, "{}")], schema)
    new = spark.createDataFrame([(8, "c", "r", "k", "t", "lib", "a", True, '{"v": 2}'), (9, "c", "r", "k", "t", "lib", None, True, '{"v": 3}'), (10, "c", "r", "k3", "t", "lib", "b", True, "{}")], schema)
    got = {r["id"]: r for r in S.upsert_snapshots(old, new).collect()}
    assert set(got) == {1, 2, 10} and got[1]["branch"] is None and got[1]["dirty"] and got[1]["repo_role"] == "lib"
    assert json.loads(got[1]["metadata"]) == {"v": 3, "embedding_contract": {"dim": 4}} and got[2]["metadata"] == "{}"
    assert S.upsert_snapshots(old, new.limit(0)).count() == 2 and S.upsert_snapshots(old.limit(0), new).count() == 2


def test_failures_embeddings_and_baselines(spark):
    f = spark.createDataFrame([(1, "a", "py", None, "x" * 3000), (1, "a", "py", None, "x" * 2500), (1, "b", None, "p", None)], "snapshot_id long, source_path string, language string, parser string, error string")
    got = one(S.insert_failures(f.limit(1), f))
    assert sorted((r[1], len(r[4]), r[3]) for r in got) == [("a", 2000, "unknown"), ("b", 0, "p")]
    r = spark.createDataFrame([(1, None, '{"k": 1}'), (2, [1.0], None), (3, None, None)], "id long, embedding array<float>, metadata string")
    e = spark.createDataFrame([(1, [0.5, 0.5], "m"), (1, [0.5, 0.5], "m")], "id long, embedding array<float>, model string")
    s = spark.createDataFrame([(3, "r" * 600, 800)], "id long, reason string, max_chars int")
    got = {x["id"]: x for x in S.update_embeddings(r, e, s).collect()}
    assert got[1]["embedding"] == [0.5, 0.5] and json.loads(got[1]["metadata"]) == {"k": 1, "embedding_model": "m", "embedding_dimension": 2}
    assert got[2]["metadata"] is None and len(json.loads(got[3]["metadata"])["embedding_skip_reason"]) == 500
    b = spark.createDataFrame([("c", "r", None, "f1"), ("c", "r", "x", "f2")], "collection string, repo string, branch string, fingerprint string")
    n = spark.createDataFrame([("c", "r", None, "f3")], b.schema)
    assert sorted(x[3] for x in one(S.freeze_baseline(b, n))) == ["f2", "f3"]


def test_without_repo_and_reuse(spark):
    s = spark.createDataFrame([(1, "c", "r"), (2, "c", "q")], "id long, collection string, repo string")
    f = spark.createDataFrame([(1, "a"), (2, "b")], "snapshot_id long, source_path string")
    out = S.without_repo("c", "r", s, files=f)
    assert one(out["snapshots"]) == [(2, "c", "q")] and one(out["files"]) == [(2, "b")]
    p = spark.createDataFrame([("a", "x"), ("b", None), ("c", "z")], "source_path string, git_blob_sha string")
    d = spark.createDataFrame([("c",)], "source_path string")
    assert dict((r["source_path"], r["reused"]) for r in S.reusable_files(p, p, d).collect()) == {"a": True, "b": False, "c": False}


def test_shapes(spark):
    df = spark.createDataFrame([("k", v) for v in "edcba" * 3] + [("l", "z")], "key string, v string")
    assert sorted(one(H.with_total(df, ["key"], "v", 3, "vs"))) == [("k", 5, ["a", "b", "c"], True), ("l", 1, ["z"], False)]
    n = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 0), (None, 9)], "s string, id long")
    assert one(H.page_after(n, ["s", "id"], ["a", 1], 2)) == [("a", 2), ("a", 3)] and one(H.page_after(n, ["s", "id"], ["a", 3], 9)) == [("b", 0)]
    r = spark.createDataFrame([(1, "c", "ok", 1), (2, "c", "ok", 2), (3, "c", "failed", 0), (4, "d", "running", 0)], "id long, collection string, state string, started_at long")
    assert {x["id"] for x in H.runs_shown(r).filter("shown").collect()} == {2, 3, 4}
    w = spark.createDataFrame([("r", "current"), ("r", "behind"), ("q", "behind")], "repo string, head_status string")
    assert sorted((x["repo"], x["head_status"]) for x in H.snapshots_shown(w).filter("shown").collect()) == [("q", "behind"), ("r", "current")]
    c = spark.createDataFrame([("a", False, "{}", None)], "x string, is_generated boolean, metadata string, y string")
    fields = {k: F.col(k) for k in c.columns}
    assert c.select(H.compact_keys(fields, ("is_generated",)), H.compact(fields, ("is_generated",))).first()[:] == (["x"], '{"x":"a"}')
    t = spark.range(1).select(H.remaining_seconds(F.lit(10), F.lit(30), F.lit(5.0)), H.remaining_seconds(F.lit(0), F.lit(3), F.lit(5.0)), H.rate(F.lit(3), F.lit(0.0)), H.tokens_estimated(F.lit("abcde")))
    assert one(t) == [(10.0, None, None, 2)]


def test_assembled_records_and_edges(spark):
    body = "def f():\n    return g(`x`) + f() + m.run()"
    parsed = spark.createDataFrame(
        [(1, "symbol_definition", "p::function::f::000001", None, "f", "function", 1, 2, body, ["f", "g", "m.run"]), (1, "module_chunk", "p::m::1", None, None, None, 4, 4, "x = 1", [])],
        "file_id long, record_type string, record_id string, parent_record_id string, symbol string, symbol_kind string, line_start int, line_end int, body string, refs array<string>",
    )
    files = spark.createDataFrame([(1, "c", "r", "app", "r/p.py", "python", "source", "source", "aa")], "file_id long, collection string, repo string, repo_role string, source_path string, language string, file_role string, content_class string, file_sha256 string")
    got = {r["record_type"]: r for r in A.assemble(parsed, files).collect()}
    d = got["symbol_definition"]
    assert d["title"] == "f in r/p.py:1-2" and d["display_content"] == f"# f in r/p.py:1-2\n\n- Repo: `r`\n- Role: `app`\n- File role: `source`\n- Content class: `source`\n- Lines: 1-2\n- Symbol: `f`\n\n```python\n{body}\n```"
    assert d["embedding_text"].startswith("type: symbol_definition\ntitle: f in r/p.py:1-2\nsummary: python function definition f in r/p.py\nsymbol: f\nsymbol_kind: function\nsymbols_defined: f\nsymbols_referenced: f, g, m.run\n") and d["embedding_text"].endswith("content:\n" + body)
    assert "Symbol" not in got["module_chunk"]["display_content"]
    e = A.call_edges(parsed, files).collect()
    assert sorted((x["target_symbol"], json.loads(x["metadata"])["call_kind"]) for x in e) == [("g", "direct"), ("m.run", "member")]
    f = spark.createDataFrame([("a ```` b",), ("",)], "b string").select(A.fence(F.col("b")))
    assert one(f) == [("`````",), ("```",)]
    m = spark.range(1).select(A.record_metadata(F.create_map(F.lit("go_package"), F.lit("main"), F.lit("go_imports"), F.lit("fmt"), F.lit("own"), F.lit("x")), ["go_package", "go_imports"]).alias("m")).first()["m"]
    assert m == {"go_package": "main", "own": "x"}


def test_parse_gate(spark):
    rows = [("a.py", "python", None), ("a.py", "python", "read_error"), ("x/files/etc", "text", None), ("a.bin", "binary", None), ("rc.common", None, None), ("a", None, None)]
    df = spark.createDataFrame(rows, "p string, l string, s string").select(should_parse(F.col("p"), F.col("l"), F.col("s")))
    assert [r[0] for r in df.collect()] == [True, False, True, False, True, False]
