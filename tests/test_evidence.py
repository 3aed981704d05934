import difflib
import itertools

from pyspark.sql import functions as F

from lodewright.operators import evidence as E


def test_staleness(spark):
    s = spark.sql("SELECT * FROM VALUES ('c', 'r', 'main', 'aa', true, TIMESTAMP '2024-01-01'), ('c', 'q', NULL, 'bb', false, TIMESTAMP '2024-01-01'), ('c', 'z', NULL, 'cc', false, TIMESTAMP '2024-01-01') AS t(collection, repo, branch, commit_sha, dirty, created_at)")
    h = spark.createDataFrame([("c", "r", "dev", "ab", 2), ("c", "q", None, "bb", 0)], "collection string, repo string, branch string, commit_sha string, n_behind int")
    got = {r["repo"]: (r["stale"], r["age_s"]) for r in E.staleness(s, h, F.expr("TIMESTAMP '2024-01-02'")).collect()}
    assert got == {"r": (["commit", "branch", "upstream", "dirty"], 86400.0), "q": ([], 86400.0), "z": ([], 86400.0)}
    runs = spark.sql("SELECT * FROM VALUES ('a', 'r', 'aaff', TIMESTAMP '2023-12-01'), ('b', 'r', 'ff', TIMESTAMP '2024-02-01'), ('d', 'q', NULL, TIMESTAMP '2024-02-01') AS t(path, repo, revision, modified_at)")
    assert sorted((r["path"], r["warning"]) for r in E.sarif_freshness(runs, s).collect()) == [("a", "older_than_commit"), ("b", "other_revision")]


def test_edits(spark):
    df = spark.createDataFrame([("def a():\n  pass\nclass B:\n  pass", "class B:\n  pass\nasync def c():\n  pass\nfunc (x *T) D() {}")], "o string, n string")
    added, removed = E.edited_definitions(F.col("o"), F.col("n"))
    r = df.select(added.alias("a"), removed.alias("r")).first()
    assert (r["a"], r["r"]) == (["c", "D"], ["a"])
    assert E.definition_slice("x\ndef f(a):\n    b\n\n    c\ny", "f") == "def f(a):\n    b\n\n    c"
    assert E.definition_slice("func g() {\n\tx\n}\nz", "g") == "func g() {\n\tx" and E.definition_slice("x", "h") is None


def test_group_likeness(spark):
    bodies = ["def a():\n  x = 1\n  return x", "def b():\n  x = 1\n  return x", "def a():\n  x = 1\n  return x", 'def c():\n  """doc"""\n  y = 2\n\n  return y']
    df = spark.createDataFrame([("k", f"m{i}", b) for i, b in enumerate(bodies)], "cluster string, key string, body string")
    got = E.group_likeness(df).first()
    want = [difflib.SequenceMatcher(None, E.plain_body(x), E.plain_body(y)).ratio() for x, y in itertools.combinations(bodies, 2)]
    assert abs(got["avg_text"] - sum(want) / len(want)) < 0.02 and got["max_text"] == 1.0
    assert E.plain_body('def c():\n  """doc\n  more"""\n  y  \n\n    z') == "  y\n    z"
    assert E.plain_body("async def c(\n    a: int,\n    b=(1, 2),\n) -> int:\n    return a\n") == "    return a" and E.plain_body("x\n\ny") == "x\ny" and E.plain_body("") == ""


def test_embed(spark):
    def embedder(texts):
        if any("bad" in t or len(t) > 1000 for t in texts):
            raise RuntimeError
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None), (4, "y" * 5000), (5, "z")], "id long, embedding_text string")
    got = {r["id"]: (r["embedding"], r["skipped"]) for r in E.embed(df, embedder, 4).collect()}
    assert got[1] == ([3.0], False) and got[2] == (None, True) and got[3] == (None, True) and got[5] == ([1.0], False)
    assert got[4][0][0] <= 1000 and not got[4][1]


def test_rulepacks(spark):
    df = spark.createDataFrame([("p", "P", "gate", [("a", "x"), ("a", "y"), ("", "z")]), ("q", None, "odd", [("a", "x")]), ("e", "E", "advisory", None)], "pack string, name string, tier string, rules array<struct<id:string,pattern:string>>")
    got = sorted((r["pack"], r["issue"]) for r in E.rulepack_issues(df).collect())
    assert got == [("e", "no_rules"), ("p", "duplicate_id"), ("p", "incomplete_rule"), ("p", "shared_id"), ("q", "no_name"), ("q", "shared_id"), ("q", "unknown_tier")]
