import json
import subprocess

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodewright.operators import runs as R
from lodewright.parse import chunks as C
from lodewright.parse import extracts as X
from lodewright.sources import repository as Q
from lodewright.streaming import ledger as L


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab {}", max_size=90), max_size=40), st.integers(60, 120), st.integers(0, 3))
def test_line_windows(lines, limit, overlap):
    got = C.line_windows(list(enumerate(lines, 1)), limit, overlap)
    assert sorted({n for w in got for n, _ in w}) == list(range(1, len(lines) + 1))
    for a, b in zip(got, got[1:]):
        assert a[-min(overlap, len(a)) :] == b[: min(overlap, len(a))] if overlap else b[0][0] == a[-1][0] + 1
    assert C.clip("x" * 200, 100).endswith(C.CLIPPED) and len(C.clip("x" * 200, 100)) <= 100


def test_python_records():
    text = "import os\n\n@dec\nclass A:\n    def run(self):\n        return os.path.join(self.x, helper(1))\n\ndef f():\n    return A().run()\n"
    got = C.records_of("a.py", "python", text)
    defs = {r[3]: (r[4], r[5], r[6], r[8]) for r in got if r[0] == "symbol_definition"}
    assert defs["A"][:3] == ("class", 3, 6) and defs["A.run"] == ("method", 5, 6, ["helper", "path.join"]) and defs["f"][0] == "function"
    assert [r[7] for r in got if r[0] == "module_chunk"] == ["import os"]
    assert {r[2] for r in got if r[0] == "code_chunk"} == {r[1] for r in got if r[0] == "symbol_definition"}
    assert [r[0] for r in C.records_of("a.py", "python", "def (:\n")] == ["code_chunk"]


def test_brace_records():
    go = 'package a\n\nfunc (t *T) Run(x int) error {\n\ts := "}"\n\t// }\n\treturn go1(s)\n}\n\ntype T struct {\n\tA int\n}\n'
    assert [d[:2] for d in C.brace_definitions(go, "go")] == [("T.Run", "method"), ("T", "struct")]
    rust = "impl Foo {\n    pub fn bar(&self) -> u8 {\n        1\n    }\n}\nfn main() {}\n"
    assert ("Foo::bar", "method", 2, 4) in C.brace_definitions(rust, "rust") and ("main", "function", 6, 6) in C.brace_definitions(rust, "rust")
    js = "export class A {\n  go(x) {\n    return 1;\n  }\n}\nexport const f = (a) => {\n  return a;\n};\n"
    assert [d[0] for d in C.brace_definitions(js, "javascript")] == ["A", "A.go", "f"]
    c = "static int add(int a,\n               int b)\n{\n    return a + b;\n}\nint later(void);\n"
    assert [d[:4] for d in C.brace_definitions(c, "c")] == [("add", "function", 1, 5)]


def test_kconfig_and_make():
    k = 'menu "x"\nconfig NET\n\tbool "net"\n\tdepends on PCI && !USB\n\tselect CRC\nendmenu\n'
    got = C.records_of("Kconfig", "kconfig", k)
    assert [(r[0], r[3], r[5], r[6], r[8]) for r in got][0] == ("config_symbol", "CONFIG_NET", 2, 5, ["CRC", "PCI", "USB"])
    m = "A := 1\nB = $(A) \\\n  c\ndefine Pkg/x\n  $(B)\nendef\nall: x\n\techo $(A)\n"
    assert [(r[3], r[4], r[5], r[6], r[8]) for r in C.records_of("Makefile", "make", m)][:4] == [("A", "make_assignment", 1, 1, []), ("B", "make_assignment", 2, 3, ["A"]), ("Pkg/x", "make_define", 4, 6, ["B"]), ("all", "make_target", 7, 8, ["A"])]


def test_patch_and_security(spark):
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@ f\n-a\n+b\n@@ -9 +9 @@\n c\n"
    assert [h[0:1] + h[3:] for h in C.patch_records(patch)] == [("x", "@@ -1,2 +1,2 @@ f"), ("x", "@@ -9 +9 @@")]
    texts = {
        1: ("c", "// strcpy(a, b)\nstrcpy(a,\n b);\nstrcpy\n\n\n(x)\n"),
        2: ("python", '"""\nsystem(x)\n"""\nos.system(x)\nx = 1\n\'\'\'one line system(y)\'\'\'\npopen(z); system(y)\n"""open\nsystem(z)\n'),
        3: ("shell", "# eval x\neval `ls`\n"),
        4: ("go", "x := `raw`\r\n/* system(1) */\r\nsystem(2)"),
        5: ("doc", "system(1)"),
        6: ("c", None),
        7: ("c", ""),
    }
    from lodewright.parse.security import scan_security

    df = spark.createDataFrame([(i, *t) for i, t in texts.items()], "file_id long, language string, text string")
    got = sorted((r["file_id"], r["line"], r["rule_id"], r["severity"]) for r in scan_security(df).collect())
    assert got == [(1, 2, "unsafe_string_copy", "medium"), (2, 4, "shell_command_execution", "medium"), (2, 7, "shell_command_execution", "medium"), (3, 2, "shell_backtick_execution", "low"), (3, 2, "shell_eval", "medium"), (4, 3, "shell_command_execution", "medium")]


def test_extracts(spark):
    df = spark.createDataFrame([('#include <a.h>\nif (x) foo(bar(1)); printf("hello %d", CONFIG_X); lambda(1)', "c"), (None, "c"), ("", "python")], "t string, k string")
    got = df.select(X.referenced_symbols(F.col("t"), F.col("k")).alias("r"), *[v.alias(k) for k, v in X.common_extracts(F.col("t")).items()]).collect()
    assert got[0]["r"] == ["bar", "foo", "printf"] and got[0]["includes"] == ["a.h"] and got[0]["config_symbols"] == ["CONFIG_X"] and got[0]["log_error_messages"] == ["hello %d"]
    assert got[1]["r"] is None and got[2]["r"] == []


def test_sections_and_json(spark):
    text = "intro\n# One\nbody 1\n\n## Two\n##### no heading\nbody 2"
    got = X.doc_sections(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["title"], r["line_start"], r["body"]) for r in got] == [(0, "", 1, "intro"), (1, "One", 2, "body 1"), (2, "Two", 5, "##### no heading\nbody 2")]
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": []}}'), (2, "[1]"), (3, "oops")], "id long, text string")
    assert sorted((r["key"], r["value"]) for r in X.json_members(df).collect()) == [("a", "1"), ("b", '{"c":[]}')]


def test_tree_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"x = 1\r\n")
    (tmp_path / "src/b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "big.txt").write_text("x" * 100)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/c.js").write_text("1")
    got = {r["source_path"]: r for r in Q.scan_tree(spark, str(tmp_path), "c", "r", 50).collect()}
    assert set(got) == {"r/src/a.py", "r/src/b.bin", "r/big.txt"}
    assert (got["r/src/a.py"]["text"], got["r/src/a.py"]["language"], got["r/src/a.py"]["content_class"]) == ("x = 1\n", "python", "source")
    assert got["r/src/b.bin"]["skipped_reason"] == "binary_suffix" and got["r/big.txt"]["skipped_reason"] == "file_too_large"
    assert Q.dirty_paths(' M a.py\nR  old -> new\n?? "q r"\n') == {"a.py", "old", "new", "q r"}


def test_git_and_sarif_sources(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "a.py").write_text("1")
    (tmp_path / "b.py").write_text("2")
    subprocess.run(["git", "-C", str(tmp_path), "add", "a.py"], check=True)
    assert [(p, b is None) for p, b in Q.tracked_files(str(tmp_path))] == [("a.py", False), ("b.py", True)]
    (tmp_path / "x.sarif").write_text(json.dumps({"runs": []}))
    assert [r["text"] for r in Q.sarif_documents(spark, str(tmp_path)).collect()] == ['{"runs": []}']


def test_run_states(spark):
    df = spark.sql("SELECT * FROM VALUES (1, NULL, TIMESTAMP '2024-01-01 00:00:00', false, NULL), (2, NULL, TIMESTAMP '2024-01-01 00:09:30', false, NULL), (3, TIMESTAMP '2024-01-01', NULL, true, 1), (4, TIMESTAMP '2024-01-01', NULL, NULL, 0), (5, TIMESTAMP '2024-01-01', NULL, NULL, NULL) AS t(id, f, h, i, x)")
    s = R.run_state(F.col("f"), F.col("h"), F.col("i"), F.col("x"), F.expr("TIMESTAMP '2024-01-01 00:10:00'"))
    assert [r[0] for r in df.orderBy("id").select(s).collect()] == ["stalled", "running", "interrupted", "ok", "failed"]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 00:00:0{i % 9}", i % 5, "click" if i % 2 else "view", 1.0, "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz"))
    df.repartition(4).write.parquet(str(tmp_path / "e.parquet"))
    got = L.run_to_table(L.ledger(L.event_stream(spark, str(tmp_path / "e.parquet"), 1)), "complete", "t")
    want = L.ledger(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    n = L.run_to_table(L.windowed_counts(L.event_stream(spark, str(tmp_path / "e.parquet"), 1)), "append", "w")
    assert n.count() == 2  # only the first day has ended, an hour after the latest event


def test_definitions_of_more_than_400_lines():
    body = "".join(f"    m{i}() {{\n      f{i}('}}');\n    }}\n" for i in range(300))
    found = C.brace_definitions(f"class Long {{\n{body}}}\nfunction after() {{\n}}\n", "javascript")
    assert found[0] == ("Long", "class", 1, 902) and ("Long.m299", "method", 899, 901) in found and found[-1] == ("after", "function", 903, 904)
    go = "func Long() {\n" + "\tcall()\n" * 5000 + "}\n"
    kinds = {r[0]: r for r in C.records_of("a.go", "go", go)}
    assert kinds["symbol_definition"][5:7] == (1, 5002) and kinds["symbol_definition"][8] == ["call"] and kinds["code_chunk"][3] == "Long"


def test_profiles_of_all_languages(spark):
    """Every pattern has one group in both engines, and the samples give the keys they show."""
    import re

    from lodewright.parse import extracts as X

    for language, pairs in X.PROFILES.items():
        assert len({k for k, _ in pairs}) == len(pairs), language
        assert all(re.compile(p).groups == 1 for _, p in pairs), language
        df = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "file_id long, text string")
        assert X.profile_rows(df, language).filter("file_id > 1").count() == 0
    samples = {
        "rust": ("pub mod a;\nuse b::c;\npub struct S;\nimpl T for S {}\nunsafe fn f() {}\n", {"rust_modules": ["a"], "rust_uses": ["b::c"], "rust_structs": ["S"], "rust_impls": ["S"], "rust_functions": ["f"], "rust_uses_unsafe": ["unsafe"]}),
        "typescript": ("import { a } from 'b';\nexport class C {}\ninterface I {}\ntype T = string;\nenum E {}\n", {"js_imports": ["b"], "js_classes": ["C"], "js_exports": ["C"], "ts_interfaces": ["I"], "ts_types": ["T"], "ts_enums": ["E"]}),
        "terraform": ('resource "aws_x" "y" {}\nvariable "v" {}\ndata "d" "e" {}\n', {"terraform_resources": ["aws_x"], "terraform_variables": ["v"], "terraform_data_sources": ["d"]}),
        "dockerfile": ("FROM a:1 AS b\nEXPOSE 80\nCOPY --from=b x y\n", {"docker_base_images": ["a:1"], "docker_stages": ["b"], "docker_instructions": ["FROM", "EXPOSE", "COPY"], "docker_exposed_ports": ["80"], "docker_copy_sources": ["x"]}),
        "xml": ('<?xml version="1.0"?>\n<!-- c -->\n<root a="1"><b/></root>', {"xml_root": ["root"], "xml_elements": ["root", "b"], "xml_attributes": ["version", "a"]}),
    }
    for language, (text, want) in samples.items():
        got = {r["key"]: r["values"] for r in X.profile_rows(spark.createDataFrame([(1, text)], "file_id long, text string"), language).collect()}
        assert got == want, language
