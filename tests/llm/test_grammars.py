import pytest

from lodewright.llm.grammars import parses
from lodewright.llm.parsecheck import examine, parse_check, rates

GOOD = {
    "go": [
        'package a\n\nimport (\n\t"fmt"\n\tb "x/y"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:"a"`\n\t*Base\n\tf func(int) (string, error)\n}\n',
        "package a\nfunc (t *T) f(x ...int) (n int, err error) {\n\tif v, ok := m[k]; ok && v != (T{1}) {\n\t\treturn\n\t}\n\tfor i := range 10 {\n\t\tgo func() { <-c }()\n\t}\nL:\n\tfor {\n\t\tselect {\n\t\tcase c <- 1:\n\t\tcase x, ok := <-d:\n\t\t\tbreak L\n\t\tdefault:\n\t\t}\n\t}\n\tswitch y := x.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t}\n\ts[1:2:3][0]++\n\tx <<= 2\n\tdefer f(a...)\n\treturn map[string][]int{\"a\": {1, 2}}[`raw\n\"`], nil\n}\n",
        "package a\nconst (\n\tX = iota\n\tY\n)\nvar r = '\\u00e9'\nvar z interface{ M(); ~int | string }\nfunc main() { for i := 0; i < 3; i++ {}; if x == y {} else if z {} else {} }\n",
    ],
    "javascript": [
        "", "const a = /[\"'{(/]/g.test(x) / 2\nlet b = `a ${f({x: `n ${1}`})} b`\n",
        "export default class A extends (B, C) { static #p = 1; get x() { return this.#p } async *[Symbol.iterator]() { yield* z } static {} }",
        "import a, { b as c } from 'x'; import * as d from \"y\"; export { c as default, d }; export * from 'z'",
        "for (const [k, { v = 1 }] of m) if (k) continue; else break\n",
        "var f = async (x, { y } = {}, ...z) => { await x; return y?.[0]?.(z) ?? 1 }\nlabel: for (;;) { do x++; while (x < 5) break label }",
        "switch (a) { case 1: default: b() }\ntry { x } catch { y } finally {}\na = b\n++c\nx = {a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, ...f, async g() {}}",
    ],
    "c": [
        "#include <stdio.h>\nstatic const char m[] = \"<<<<<<< HEAD\" \"x\";\nint (*fp)(int, char *);\ntypedef struct node { struct node *next; unsigned f : 3; } node_t;\nenum e { A = 1, B, };\nint main(int argc, char **argv)\n{\n\tnode_t *n = (node_t *)malloc(sizeof(*n));\n\tfor (size_t i = 0; i < 3; i++)\n\t\tn->next[i] = (struct node){ .f = 1 };\n\tif (!n) goto out; else do { n++; } while (0);\n\tswitch (x) { case 'a': break; default: y(); }\nout:\n\treturn (a) ? -1 : b ? 0x1fUL : 1.5e3f;\n}\n",
        "MODULE_LICENSE(\"GPL\");\nstatic inline uint32_t f(const uint8_t *p, size_t n);\n#if X\nint f(void) {\n#else\nint g(void) {\n#endif\n return 0; }\n",
    ],
    "json": ['{"a": [1, 2.5e3, null, true, "\\u00e9"]}', "3", ' [] '],
    "python": ["", "match x:\n    case {'a': 1}: pass\n", "x: int = 1; y = f'{x!r:>{2}}'\nasync def f(*, a): await a\n"],
}
BAD = {
    "go": ["", "package a\nfunc f() {\n", "package a\nvar x = “a”\n", "package a\nfunc f() { x := 1 y := 2 }\n", "package a\nfunc f() error {\n\treturn f(1\n}\n", "package a\n<<<<<<< HEAD\n", "package a\nvar s = \"abc\n", "package a\nx := 1\n"],
    "javascript": ["function f( {", "let = = 1", "if (a {", "<<<<<<< HEAD\na()\n=======\n", "return 1", "f() = 2", "a b", "var x = 'abc\n'", "`abc", "import json\nx = 5", "def f(x):\n    return x\n", "a ? b;", "({a b})", "class { }"],
    "c": ["int f( { }", "int f(void) { return 1 }", "int f(void) {", "version pointer-v1\noid sha256:5521c1\n", "int x = “1”;", "int f(void) { x = g(1, ); }", "=======\nint x;", "char *s = \"abc;\n", "def f(x):\n    return x\n", "int f(void) { if (x return 1; }", '{\n "a": 1\n}'],
    "json": ["", "{'a': 1}", "[1, 2,]", "// c\n{}", "NaN", '{"a": 1} {"b": 2}', '{"a": "x'],
    "python": ["print 'x'", "def f(:\n  pass", "x = (1,\n", "<<<<<<< HEAD\nx\n=======\n", "if x:\n"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_accepted(lang, text):
    assert parses(text, lang) and parses(text, lang)  # the second time from memory
    assert parses(text.replace("\n", "\r\n"), lang)


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in BAD.items() for t in v])
def test_refused(lang, text):
    assert not parses(text, lang) and not parses(text, lang)


def test_memory_does_not_leak_between_places():
    assert parses("function f() {\n  return 1;\n}\n", "javascript")
    assert not parses("  return 1;\n", "javascript")
    assert parses("int f(void)\n{\n    a = 1;\n}\n", "c")
    assert not parses("int f(void)\n{\n    a = 1;\n", "c")


def test_foreign_and_corrupt():
    assert examine(GOOD["go"][0]) == ["go"] and examine(GOOD["c"][0]) == ["c"]
    assert examine("<<<<<<< HEAD\nx\n") == [] and set(examine("")) == {"python", "javascript", "c"}
    assert examine('{"a": [1, 2]}') == ["json", "python"]  # several grammars may take a text


def test_deep_nesting_is_no_error():
    n = 3000
    assert parses("f(" * n + "x" + ")" * n, "javascript") and not parses("f(" * n + "x" + ")" * (n - 1), "javascript")
    assert parses("if (a) b()\nelse " * n + "c()", "javascript")
    assert parses("int x = " + "(" * n + "1" + ")" * n + ";", "c")
    assert parses("package a\nvar x = " + "(" * n + "1" + ")" * n + "\n", "go")
    n = 200_000
    assert parses("[" * n + "]" * n, "json") and not parses("[" * n + "]" * (n - 1), "json") and not parses("[" * n + "1 2" + "]" * n, "json")
    assert parses('{"a": [{}, "\\u00e9", -1.5e3, null, {"b": ' * 50_000 + "true" + "}]}" * 50_000, "json")


def test_rates_hold_skipped_paths(spark):
    checked = spark.createDataFrame([("c", "r", "go", "valid"), ("c", "r", "go", "corrupt")], "collection string, repo string, language string, verdict string")
    files = spark.createDataFrame([("c", "r", "a.go", "go", "read_error"), ("c", "r", "a.go", "go", "read_error"), (None, "r", "b.py", "python", "file_too_large"), ("c", "r", "d", "binary", "binary_nul")], "collection string, repo string, source_path string, language string, skipped_reason string")
    got = {(r["collection"], r["language"]): (r["n_files"], r["n_corrupt"], r["n_skipped"], r["invalid_rate"]) for r in rates(checked, files).collect()}
    assert got == {("c", "go"): (2, 1, 1, 0.5), (None, "python"): (0, 0, 1, None)}


def test_tables(spark):
    raw = spark.createDataFrame(
        [(1, "c", "r", "a.py", "AA", "x = 1\n", "k"), (1, "c", "r", "a.py", "AA", "x = 1\n", "k"), (2, "c", "r", "a.py", "BB", "x = (\n", "k"), (3, "c", "r", "b.go", "cc", '{"a": 1}', "k"), (4, "c", "r", "nowhere.c", "dd", "int", "k"), (5, "c", "r", "a.py", "ee", None, "k"), (6, "c", "r", "d.md", "ff", "(", "k"), (None, "c", "r", "a.py", "gg", "x = (", "k")],
        "raw_id long, collection string, repo string, source_path string, file_sha256 string, content string, language string",
    )
    files = spark.createDataFrame([("c", "r", "a.py", "python"), ("c", "r", "a.py", "python"), ("c", "r", "a.py", "go"), ("c", "r", "b.go", "go"), ("c", "r", "d.md", "doc"), (None, "r", "a.py", "c")], "collection string, repo string, source_path string, language string")
    got = {r["raw_id"]: (r["verdict"], r["parsed_as"], r["file_sha256"]) for r in parse_check(raw, files).collect()}
    assert got == {1: ("valid", "python", "aa"), 2: ("corrupt", None, "bb"), 3: ("wrong_extension", "json", "cc")}
    assert parse_check(raw.filter("raw_id > 9"), files).count() == 0


def test_refusing_by_the_first_lines_is_refusing_the_text():
    from lodewright.llm.grammars.stream import head

    code = "int f(void)\n{\n" + "\ta = g(1);\n" * 30 + "}\n"
    assert head(code) and head("/* " + code) is None and head("x = `\n" * 20) is None and head("a \\\n" * 20) is None and head("short\n") is None
    for n in range(1, 30, 3):  # what only later lines complete is left to the whole text
        assert parses("int a[] = {\n" + "\t1,\n" * n + "};\n", "c") and not parses("int a[] = {\n" + "\t1,\n" * n + ";\n", "c")
        assert parses("f(\n" + "  x,\n" * n + ") \n", "javascript") and not parses("f(\n" + "  x,\n" * n + "; \n", "javascript")
        assert parses("(\n" + "  x,\n" * n + "y) => z\n", "javascript") and not parses("(\n" + "  x,\n" * n + "y z) => z\n", "javascript")
    assert not parses("import os\n" * 20, "c") and not parses("import os\n" * 20, "javascript")
