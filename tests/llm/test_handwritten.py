import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewright.llm import handwritten as H
from lodewright.llm.handwritten import LABELS, source_labels


TABLE = H.fitted(np.zeros((0, len(H.LIKELY)), int))  # before any fit


def label(text, path="r/src/a.py", shared=0):
    """The label of a file in a hand-written directory, by its features alone."""
    seen = dict(zip(H._SHOWN, H.features(text, path))) | {"shared": shared}
    log = [math.log(H.COMPATIBLE["handwritten"][i]) + sum(TABLE[k][seen[k], i] for k in H.FEATURES) for i in range(5)]
    return LABELS[log.index(max(log))]


def test_features():
    hand = "import os\n\n\ndef f(a):\n    return os.path.join(a, 'x')\n" * 9
    assert label(hand) == "handwritten" and label("") == "handwritten"
    assert label("# Code generated by xgen v1. DO NOT EDIT.\n" + hand) == "generated"
    assert label("// Erzeugt von lens-tool. Nicht bearbeiten!\n\n" + hand, "a.js") == "generated"
    assert label(hand + "\n# Generated on build by taskc-gen\n") == "generated"
    assert label('HEADER = "Code generated by x. DO NOT EDIT."\n' + hand) == "handwritten"
    assert label("# TODO: this table should be generated one day\n" + hand) == "handwritten"
    assert label("".join(f"class M{i}(Message):\n    TAG = {i + 70}\n\n" for i in range(20))) == "generated"
    assert label("x = [\n" + "  1, 22, 3, 0x4f, 55, 6, 7, 8, 9, 10,\n" * 30 + "]\n") == "blob"
    assert label("import sys;" + "a=(b+1)*2;" * 200) == "minified"
    assert label(hand, shared=2) == "vendored"
    assert label("/* SPDX-License-Identifier: MIT */\n" + hand) == "handwritten"  # a notice alone tells nothing outside a vendored tree
    assert label(hand + "SIZES = [1, 2, 3, 4]\nX = 'https://example.org/" + "a" * 300 + "'\n") == "handwritten"


def test_likelihoods_follow_the_sample():
    """In a corpus whose tools leave no phrase but number everything, the phrase loses weight and numbering gains some."""
    rows = np.zeros((3000, len(H.LIKELY)), int)
    rows[:600, list(H.LIKELY).index("counting")] = 1
    before, after = TABLE, H.fitted(rows)
    for k in H.LIKELY:
        assert np.exp(after[k]).sum(axis=0) == pytest.approx([1] * 5)
    assert after["marker"][1, 1] < before["marker"][1, 1] and after["counting"][1, 1] > before["counting"][1, 1]


def test_likelihoods_follow_all_versions(spark):
    """Every one of 24,000 versions counts in the fit, the 37 of the rarest kind too, and each is seen by its values alone."""
    kind = F.when(F.col("raw_id") % 640 == 7, 2).otherwise((F.col("raw_id") % 11 == 3).cast("int"))
    seen = spark.range(24_000).withColumnRenamed("id", "raw_id").withColumns({"kind": kind, "collection": F.lit("c"), "repo": F.lit("r")})
    seen = seen.withColumns({k: F.lit(0) for k in H.FEATURES} | {"counting": (F.col("kind") > 0).cast("int"), "marker": (F.col("kind") > 1).cast("int"), "source_path": F.concat(F.lit("r/"), "kind", F.lit(".py"))})
    at = {x: list(H.LIKELY).index(x) for x in ("counting", "marker")}
    rows = np.zeros((24_000, len(H.LIKELY)), int)
    i = np.arange(24_000)
    rows[i % 640 == 7, at["marker"]] = 1
    rows[(i % 640 == 7) | (i % 11 == 3), at["counting"]] = 1
    table = H.fitted(rows)
    kinds, times = np.unique(rows, axis=0, return_counts=True)
    for k, v in H.fitted(kinds, times).items():
        assert v == pytest.approx(table[k], abs=1e-9)
    got = {r["source_path"]: [r[f"e_{x}"] for x in LABELS] for r in H.evidence(seen).collect()}
    for j, (counting, marker) in enumerate([(0, 0), (1, 0), (1, 1)]):
        value = {"counting": counting, "marker": marker}
        assert got[f"r/{j}.py"] == pytest.approx([sum(table[k][value.get(k, 0), x] for k in H.FEATURES) for x in range(5)], abs=1e-9)


def test_files_without_marks_follow_their_tree(spark):
    """The same file: hand-written in the library's own folder, vendored or generated among marked siblings."""
    neutral, copied, made = ([float(sum(TABLE[k][v.get(k, 0), i] for k in H.FEATURES)) for i in range(5)] for v in ({}, {"shared": 2, "notice": 1}, {"marker": 1, "counting": 1}))
    rows = [("c", "r", f"r/{p}", *e) for p, e in [("src/own.c", neutral), ("src/two.c", neutral), ("vendor/lib/own.c", neutral), *((f"vendor/lib/{i}.c", copied) for i in range(4)), ("src/gen/own.c", neutral), *((f"src/gen/{i}.c", made) for i in range(4)), ("third_party/own.c", neutral), ("src/copy.c", copied)]]
    df = spark.createDataFrame(rows, "collection string, repo string, source_path string, " + ", ".join(f"e_{x} double" for x in LABELS))
    got = {r["source_path"][2:]: r["label"] for r in H.propagate(df).collect()}
    assert {k: v for k, v in got.items() if "own" in k} == {"src/own.c": "handwritten", "vendor/lib/own.c": "vendored", "src/gen/own.c": "generated", "third_party/own.c": "handwritten"}
    assert got["src/copy.c"] == "vendored" and got["src/two.c"] == "handwritten"


def test_propagation_is_exact(spark):
    """Marginals of a small tree against the sum over all labellings."""
    leaves = [("r/a/x", (1.0, 2.0, 0.0, 0.0, 0.5)), ("r/a/y", (0.0, 0.0, 0.0, 3.0, 0.0)), ("r/vendor/z", (0.5, 0.0, 0.0, 0.2, 0.0))]
    rows = [("c", "r", p, *e) for p, e in leaves]
    df = spark.createDataFrame(rows, "collection string, repo string, source_path string, " + ", ".join(f"e_{x} double" for x in LABELS))
    got = {r["source_path"]: [r[f"p_{x}"] for x in LABELS] for r in H.propagate(df).collect()}
    psi, nested = [H.COMPATIBLE[y] for y in LABELS], [H.NESTED[y] for y in LABELS]
    named = [H.NESTED[y] if y == "vendored" else H.HINTED["vendored"] for y in LABELS]
    want = {p: [0.0] * 5 for p, _ in leaves}
    for root, r, a, v, x, y, z in itertools.product(range(5), repeat=7):
        w = H.PRIOR[root] * nested[root][r] * nested[r][a] * named[r][v] * psi[a][x] * psi[a][y] * psi[v][z]
        w *= math.exp(leaves[0][1][x] + leaves[1][1][y] + leaves[2][1][z])
        for (p, _), k in zip(leaves, (x, y, z)):
            want[p][k] += w
    for p, w in want.items():
        assert got[p] == pytest.approx([k / sum(w) for k in w], abs=1e-9)


def test_tables(spark):
    lib_text = " ".join(f"word{i} = call{i}(arg{i})" for i in range(80))
    hand = "import os\n\ndef f(a):\n    return os.path.join(a)\n"
    raw = [(1, "c", "r", "r/a.py", hand), (1, "c", "r", "r/a.py", hand), (2, "c", "r", "r/copy.py", lib_text.replace("word7", "other").replace(" word", "\nword")), (3, "c", "r", "r/n.py", None), (4, "c", "r", "r/e.py", ""), (5, "c", "r", "r/d.md", "x"), (6, "c", None, "r/a.py", hand), (None, "c", "r", "r/a.py", hand)]
    raw = spark.createDataFrame([(*r, 0) for r in raw], "raw_id long, collection string, repo string, source_path string, content string, label int")
    files = spark.createDataFrame([("c", "r", f"r/{p}", "doc" if p == "d.md" else "python") for p in ("a.py", "copy.py", "n.py", "e.py", "d.md")], "collection string, repo string, source_path string, language string")
    lib = spark.createDataFrame([(1, lib_text)], "lib_file_id long, content string")
    want = {"r/a.py": "handwritten", "r/copy.py": "vendored", "r/e.py": "handwritten"}
    assert {r["source_path"]: r["label"] for r in source_labels(raw, files, lib).collect()} == want
    H.MOST_RUNS, keep = 60, H.MOST_RUNS  # in several blocks
    try:
        assert {r["source_path"]: r["label"] for r in source_labels(raw, files, lib).collect()} == want
    finally:
        H.MOST_RUNS = keep
    assert "vendored" not in {r["label"] for r in source_labels(raw, files, lib.filter("lib_file_id > 1")).collect()}
    assert source_labels(raw.filter("raw_id > 99"), files, lib).count() == 0


def test_shares_of_rows_delivered_twice(spark):
    own, lib = ("".join(f"def {w}{i}(a, b):\n    return a * {i} + b - {w}_{i}(a)\n\n" for i in range(n)) for w, n in (("own", 120), ("lib", 60)))
    rows = [(1, "c", "r", "src/a.py", own + lib), (1, "c", "r", "src/a.py", own + lib), (2, "c", "r", "src/b.py", own)]
    raw = spark.createDataFrame(rows, "raw_id long, collection string, repo string, source_path string, content string")
    library = spark.createDataFrame([(lib,)], "content string")
    one = {(r["raw_id"], r["shared"]) for r in H.shown(raw, library).collect()}
    H.MOST_RUNS, keep = 100, H.MOST_RUNS
    try:
        assert {(r["raw_id"], r["shared"]) for r in H.shown(raw, library).collect()} == one == {(1, 1), (2, 0)}
    finally:
        H.MOST_RUNS = keep
