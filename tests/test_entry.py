import ast
import os

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_names_agree():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_core_does_not_import_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "lodewright")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                for node in ast.walk(ast.parse(open(os.path.join(folder, n)).read())):
                    mods = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any(m.startswith("lodewright.llm") for m in mods), n


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "rank", "match_score"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p3_cascade", "p3_report", "p4_found", "edge_resolve", "blast_radius", "text_any_terms", "semantic_diversified", "gate_regressions", "triage_reconcile", "change_detection"])
def test_same_as_sql(spark, name):
    from lodewright.compare import difference, duck

    _, _, ours, theirs = difference(entry.queries()[name](spark, DATA), duck(DATA), entry.oracle_sql()[name])
    assert not ours and not theirs
