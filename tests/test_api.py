import os

import pytest

from lodewright import api

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def index(spark):
    return api.Index(spark, DATA)


def test_arguments(spark):
    assert api.clamp(0, 5) == 1 and api.clamp(9, 5) == 5
    assert api.normal_path(".\\a\\b/") == "a/b"
    with pytest.raises(ValueError):
        api.normal_path("/abs")
    df = spark.createDataFrame([("r", "r/src/a.py", '{"k": 1, "b": true}', True), ("r", "r/x/a.py", "{}", None)], "repo string, source_path string, metadata string, is_test boolean")
    n = lambda **f: api.conditions(df, f).count()
    assert (n(repo="r"), n(source_path="src/a.py"), n(repo="r", source_path="src/a.py"), n(source_path_prefix="src"), n(is_test=False), n(metadata_key="k"), n(metadata_key="k", metadata_value=2), n(metadata_contains={"b": True, "k": 1})) == (2, 1, 1, 1, 1, 1, 0, 1)
    with pytest.raises(ValueError):
        n(nonsense=1)
    with pytest.raises(ValueError):
        n(source_path="a", source_path_prefix="b")


def test_questions(index, spark):
    assert index.code_intel_status().count() == 10
    hits = index.search_code_intel_text("emit_event", 99, {"record_type": "code_chunk"}).collect()
    assert 0 < len(hits) <= 50 and all(h["record_type"] == "code_chunk" for h in hits)
    got = index.get_code_intel_record([hits[0]["record_id"], "nope"]).collect()
    assert [r["found"] for r in got] == [True, False]
    vector = next(h["embedding"] for h in hits if h["embedding"] and len(h["embedding"]) == 48)
    near = index.search_code_intel_semantic("wallet", vector, 5).collect()
    assert len(near) == 5 and max(r["similarity"] for r in near) > 0.99
    assert index.related_code_intel("emit_event", 10).count() <= 10
    assert index.blast_radius("emit_event").count() <= 25
    assert index.find_redundancy(0.2).count() <= 20
    assert index.list_code_intel_files(7, filters={"is_test": False}).count() == 7
    everything = api.Index(spark, DATA, historical=True)
    assert everything.records().count() >= index.records().count()


def test_table_functions(spark):
    api.register(spark)
    got = spark.sql("SELECT t.* FROM VALUES ('python', 'def f():\\n    pass\\n'), ('go', 'x'), ('python', 'def (') AS s(k, x), LATERAL definitions(k, x) t").collect()
    assert [tuple(r) for r in got] == [("f", "function", 1, 2)]
    assert spark.sql("SELECT * FROM line_windows('a\\nb')").collect()[0]["line_end"] == 2
