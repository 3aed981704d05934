import pytest

from lodewright.sources import repository as R
from lodewright.streaming import ledger as L


def test_triage_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "triage")
    assert R.read_triage(spark, path).count() == 0 and not R.has_rows(R.read_triage(spark, path))
    rows = [("a", "c/r", ["x", "y"], "open", None, "2024"), ("b", None, [], "dismissed", "why", None)]
    df = spark.createDataFrame(rows, R.TRIAGE)
    R.write_triage(df, path)
    assert sorted(r["id"] for r in R.read_triage(spark, path).collect()) == ["a", "b"]
    R.write_triage(R.read_triage(spark, path).filter("id = 'b'"), path)  # reads what it replaces
    got = R.read_triage(spark, path).collect()
    assert [(r["id"], r["scope"], r["members"], r["reason"]) for r in got] == [("b", None, [], "why")] and len(list(tmp_path.iterdir())) == 1


def test_only_one_writer(spark, tmp_path):
    path = str(tmp_path / "lock")
    with R.only_writer(spark, path):
        with pytest.raises(RuntimeError), R.only_writer(spark, path):
            pass
    with R.only_writer(spark, path):
        pass


def test_recordset(spark):
    df = spark.createDataFrame([(1, '[{"a": 1, "b": "x"}, {"a": null}]'), (2, "no"), (3, None), (4, "[]")], "id long, j string")
    assert sorted((r["id"], r["a"] or 0, r["b"] or "") for r in R.recordset(df, "j", "a long, b string").collect()) == [(1, 0, ""), (1, 1, "x")]


def test_index_stream_parses_what_changed(spark, tmp_path):
    schema = "collection string, repo string, source_path string, signature string, fetched_at timestamp, path string, language string, text string"
    d = str(tmp_path / "in")
    row = lambda p, sig, at, text: ("c", "r", p, sig, at, p, "python", text)
    from datetime import datetime

    at = [datetime(2024, 1, k) for k in range(1, 5)]
    batches = [
        [row("a.py", "1", at[0], "def f():\n    pass\n"), row("b.py", "1", at[0], "def g():\n    h()\n")],
        [row("a.py", "2", at[2], "def f2():\n    pass\n"), row("a.py", "9", at[1], "def old():\n    pass\n"), row("b.py", "1", at[2], "never parsed, the signature is the stored one")],
    ]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(d)
        import time

        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    got = L.index_stream(stream).filter("record_type = 'symbol_definition'").collect()
    assert sorted((r["source_path"], r["signature"], r["symbol"], tuple(r["refs"])) for r in got) == [("a.py", "2", "f2", ()), ("b.py", "1", "g", ("h",))]


def test_sarif_queries_same_as_sql(spark):
    import os

    import __spark_entry__ as entry
    from lodewright.compare import difference, duck

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    for name in ("sarif_findings", "sarif_gate", "record_texts", "audit_snapshots"):
        _, _, ours, theirs = difference(entry.queries()[name](spark, d), duck(d), entry.oracle_sql()[name])
        assert not ours and not theirs, name
