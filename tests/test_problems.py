from datetime import datetime as D

import pytest

from lodewright.operators.orphans import orphan_references, orphan_report
from lodewright.operators.snapshot_diff import snapshot_changes

SNAP = "id long, collection string, repo string, branch string, created_at timestamp, source_path string"
FILE = "id long, snapshot_id long, collection string, repo string, source_path string, file_sha256 string, git_blob_sha string, size_bytes long, created_at timestamp, leaf int"


def day(n):
    return D(2024, 1, n)


@pytest.fixture(scope="module")
def snaps(spark):
    rows = [(1, "c", "r", None, day(1)), (3, "c", "r", None, day(2)), (2, "c", "r", None, day(3)), (2, "c", "r", None, day(3)), (9, "c", "r", "dev", day(2)), (None, "c", "r", None, day(9))]
    return spark.createDataFrame([(*r, "clash") for r in rows], SNAP)


def files(spark, rows):
    return spark.createDataFrame([(i, s, "c", "r", p, sha, blob, size, at, 7) for i, (s, p, sha, blob, size, at) in enumerate(rows)], FILE)


def changes(df):
    return sorted((r["snapshot_id"], r["source_path"], r["change"]) for r in df.collect())


def test_changes(spark, snaps):
    rows = [
        (1, "same", "AA", "b", 1, day(1)), (3, "same", "aa", "x", 9, day(1)), (2, "same", "aA", None, None, day(1)),
        (1, "sha", "a1", "b", 1, day(1)), (3, "sha", "a2", "b", 1, day(1)), (2, "sha", "a2", "b", 1, day(1)),
        (1, "blob", None, "b1", 1, day(1)), (3, "blob", "zz", "B1", 2, day(1)), (2, "blob", None, "b2", 2, day(1)),
        (1, "size", None, None, 1, day(1)), (3, "size", "q", None, 1, day(1)), (2, "size", None, "w", 2, day(1)),
        (1, "gone", "a", "b", 1, day(1)), (2, "back", "a", "b", 1, day(1)),
        (3, "wrong", "late", "b", 1, day(2)), (3, "wrong", "early", "b", 1, day(1)), (1, "wrong", "late", "b", 1, day(1)), (2, "wrong", "late", "b", 1, day(1)),
    ]
    got = changes(snapshot_changes(snaps, files(spark, rows)))
    assert got == [(2, "back", "added"), (2, "blob", "changed"), (2, "size", "changed"), (3, "gone", "removed"), (3, "sha", "changed")]


def test_changes_of_nothing(spark, snaps):
    assert snapshot_changes(snaps, files(spark, [])).count() == 0
    assert snapshot_changes(snaps.filter("false"), files(spark, [(1, "a", "a", "a", 1, day(1))])).count() == 0
    got = changes(snapshot_changes(snaps, files(spark, [(1, "a", "a", "a", 1, day(1))])))
    assert got == [(3, "a", "removed")]


def test_many_leaves(spark, snaps):
    rows = [(s, f"p{i}", f"{i}" if s != 2 or i % 97 else "new", None, 1, day(1)) for s in (1, 3, 2) for i in range(1500)]
    got = snapshot_changes(snaps, files(spark, rows))
    assert {(r["source_path"], r["snapshot_id"]) for r in got.collect()} == {(f"p{i}", 2) for i in range(0, 1500, 97)}


REC = "id long, collection string, repo string, source_path string, file_sha256 string, record_type string, record_id string, parent_record_id string, symbol string, created_at timestamp, metadata string"
EDGE = "id long, snapshot_id long, collection string, repo string, source_record_id string, target_record_id string, target_symbol string, metadata string, created_at timestamp, kind string"


def orphans(spark, records, edges, file_rows):
    r = spark.createDataFrame([(i, "c", "r", p, sha, t, rid, par, sym, at, "{}") for i, p, sha, t, rid, par, sym, at in records], REC)
    e = spark.createDataFrame([(i, s, "c", "r", a, b, sym, m, at, "x") for i, s, a, b, sym, m, at in edges], EDGE)
    return orphan_references(e, files(spark, file_rows), r)


def test_orphans_direct_and_inherited(spark):
    d = "symbol_definition"
    recs = [
        (1, "f", "AB", d, "def1", None, "m.run", day(1)), (1, "f", "AB", d, "def1", None, "m.run", day(1)),
        (2, "f", "ab", "code_chunk", "c2", "def1", None, day(1)), (3, "f", "ab", "code_chunk", "c3", "nope", None, day(1)),
        (4, "f", "ab", "code_chunk", "c4", "c3", None, day(1)), (5, "f", "ab", "code_chunk", "c5", "c4", None, day(1)), (6, "f", "ab", "x", "c6", "", None, day(1)),
        (7, "f", "other", d, "late", None, "solo", day(9)), (8, "f", None, "x", "r1", "r2", None, day(1)), (9, "f", None, "x", "r2", "r1", None, day(1)),
    ]
    fl = [(10, "f", "aB", None, 1, day(1)), (11, "f", "OTHER", None, 1, day(1))]
    edges = [
        (1, 10, "def1", "missing", None, None, day(2)), (1, 10, "def1", "missing", None, None, day(2)), (2, 10, "c3", None, "run", "{}", day(2)),
        (3, 10, "c5", None, "walk", None, day(2)), (4, 10, "", "", "walk", '{"target_resolvable": false}', day(2)), (5, 11, "late", None, "x.solo", None, day(2)),
        (6, 10, "def1", None, "run", None, None), (7, None, "def1", None, None, None, day(2)), (8, 11, "late", None, "x.solo", None, day(9)),
    ]
    got = {(r["table_name"][19:], r["row_id"], r["field_name"][:8], r["origin"]) for r in orphans(spark, recs, edges, fl).collect()}
    assert got == {
        ("records", 3, "parent_r", "direct"), ("records", 4, "parent_r", "inherited"), ("records", 5, "parent_r", "inherited"),
        ("edges", 1, "target_r", "direct"), ("edges", 2, "source_r", "inherited"), ("edges", 3, "source_r", "inherited"), ("edges", 3, "target_s", "direct"),
        ("edges", 5, "source_r", "direct"), ("edges", 5, "target_s", "direct"), ("edges", 6, "source_r", "direct"), ("edges", 6, "target_s", "direct"), ("edges", 7, "source_r", "direct"),
    }


def test_orphans_of_nothing(spark):
    assert orphans(spark, [], [], []).count() == 0
    found = orphans(spark, [], [(1, 1, "a", None, None, None, day(2))], [])
    assert [tuple(r) for r in orphan_report(found).collect()] == [("project_code_intel_edges", "source_record_id", "2024-01", "direct", 1)]
