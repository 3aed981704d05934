from hypothesis import given, settings
from hypothesis import strategies as st

from lodewright.llm import split as S


def whole(text, limit, size):
    """Pieces of a text worked on in ranges of `size`, as (begin, new, end) in the text."""
    out = []
    for lo in range(0, len(text), size):
        hi, left = min(lo + size, len(text)), max(0, lo - limit - 1)
        t = text[left : min(len(text), hi + limit)]
        out += [(left + b, left + n, left + e) for b, n, e in S.range_pieces(t, lo - left, hi - left, lo == 0, hi < len(text), limit)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab(;.\n é\U0001f600", max_size=900), st.integers(5, 60), st.integers(120, 400))
def test_pieces_cover_the_text_once_and_keep_the_limit(text, limit, size):
    got = whole(text, limit, size)
    assert "".join(text[n:e] for _, n, e in got) == text
    for b, n, e in got:
        assert b <= n < e and e - b <= limit
        assert text[b:n].count("\n") <= S.OVERLAP_LINES and (b == n or b == 0 or text[b - 1] == "\n")


def test_cuts_prefer_blank_lines_then_statements():
    text = "a = f(1)\n" * 10 + "\n" + "b = f(2)\n" * 5
    (_, _, end), *_ = S.cuts(text, 0, len(text), *S.boundaries(text), limit=100)
    assert text[:end].endswith("\n\n")
    text = "x,\n" * 10 + "done;\n" + "y,\n" * 20
    (_, _, end), *_ = S.cuts(text, 0, len(text), *S.boundaries(text), limit=50)
    assert text[:end].endswith("done;\n")


def test_records(spark):
    long = "line of text here.\n" * 9000 + "x" * 5000
    rows = [(1, "r1", 10, f"# t\n\n- Repo: `a`\n\n```\n{long}\n```"), (1, "r1", 10, f"# t\n\n- Repo: `a`\n\n```\n{long}\n```"), (2, "r2", None, "# t\n\n```\n" + "y" * 2400 + "\n```"), (3, "r3", 1, None), (None, "r5", 1, "# t\n\n```\n" + "y" * 2500 + "\n```"), (4, "r4", None, "# t\n\n````c\n" + "é" * 2401 + "\n````")]
    df = spark.createDataFrame(rows, "id long, record_id string, line_start int, display_content string")
    got = S.split_records(df).orderBy("id", "piece").collect()
    assert {r["id"] for r in got} == {1, 4}
    one = [r for r in got if r["id"] == 1]
    assert [r["piece"] for r in one] == list(range(1, len(one) + 1))
    assert "".join(r["text"][r["char_new"] - r["char_start"] :] for r in one) == long
    for r in one:
        assert len(r["text"]) <= 2400 and r["parent_record_id"] == "r1"
        assert r["line_start"] == 10 + long.count("\n", 0, r["char_start"]) and r["line_end"] == 10 + long.count("\n", 0, r["char_end"] - 1)
    assert S.split_records(df.filter("id > 9")).count() == 0


def test_a_line_over_the_border_of_ranges():
    """A long line whose head only the earlier range sees is rated alike by both, and no text is lost."""
    text = "f(" + "x" * 180 + "\n" + "y,\n" * 30 + "done;\n" + "z,\n" * 40
    for size in (120, 130, 150, 181, 190):
        got = whole(text, 50, size)
        assert "".join(text[n:e] for _, n, e in got) == text


def test_white_space_is_looked_for_over_the_whole_limit():
    text = "word " + "x" * 2395 + "y" * 50
    assert S.cuts(text, 0, len(text), *S.boundaries(text))[0] == (0, 0, 5)


def test_bodies_span_ranges(spark):
    long = "".join(f"value_{i} = call(argument_{i}, other)\n" + ("\n" if i % 23 == 0 else "") for i in range(1500))
    df = spark.createDataFrame([(1, "r", 5, f"# t\n\n```\n{long}```")], "id long, record_id string, line_start int, display_content string")
    got = S.split_records(df).orderBy("piece").collect()
    body = long[:-1]
    assert len(body) > 4 * S.RANGE and "".join(r["text"][r["char_new"] - r["char_start"] :] for r in got) == body
    assert [r["piece"] for r in got] == list(range(1, len(got) + 1))
    for r in got[1:]:
        assert body[: r["char_new"]].endswith("\n\n") and body[r["char_start"] : r["char_new"]].count("\n") == 6
        assert r["line_start"] == 5 + body.count("\n", 0, r["char_start"])


def test_files(spark, tmp_path):
    data = ("zeile mit ä und 😀 drin;\n" * 900).encode() + b"\xff\xfe broken " * 900 + b"\nlast line\n"
    (tmp_path / "big.txt").write_bytes(data)
    (tmp_path / "small.txt").write_bytes(b"one\ntwo\n")
    (tmp_path / "empty").write_bytes(b"")
    for size in (1 << 13, 12_345, 1 << 20):
        rows = S.split_files(spark, str(tmp_path), size).orderBy("path", "piece").collect()
        small = [r for r in rows if r["path"].endswith("small.txt")]
        assert [(r["piece"], r["line_start"], r["line_end"], r["text"]) for r in small] == [(1, 1, 2, "one\ntwo\n")]
        got = [r for r in rows if r["path"].endswith("big.txt")]
        assert len(rows) == len(got) + 1 and [r["piece"] for r in got] == list(range(1, len(got) + 1))
        assert got[0]["byte_new"] == 0 and got[-1]["byte_end"] == len(data)
        assert all(a["byte_end"] == b["byte_new"] for a, b in zip(got, got[1:]))
        for r in got:
            new = data[r["byte_new"] : r["byte_end"]].decode("utf-8", "replace")
            assert len(r["text"]) <= 2400 and r["line_end"] == 1 + data.count(b"\n", 0, r["byte_end"] - 1)
            assert "\ufffd" in new or r["text"].endswith(new)
