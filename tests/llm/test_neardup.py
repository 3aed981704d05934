import itertools
import random

import pytest

from lodewright.llm import neardup as N
from lodewright.llm.bodies import body


def fence(text, mark="```"):
    return f"# title\n\n- Repo: `x`\n\n{mark}c\n{text}\n{mark}"


def corpus():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    out, i = {}, 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(90)]
        for edits in (0, 0, 3, 6, 9, 40):
            t = list(base)
            for _ in range(edits):
                t[rnd.randrange(90)] = rnd.choice(words)
            i += 1
            out[i] = fence(" ".join(t))
    hot = [rnd.choice(words) for _ in range(120)]
    for k in range(40):  # a family of different texts that all share most coordinates
        t = list(hot)
        t[k] = f"own{k}"
        i += 1
        out[i] = fence("\n".join(t), "````")
    for text in (None, "", "no fence " * 40, fence("too few tokens"), fence(""), fence("é " * 300), fence("a b c " * 40)):
        i += 1
        out[i] = text
    return out


def brute(texts):
    runs = {i: N.runs(body(t) or "") for i, t in texts.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(runs), 2) if N.likeness(runs[a], runs[b]) >= 0.5}


@pytest.mark.parametrize("hot,block,long", [(256, 1024, 16_384), (3, 8, 1000), (5, 8, 36)])
def test_same_pairs_as_brute_force(spark, monkeypatch, hot, block, long):
    monkeypatch.setattr(N, "LONG", long)
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "BLOCK", block)
    texts = corpus()
    rows = [(i, t, "x", 1) for i, t in texts.items()] + [(1, texts[1], "x", 1), (1, texts[1], "x", 1), (None, texts[1], None, None)]
    df = spark.createDataFrame(rows, "id long, text string, sig string, rep int")
    got = [tuple(r) for r in N.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts)


def test_groups(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r["id"]: r for r in N.groups(df).collect()}
    assert set(got) == {i for i, t in texts.items() if N.runs(body(t) or "")}
    root = {i: i for i in got}
    for a, b in sorted(brute(texts)):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def find(x):
        return x if root[x] == x else find(root[x])

    assert {i: r["group_id"] for i, r in got.items()} == {i: find(i) for i in got}
    assert got[1]["class_id"] == got[2]["class_id"] == 1 and got[1]["n_links"] >= 1


def family(rnd, n, tokens, shared, first=0):
    """n texts of which `shared` tokens are one template, in one piece, and the others their own; every tenth is an edit of the one before."""
    words = [f"w{i}" for i in range(3000)]
    template, out = [rnd.choice(words) for _ in range(shared)], {}
    for k in range(n):
        own = [rnd.choice(words) for _ in range(tokens - shared)]
        if k % 10 == 9:
            own = list(last)
            own[5] = "edited"
        out[first + k] = fence(" ".join(template + own))
        last = own
    return out


def test_a_template_of_a_quarter_of_all_texts_makes_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 32)  # lists up to HOT make up to HOT / 2 candidates a posting, which is linear in the texts
    rnd = random.Random(5)
    texts = family(rnd, 1250, 120, 42) | {10_000 + i: t for i, t in enumerate(t for k in range(375) for t in family(rnd, 10, 120, 0).values())}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    want = {(i, i + 1) for i in range(8, 1250, 10)} | {(10_000 + i, 10_001 + i) for i in range(8, 3750, 10)}
    _, reps = N.classes(df)
    met = {tuple(r) for r in N.candidate_pairs(N.cut(reps)).collect()}
    assert want <= met and len(met) < 40_000  # of 12 million pairs, 780,000 of them within the template
    assert {tuple(r) for r in N.similar_pairs(df).collect()} == want


def test_a_template_of_nearly_half_of_each_text(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 50)
    monkeypatch.setattr(N, "BLOCK", 64)
    texts = family(random.Random(6), 400, 120, 66)
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert {tuple(r) for r in N.similar_pairs(df).collect()} == brute(texts)


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert N.similar_pairs(df).count() == 0 and N.groups(df).count() == 0


def test_body():
    assert body(fence("a\n```x\nb", "````")) == "a\n```x\nb" and body(fence("")) == "" and body("```\n```") == ""
    assert body("```c\nabc") is None and body("a ```\nb\n```") is None and body(None) is None
