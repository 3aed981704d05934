import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodewright.llm.bpe import PerfectHash, encode, load, vocabulary
from lodewright.llm.packing import best_fit, pack

tiktoken = pytest.importorskip("tiktoken")


def public():
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PUBLIC = public()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    h = PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(3000))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_same_ids_as_the_public_encoder(text):
    bpe = load(vocabulary())
    ids = bpe.encode(text)
    assert ids == PUBLIC.encode_ordinary(text)
    assert b"".join(bpe.tokens[bpe.ids.index(i)] if len(text) < 5 else PUBLIC.decode_single_token_bytes(i) for i in ids).decode() == text


def test_odd_texts(spark):
    texts = [None, "", " ", "\n\n\t ", "<|endoftext|> a", "a" * 50_000, "😀" * 3000, "größe nicht gültig 12345 'll", "x = {1:2}\r\n"]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode(df, vocabulary()).collect()}
    assert got == {i: PUBLIC.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    n = {r["doc_id"]: r["n"] for r in encode(df, vocabulary(), count_only=True).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert encode(df.filter("doc_id > 99"), vocabulary()).count() == 0


def brute_best_fit(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits)[1]] -= s
        else:
            free.append(capacity - s)
    return sorted(free)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_counts_pack_as_single_items_do(sizes):
    hist = {s: sizes.count(s) for s in set(sizes)}
    groups = best_fit(hist, 30)
    assert sorted(g.free for g in groups for _ in range(g.m)) == brute_best_fit(sizes, 30)
    held = {}
    for g in groups:
        assert g.free + sum(s * k for s, k in g.parts) == 30
        for s, k in g.parts:
            held[s] = held.get(s, 0) + k * g.m
    assert held == hist


def test_pack_whole(spark):
    rows = [(i, (i * 37) % 90) for i in range(900)] + [(5000, 100), (5001, 101), (5002, 350), (5003, None), (5004, 0), (None, 9), (1, 7)] + [(6000 + i, 10) for i in range(500)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n long"), 100).collect()
    want = sorted((d, n) for d, n in rows if n and d is not None)
    per = {}
    for r in got:
        per.setdefault(r["container"], []).append(r)
    for c in per.values():
        assert sum(r["size"] for r in c) <= 100
        assert sorted(r["position"] for r in c) == list(range(len(c)))
    assert sum(r["size"] for r in got) == sum(n for _, n in want)
    assert sorted(r["token_start"] for r in got if r["doc_id"] == 5002) == [0, 100, 200, 300]
    assert all(r["piece"] == 0 for r in got if r["doc_id"] not in (5001, 5002))
    assert sorted(per) == list(range(len(per)))
    assert pack(spark.createDataFrame([], "doc_id long, n long"), 100).count() == 0
