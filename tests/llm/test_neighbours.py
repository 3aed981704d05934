
import numpy as np
import pytest

from lodewright.llm import neighbours as N

DIM = N.DIM


def test_multi_sequence_is_in_order_and_whole():
    rng = np.random.default_rng(1)
    for k in (1, 2, 7):
        d1, d2, count = rng.random(k), rng.random(k), rng.integers(0, 3, k * k)
        got = N.multi_sequence(d1, d2, count.tolist(), 10**9)
        want = sorted((d1[i] + d2[j], i * k + j) for i in range(k) for j in range(k) if count[i * k + j])
        assert got == [c for _, c in want]
        few = N.multi_sequence(d1, d2, count.tolist(), 4)
        assert few == got[: len(few)] and (sum(count[c] for c in few) >= 4 or few == got)


def data(n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, DIM))
    x[100:200] = x[:100] + rng.normal(size=(100, DIM)) * 0.05
    x[200:300] = x[0] + rng.normal(size=(100, DIM)) * 0.01  # a third of all in one place
    rows = [(i + 1, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    rows += [(1000 + i, [2 * v for v in rows[5][1]]) for i in range(30)]  # copies, by direction
    odd = [(2001, None), (2002, [1.0] * 24), (2003, [0.0] * DIM), (2004, [float("nan")] * DIM), (2005, [None] + [1.0] * (DIM - 1)), (2006, [float("inf")] + [1.0] * (DIM - 1)), (2007, [])]
    return rows, odd


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).round(6)
    np.fill_diagonal(s, -2)
    return {int(ids[i]): [(int(ids[j]), float(s[i, j])) for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


@pytest.mark.parametrize("bin_size,queries", [(8192, 400_000), (16, 60)])
def test_visiting_all_is_exact(spark, monkeypatch, bin_size, queries):
    monkeypatch.setattr(N, "BIN", bin_size)
    monkeypatch.setattr(N, "QUERIES", queries)
    monkeypatch.setattr(N, "PER_CELL", 20)
    rows, odd = data()
    df = spark.createDataFrame([(*r, 0) for r in rows + odd + rows[:3] + [(None, rows[0][1])]], "id long, embedding array<double>, rep int")
    got = {}
    for r in N.nearest(df, 10, visit=10**6).collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["cosine"]))
    want = brute(rows, 10)
    assert set(got) == set(want)
    for i, w in want.items():
        assert len(got[i]) == 10 and sorted(round(c, 4) for _, c in got[i]) == pytest.approx(sorted(round(c, 4) for _, c in w), abs=2e-4)
    assert sorted(n for n, _ in got[1005]) == [6] + [1000 + i for i in range(30) if i != 5][:9]


def test_share_min_cosine_and_queries(spark):
    rows, odd = data()
    df = spark.createDataFrame(rows + odd, "id long, embedding array<double>")
    near = N.nearest(df, 10, visit=10**6, min_cosine=0.95, queries="id % 2 = 0").collect()
    want = {(i, n) for i, w in brute(rows, 10).items() if i % 2 == 0 for n, c in w if c >= 0.95}
    assert {r["id"] for r in near} == {i for i, _ in want} and len(near) == len(want) and all(r["cosine"] >= 0.95 for r in near)


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, embedding array<float>")
    assert N.nearest(df).count() == 0
    one = spark.createDataFrame([(1, [1.0] * DIM)], "id long, embedding array<double>")
    assert N.nearest(one).count() == 0
