"""The k nearest vectors by cosine with an inverted multi-index (Babenko and Lempitsky, 2012).

Both halves of a vector are quantised separately, so K centroids a half make K * K cells. For a query the
cells are walked in order of the summed distance of its halves to the two centroids (multi-sequence
algorithm with a heap) until they hold `visit` entries; those are reranked by their true cosine.

The index holds every vector. Equal vectors are one entry with a bounded list of its least ids, from which
the lists of all copies follow. Cells are packed into bins of at most BIN entries, larger cells split into
blocks, and queries meet entries bin by bin. A bin that more than QUERIES queries want is laid out several times, as
many as an estimate from PROBED walks says, and its queries are dealt out over these; no other entry is copied.
K grows with the square root of the number of entries up to MOST_K, so that a cell holds PER_CELL on average; beyond
that, visit grows with the cells, so that at least WALK cells of average size are walked. The centroids are fitted on the
entries with the least hashes, SAMPLE of them and FITTED a centroid at least, the one bounded sample here.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewright.session import cut

DIM, SAMPLE, FITTED, PER_CELL, MOST_K, WALK, BIN, QUERIES, PROBED = 48, 30_000, 30, 100, 2048, 40, 8192, 400_000, 2000


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows (id, embedding) with dim finite elements, not all zero."""
    e = F.col("embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.select("id", "embedding").filter(F.col("id").isNotNull() & (F.size(e) == dim) & F.forall(e, fine) & F.exists(e, lambda x: x != 0))


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        x = np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)
        raw = [r.tobytes() for r in x]
        yield pd.DataFrame({"id": pdf["id"], "h1": [xxhash.xxh3_64_intdigest(r) - 2**63 for r in raw], "h2": [xxhash.xxh64_intdigest(r) - 2**63 for r in raw], "vec": raw})


def matrix(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from k of the rows, evenly spaced in the sample's hash order; empty centroids stay."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c, dtype=np.float64)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def multi_sequence(d1: np.ndarray, d2: np.ndarray, count: np.ndarray, visit: int) -> list[int]:
    """Cells i * len(d2) + j in order of d1[i] + d2[j], until they hold visit entries; empty cells are passed over."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    k1, k2 = len(s1), len(s2)
    out, held, heap = [], 0, [(s1[0] + s2[0], 0, 0)]
    done = [0] * k1  # cells of row i walked so far; row i may go on once row i - 1 is further
    while heap and held < visit:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * k2 + o2[j]
        if n := count[cell]:
            out.append(cell)
            held += n
        done[i] = j + 1
        if j + 1 < k2 and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < k1 and done[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return out


def _best(q: np.ndarray, e: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each q, by (s descending, e)."""
    order = np.lexsort((e, -s, q))
    q = q[order]
    first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def nearest(vectors: DataFrame, k: int = 10, visit: int = 4000, effort: float = 0.0, min_cosine: float | None = None, queries: str | None = None) -> DataFrame:
    """(id, neighbour, cosine): the k best of the entries visited for each usable vector (id, embedding).

    At least visit entries are visited for each query, and effort * n^(2/3) of n entries, which keeps recall as n grows. min_cosine leaves out lesser neighbours before any
    shuffle, which gives the same as leaving them out at the end. queries, an SQL condition on id, names the
    vectors that get a list, against all. Ties go to the lesser id. Vectors that are null, of another length, with null,
    NaN or infinite elements, or all zero are neither query nor neighbour. Rows with an id seen before are one
    row, rows without an id are left out. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    signed = cut(usable(vectors).mapInPandas(_units, "id long, h1 long, h2 long, vec binary").dropDuplicates(["id"]))
    asks = F.expr(queries or "true")
    reps = signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min_by("vec", "id").alias("vec"), F.max(asks).alias("asks"))
    n = reps.count()
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, cosine double")
    kk = int(min(MOST_K, max(1, round((n / PER_CELL) ** 0.5))))
    size = max(SAMPLE, FITTED * kk)
    chosen = F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < F.lit(int(max(1, min(1_000_000, 1_200_000 * size / n))))  # so many rows, not size of every task, go to the driver
    sample = reps.select("rep", "vec").filter(chosen if n > size else F.lit(True)).orderBy(F.xxhash64("rep"), "rep").limit(size).toPandas()
    sample = sample if len(sample) else reps.select("rep", "vec").orderBy("rep").limit(size).toPandas()
    kk = min(kk, len(sample))
    visit = max(k + 1, visit, int(np.ceil(effort * n ** (2 / 3))), int(np.ceil(WALK * n / kk**2)))
    half = DIM // 2
    x = matrix(sample["vec"])
    c1, c2 = centroids(x[:, :half], kk), centroids(x[:, half:], kk)

    def distances(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (c1**2).sum(1) - 2 * (v[:, :half] @ c1.T), (c2**2).sum(1) - 2 * (v[:, half:] @ c2.T)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d1, d2 = distances(matrix(pdf["vec"]))
                yield pdf.assign(cell=(d1.argmin(1) * kk + d2.argmin(1)).astype(np.int32))[["rep", "cell", "vec", "asks"]]

    entries = cut(reps.mapInPandas(assign, "rep long, cell int, vec binary, asks boolean"))
    count = np.zeros(kk * kk, np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most MOST_K ** 2 rows
        count[r["cell"]] = r["count"]
    blocks = np.maximum(1, -(-count // BIN))
    first_bin, at, fill = np.zeros(kk * kk, np.int64), 0, 0
    for cell in range(kk * kk):
        if fill and fill + count[cell] > BIN:
            at, fill = at + 1, 0
        first_bin[cell] = at
        if blocks[cell] > 1:
            at, fill = at + int(blocks[cell]), 0
        else:
            fill += int(count[cell])
    shared = spark.sparkContext.broadcast((first_bin, blocks, count.tolist()))

    def walked(pdf: pd.DataFrame) -> list[dict[int, list[int]]]:
        """Per query its cells by bin."""
        first, blk, seen = shared.value
        d1, d2 = distances(matrix(pdf["vec"]))
        out = []
        for a, b in zip(d1, d2):
            by_bin: dict[int, list[int]] = {}
            for cell in multi_sequence(a, b, seen, visit):
                for i in range(blk[cell]):
                    by_bin.setdefault(int(first[cell]) + i, []).append(cell)
            out.append(by_bin)
        return out

    def wanted(batches):
        for whole in batches:
            bins = [b for lo in range(0, len(whole), 2000) for by_bin in walked(whole.iloc[lo : lo + 2000]) for b in by_bin]
            yield pd.DataFrame({"bin": bins}, dtype="int64")

    asking = entries.filter("asks")
    n_asks = asking.count()
    few = F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1_000_000)) < F.lit(int(min(1_000_000, 1_000_000 * PROBED / max(1, n_asks))))
    salts = np.ones(at + 1, np.int64)
    if n_asks > QUERIES:  # below, no bin can be wanted too often
        for r in asking.filter(few).mapInPandas(wanted, "bin long").groupBy("bin").count().collect():  # a row per bin of entries
            salts[r["bin"]] = max(1, round(r["count"] / PROBED * n_asks / QUERIES))
    dealt = spark.sparkContext.broadcast(salts)

    def place(batches):
        first, blk, _ = shared.value
        for pdf in batches:
            if len(pdf):
                c = pdf["cell"].to_numpy()
                one = pdf.assign(bin=first[c] + pdf["rep"].to_numpy() % blk[c])[["bin", "rep", "cell", "vec"]]
                times = dealt.value[one["bin"]]
                one = one.loc[one.index.repeat(times)]
                yield one.assign(salt=(np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32))

    def walk(batches):
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                pdf = whole.iloc[lo : lo + 2000]
                out = [(bn, q, v, cells, q % dealt.value[bn]) for q, v, by_bin in zip(pdf["rep"], pdf["vec"], walked(pdf)) for bn, cells in by_bin.items()]
                yield pd.DataFrame(out, columns=["bin", "rep", "vec", "cells", "salt"])

    def meet(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64"), "cos": pd.Series([], dtype="float64")})
        if not len(e) or not len(p):
            return none
        e = e.sort_values("cell", kind="stable")
        ev, eid, ec = matrix(e["vec"]), e["rep"].to_numpy(), e["cell"].to_numpy()
        qv, qid = matrix(p["vec"]), p["rep"].to_numpy()
        sizes = p["cells"].str.len().to_numpy()
        row, cell = np.repeat(np.arange(len(p)), sizes), np.concatenate(p["cells"].to_list())
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        found: list[tuple] = []
        held = 0
        for c in np.unique(cell):
            a, b = np.searchsorted(ec, [c, c + 1])
            if a == b:
                continue
            rows = row[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]
            for lo in range(0, len(rows), 1024):
                r = rows[lo : lo + 1024]
                s = qv[r] @ ev[a:b].T
                if min_cosine is not None:
                    i, j = np.nonzero(s >= min_cosine)
                elif b - a > k + 1:
                    j = np.argpartition(-s, k, axis=1)[:, : k + 1].ravel()
                    i = np.repeat(np.arange(len(r)), k + 1)
                else:
                    i, j = (g.ravel() for g in np.indices(s.shape))
                other = qid[r[i]] != eid[a + j]
                i, j = i[other], j[other]
                found.append((qid[r[i]], eid[a + j], s[i, j].astype(np.float64)))
                held += len(i)
                if held > 2_000_000:
                    q, n_, s_ = (np.concatenate(z) for z in zip(*found))
                    top = _best(q, n_, s_, k)
                    found, held = [(q[top], n_[top], s_[top])], 0
        if not found:
            return none
        q, n_, s_ = (np.concatenate(z) for z in zip(*found))
        top = _best(q, n_, s_, k)
        return pd.DataFrame({"q": q[top], "n": n_[top], "cos": s_[top]})

    placed = entries.mapInPandas(place, "bin long, rep long, cell int, vec binary, salt int")
    probes = asking.mapInPandas(walk, "bin long, rep long, vec binary, cells array<int>, salt int")
    met = placed.groupBy("bin", "salt").cogroup(probes.groupBy("bin", "salt")).applyInPandas(meet, "q long, n long, cos double")
    if at:
        best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("c"), F.col("n").alias("n")))), 1, k)
        met = met.groupBy("q").agg(best.alias("b")).select("q", F.inline("b")).select("q", "n", (-F.col("c")).alias("cos"))
    return _with_copies(signed, reps, met, k, asks)


def _with_copies(signed: DataFrame, reps: DataFrame, met: DataFrame, k: int, asks) -> DataFrame:
    """Lists of entries turned into lists of ids: every entry stands for its ids, and copies are each other's nearest."""
    members = signed.select("id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep")
    w = lambda *c: Window.partitionBy(*c).orderBy("id")
    few = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = few.withColumn("r", F.row_number().over(w("rep", "salt"))).filter(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(w("rep"))).filter(F.col("r") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    copied = few.filter(F.size("ids") > 1)
    own = copied.select(F.col("rep").alias("q"), F.col("rep").alias("n"), F.lit(1.0).alias("cos"))
    lists = met.unionByName(own).join(few.withColumnRenamed("rep", "n"), "n").select("q", "cos", F.explode("ids").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("c"), F.col("n").alias("n")))), 1, k + 1)
    lists = lists.groupBy("q").agg(best.alias("b"))
    each = members.filter(asks).join(lists, members["rep"] == lists["q"]).select("id", F.filter("b", lambda x: x["n"] != F.col("id")).alias("b"))
    return each.select("id", F.inline(F.slice("b", 1, k))).select("id", F.col("n").alias("neighbour"), F.least(F.lit(1.0), -F.col("c")).alias("cosine"))
