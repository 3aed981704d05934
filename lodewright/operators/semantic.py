"""Search by vector with heuristic re-ranking, and similarity of groups."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.operators.search import match_score, query_terms

# fixed values: vocabularies and weights of the re-ranking
EXECUTABLE = frozenset("add added adds build builds built config configuration configure configured configuring call called caller calls create creates creating emit emits emitted emitting execute executed executes flow generate generated generates generating generation handler handlers implement implementation implemented implements invoke invoked invokes logic render rendered rendering renders run runs translate translated translating translates workflow".split())
NON_SOURCE = frozenset("doc docs documentation example examples fixture fixtures guide guides mock mocks readme spec specs test testing tests unit".split())
STRUCTURAL = frozenset("api apis class classes crd crds definition definitions field fields interface interfaces model models schema schemas spec specs struct structs type types yaml".split())
VALIDATION = frozenset("validate validated validates validating validation validator validators".split())
SUPPLEMENTAL = ("generate", "render", "build", "add", "config", "configuration", "template")
WEIGHTS = {"executable": 0.12, "structural": 0.18, "validation": 0.16, "source_role": 0.16, "non_source": 0.18, "generated": 0.24, "tiny": 0.35, "score": 0.01}
LOW_MATCH = 0.40
QUERIES, VECTORS = 4096, 8192


def dot(a, b) -> Column:
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    return F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Null if either vector is null, all zero or of another length."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def gates(query: str, filters: dict) -> dict[str, float]:
    """Which weights count, from the query's words and the filters given."""
    words = {w.lower() for w in query_terms(query)}
    role, klass = filters.get("file_role"), filters.get("content_class")
    placed = any(filters.get(k) for k in ("source_path", "source_path_prefix", "file_role", "content_class"))
    other = bool(words & NON_SOURCE)
    intent = not role and klass in (None, "source") and not words & (NON_SOURCE | STRUCTURAL | VALIDATION) and bool(words & EXECUTABLE)
    w = WEIGHTS
    return {
        "a": w["executable"] if intent else 0.0,
        "b": w["structural"] if intent and not placed else 0.0,
        "c": w["validation"] if intent and not placed else 0.0,
        "s": 0.0 if role or klass not in (None, "source") or other else w["source_role"],
        "n": 0.0 if placed or other else w["non_source"],
        "g": 0.0 if placed or other else w["generated"],
        "intent": float(intent),
    }


def boost_terms(query: str, intent: bool) -> list[str]:
    t = [x for x in query_terms(query) if len(x) >= 3][:8]
    return list(dict.fromkeys([*t, *(SUPPLEMENTAL if intent else ())]))


def order_key(distance, query: str, filters: dict) -> Column:
    """The blended rank of a record at a distance; smaller is better."""
    g = gates(query, filters)
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("validat"))
    lines = F.col("line_end") - F.col("line_start") + 1
    tiny = (F.col("record_type") == "code_chunk") & F.col("symbol").isNull() & (lines <= 3) & (F.length("display_content") < 120)
    terms = boost_terms(query, bool(g["intent"]))
    k = distance + F.when(tiny, WEIGHTS["tiny"]).otherwise(0.0) - WEIGHTS["score"] * F.least(match_score(terms, False), F.lit(80))
    k -= F.when(F.col("symbol_kind").isin("function", "method", "shell_function"), g["a"]).otherwise(0.0)
    k += F.when(F.col("symbol_kind").isin("struct", "interface", "type"), g["b"]).otherwise(0.0)
    k += F.when(reduce(lambda x, y: x | y, [has(c) for c in ("symbol", "title", "source_path", "record_id")]), g["c"]).otherwise(0.0)
    k -= F.when(F.col("file_role") == "source", g["s"]).otherwise(0.0)
    k += F.when(F.col("content_class") != "source", g["n"]).otherwise(0.0)
    return k + F.when(F.coalesce(F.col("is_generated"), F.lit(False)), g["g"]).otherwise(0.0)


def semantic_search(records: DataFrame, vector: list[float], query: str, filters: dict, limit: int, diversify: bool = True) -> DataFrame:
    """The best records for a query and its vector, with similarity and place.

    With diversify, of the min(max(4k, k + 20), 200) best by blended rank the first of each parent come before their siblings.
    """
    v = F.array(*[F.lit(float(x)) for x in vector])
    df = records.withColumn("distance", 1 - cosine(F.col("embedding"), v)).filter("distance IS NOT NULL")
    df = df.withColumn("key", F.round(order_key(F.col("distance"), query, filters), 9))
    order = [F.asc("key"), F.asc("distance"), F.desc("id")]
    fetched = df.orderBy(*order).limit(min(max(4 * limit, limit + 20), 200) if diversify else limit)
    if diversify:
        nth = F.row_number().over(Window.partitionBy(F.coalesce("parent_record_id", "record_id")).orderBy(*order))
        fetched = fetched.withColumn("_late", (nth > 1).cast("int")).orderBy("_late", *order).limit(limit).drop("_late")
    return fetched.withColumn("similarity", 1 - F.col("distance"))


def pairwise_by_group(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, n_pairs, mean_cosine) of all pairs within groups, without a pair being made: the mean over pairs of
    unit vectors follows from the length of their sum, (|sum|^2 - n) / (n (n - 1))."""
    unit = df.filter(norm(F.col(vector)) > 0).select(group, F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm(F.col(vector)))).alias("u"))
    flat = unit.select(group, F.posexplode("u").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    g = flat.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n")).filter("n > 1")
    return g.select(group, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"), ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """cosine() of rows, summed element by element in its order, so that copies of a vector have equal values."""
    dot, qq, vv = (np.zeros(len(q)) for _ in range(3))
    for i in range(q.shape[1]):
        dot += q[:, i] * v[:, i]
        qq += q[:, i] * q[:, i]
        vv += v[:, i] * v[:, i]
    n = np.sqrt(qq) * np.sqrt(vv)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, np.nan, dot / n)


def _nearest_of(k: int, most_distance: float | None):
    """The k nearest of a block of vectors for each of a block of queries. A product of matrices leaves out what is
    farther than the k-th by more than its rounding; the rest is summed as in cosine()."""

    def by_length(ids: pd.Series, vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        n, ids = vectors.str.len().to_numpy(), ids.to_numpy()
        return {m: (ids[n == m], np.stack([np.asarray(x, np.float64) for x in vectors[n == m]])) for m in np.unique(n)}

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            queries, vectors = by_length(left["query_id"], left["qvec"]), by_length(right["id"], right["vec"])
            for m in queries.keys() & vectors.keys():
                (qid, q), (vid, v) = queries[m], vectors[m]
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                for lo in range(0, len(q), 256):
                    part, own = q[lo : lo + 256], qid[lo : lo + 256]
                    far = 1 - (part / np.linalg.norm(part, axis=1, keepdims=True)) @ unit.T
                    far[own[:, None] == vid] = np.inf
                    bound = np.partition(far, k - 1, axis=1)[:, k - 1] if k < len(v) else np.full(len(part), np.inf)
                    near = far <= (bound if most_distance is None else np.minimum(bound, most_distance))[:, None] + 1e-9
                    i, j = np.nonzero(near & (far < np.inf))
                    distance = 1 - _cosines(part[i], v[j])
                    kept = distance <= (np.inf if most_distance is None else most_distance)
                    i, j, distance = i[kept], j[kept], distance[kept]
                    order = np.lexsort((vid[j], distance, i))
                    i, j, distance = i[order], j[order], distance[order]
                    best = np.arange(len(i)) - np.searchsorted(i, i) < k
                    found.append(pd.DataFrame({"query_id": own[i[best]], "id": vid[j[best]], "distance": distance[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "distance": pd.Series([], dtype="float64")})

    return meet


def nearest_to(queries: DataFrame, vectors: DataFrame, k: int, most_distance: float | None = None) -> DataFrame:
    """(query_id, id, distance, place): the k nearest vectors of each query vector, exact, for any number of queries.

    queries (query_id, qvec) and vectors (id, vec) meet block by block, at most about QUERIES and VECTORS rows of them
    at once. Vectors that have null, NaN or infinite elements or are all zero are neither query nor neighbour.
    """

    def blocks(df: DataFrame, key: str, vector: str) -> DataFrame:
        fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        return df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).filter(F.col(key).isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0))

    q, v = blocks(queries, "query_id", "qvec"), blocks(vectors, "id", "vec")
    n_q, n_v = max(1, -(-q.count() // QUERIES)), max(1, -(-v.count() // VECTORS))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", part("query_id", n_q)).withColumn("vb", each(n_v))
    v = v.withColumn("vb", part("id", n_v)).withColumn("qb", each(n_q))
    near = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(_nearest_of(k, most_distance), "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
