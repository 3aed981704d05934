"""Near-duplicate texts by an inverted join over the coordinates of min-hash signatures.

1. Texts with the same set of runs of three tokens form one class; only its least id goes on.
2. Each representative has COORDS minima, and is posted under each (coordinate, value). Pairs with at
   least MATCHES equal coordinates are wanted, so in one global order of the postings, rarest first, the last
   MATCHES - 1 of a text can be skipped: two texts with enough matches still meet in the rest (prefix). What a template
   gives to very many texts is most frequent, so most of it is skipped.
3. Posting lists of up to HOT texts are merged by a join. Longer ones are cut into blocks of about BLOCK texts, and every
   two blocks of a list are compared on whole signatures by one task, which lets out pairs with enough matches only.
4. Lists longer than LONG would need too many blocks: their texts are posted again under pairs of this and another
   coordinate, where the same argument holds for the MATCHES - 1 further matches, and these lists are cut into blocks.
   Nothing is dropped; within one template of millions of texts comparisons, but not rows, are what remains quadratic.
5. Pairs that meet have their matches counted over whole signatures; those with enough are compared exactly.

A pair with likeness J matches in Binomial(COORDS, J) coordinates: with 80 and 24 the chance to miss is
1e-4 at J = 0.5, 2e-6 at 0.55 and 2e-8 at 0.6.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewright.llm.bodies import body
from lodewright.operators.components import connected_components
from lodewright.session import cut

COORDS, MATCHES, RUN, LEAST_TOKENS, LIKENESS = 80, 24, 3, 25, 0.5
HOT, BLOCK, LONG = 256, 1024, 16_384
_TOKEN = re.compile(r"[A-Za-z0-9_]+")
_MIX = np.random.default_rng(20240607).integers(1, 2**63, size=(2, COORDS), dtype=np.uint64) | np.uint64(1)


def runs(text: str) -> set[tuple[str, ...]]:
    """Distinct runs of three consecutive tokens; no run if there are fewer than LEAST_TOKENS tokens."""
    t = _TOKEN.findall(text)
    return set(zip(*(t[i:] for i in range(RUN)))) if len(t) >= LEAST_TOKENS else set()


def likeness(a: set, b: set) -> float:
    """Shared distinct runs over all distinct runs; 0 if one has none."""
    if not a or not b:
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _hashes(text: str) -> np.ndarray | None:
    t = _TOKEN.findall(text)
    if len(t) < LEAST_TOKENS:
        return None
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, t), np.uint64, len(t))
    x = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ ((h[1:-1] << np.uint64(21)) | (h[1:-1] >> np.uint64(43)))
    x = (x * np.uint64(0xC2B2AE3D27D4EB4F)) ^ ((h[2:] << np.uint64(42)) | (h[2:] >> np.uint64(22)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    return np.unique(x ^ (x >> np.uint64(32)))


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, c1, c2, sigs = [], [], [], []
        for i, text in zip(pdf["id"], pdf["text"]):
            t = body(text)
            x = None if t is None else _hashes(t)
            if x is None:
                continue
            least = np.full(COORDS, np.iinfo(np.uint32).max, np.uint32)
            for at in range(0, len(x), 4096):  # whole texts, in blocks of bounded memory
                block = x[at : at + 4096, None] * _MIX[0] + _MIX[1]
                least = np.minimum(least, (block >> np.uint64(32)).astype(np.uint32).min(axis=0))
            raw = x.tobytes()
            ids.append(i)
            c1.append(xxhash.xxh3_64_intdigest(raw) - 2**63)
            c2.append(xxhash.xxh64_intdigest(raw) - 2**63)
            sigs.append(least.view(np.int32))
        yield pd.DataFrame({"id": ids, "c1": c1, "c2": c2, "sig": sigs})


def classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) and representatives (rep, sig) of texts (id, text) with enough tokens; text is a display_content."""
    signed = cut(texts.filter("id IS NOT NULL").select("id", "text").mapInPandas(_signatures, "id long, c1 long, c2 long, sig array<int>").dropDuplicates(["id"]))
    reps = signed.groupBy("c1", "c2").agg(F.min_by("sig", "id").alias("sig"), F.min("id").alias("rep"))
    return signed.select("id", "c1", "c2").join(reps.select("c1", "c2", "rep"), ["c1", "c2"]).select("id", "rep"), reps.select("rep", "sig")


def _meet(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b), a < b, that share a key; one row per shared key."""
    left, right = postings.withColumnRenamed("rep", "a"), postings.withColumnRenamed("rep", "b")
    return left.join(right, keys).filter("a < b").select("a", "b")


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of the rows of two blocks, or within one, with at least MATCHES equal coordinates."""
    pdf = pdf.sort_values("rep")
    rep, block, sig = pdf["rep"].to_numpy(), pdf["block"].to_numpy(), np.stack(pdf["sig"].to_list())
    lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    out = []
    for i in left:
        j = right[(sig[right] == sig[i]).sum(axis=1) >= MATCHES]
        j = j[j > i] if lo == hi else j
        out.append(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], axis=1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _meet_in_blocks(postings: DataFrame, keys: list[str], reps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, with enough matches among the texts of each key; postings has the list's length n as well."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    at = postings.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("rep", *keys, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return at.join(reps, "rep").groupBy(*keys, "lo", "hi").applyInPandas(_compare, "a long, b long")


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """Distinct (a, b) that meet in a prefix posting, all pairs with at least MATCHES equal coordinates among them."""
    at = F.posexplode("sig").alias("coord", "value")
    post = reps.select("rep", at).select("rep", F.xxhash64("coord", "value").alias("h"))
    size = post.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    post = post.join(size, "h")
    # at most COORDS postings per text, so its row is small; rarest first, ties by key: one order for all texts
    lists = post.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("p")).filter(F.size("p") >= MATCHES)
    lists = cut(lists.withColumn("prefix", F.slice("p", F.lit(1), F.size("p") - (MATCHES - 1))))
    first = lists.select("rep", F.explode("prefix").alias("k")).select("rep", "k.h", "k.n")
    met = _meet(first.filter(F.col("n") <= HOT).select("rep", "h"), ["h"])
    met = met.unionByName(_meet_in_blocks(first.filter(F.col("n").between(HOT + 1, LONG)), ["h"], reps))
    # what is left after one shared coordinate: at least MATCHES - 1 others, so MATCHES - 2 may be skipped
    further = F.transform(F.filter("prefix", lambda k: k["n"] > LONG), lambda k: F.struct(k["h"].alias("h"), F.filter("p", lambda o: o["h"] != k["h"]).alias("o")))
    again = lists.select("rep", F.explode(further).alias("f")).select("rep", F.col("f.h").alias("h"), F.explode(F.expr(f"slice(f.o, 1, greatest(0, size(f.o) - {MATCHES - 2}))")).alias("o"))
    again = again.select("rep", F.least("h", "o.h").alias("h"), F.greatest("h", "o.h").alias("g")).distinct()
    again = again.join(again.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["h", "g"])
    return met.unionByName(_meet_in_blocks(again, ["h", "g"], reps)).distinct()


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[str, set] = {}

    def of(t: str) -> set:
        if (got := memo.get(t)) is None:
            if len(memo) > 2000:
                memo.clear()
            got = memo[t] = runs(body(t) or "")
        return got

    return pd.Series([likeness(of(x), of(y)) for x, y in zip(a, b)], dtype="float64")


def similar_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep), and links (a, b, likeness) between representatives of different classes with likeness >= LIKENESS."""
    members, reps = classes(texts)
    reps = cut(reps)
    met = candidate_pairs(reps)
    sa, sb = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    met = cut(met.join(sa, "a").join(sb, "b").filter(same >= MATCHES).select("a", "b"))
    needed = met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct()
    text = cut(texts.select("id", "text").join(needed, "id", "left_semi").dropDuplicates(["id"]))
    ta, tb = text.select(F.col("id").alias("a"), F.col("text").alias("ta")), text.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    links = met.join(ta, "a").join(tb, "b").select("a", "b", _likeness("ta", "tb").alias("likeness")).filter(F.col("likeness") >= LIKENESS)
    return members, cut(links)


def similar_pairs(texts: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of texts (id, text) with likeness of at least 0.5, equal ones too.

    Texts that are null, without a fence or with fewer than 25 tokens are in no pair. Rows with an id seen
    before are one row, rows without an id are left out. Empty tables give no rows.
    """
    members, links = similar_classes(texts)
    m1, m2 = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    between = links.join(m1, "a").join(m2, "b").select("x", "y")
    within = m1.join(m2, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(texts: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per text with enough tokens.

    class_id is the least id with the same runs, group_id the least id reached over links, n_links the number
    of other classes its class is linked with. Work and rows are linear in copies.
    """
    members, links = similar_classes(texts)
    comp = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    n = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    comp = comp.select(F.col("node").alias("rep"), "component")
    out = members.join(comp.join(n, "rep"), "rep", "left")
    return out.select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
