"""Freshness of snapshots and findings, edits, likeness of bodies, embedding with retries, rule packs."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUNCATED, LEAST_CHARS = "\n[truncated]", 800


def staleness(snapshots: DataFrame, heads: DataFrame, now) -> DataFrame:
    """snapshots with stale reasons against heads (collection, repo, branch, commit_sha, n_behind): another commit, another
    branch, behind its upstream, dirty; and the age in seconds. Repos without a head have no reasons."""
    h = heads.select("collection", "repo", F.col("branch").alias("head_branch"), F.col("commit_sha").alias("head"), "n_behind")
    df = snapshots.join(h, ["collection", "repo"], "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("head") != F.col("commit_sha"), "commit"), F.when(~F.col("head_branch").eqNullSafe(F.col("branch")) & F.col("head").isNotNull(), "branch"),
        F.when(F.col("n_behind") > 0, "upstream"), F.when(F.col("dirty"), "dirty"),
    ))
    return df.withColumn("stale", reasons).withColumn("age_s", (F.unix_micros(now) - F.unix_micros("created_at")) / 1e6).drop("head", "head_branch", "n_behind")


def sarif_freshness(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Warnings of runs (path, repo, revision, modified_at): older than the commit, or made for another revision.

    Revisions agree if one begins with the other.
    """
    s = snapshots.select("repo", "commit_sha", F.col("created_at").alias("committed_at"))
    df = runs.join(s, "repo")
    other = F.col("revision").isNotNull() & ~(F.startswith("commit_sha", F.col("revision")) | F.startswith("revision", F.col("commit_sha")))
    warn = F.array_compact(F.array(F.when(F.col("modified_at") < F.col("committed_at"), "older_than_commit"), F.when(other, "other_revision")))
    return df.select("path", "repo", F.explode(warn).alias("warning"))


_DEFINES = r"(?m)^\s*(?:pub\s+|export\s+|async\s+|static\s+)*(?:def|class|func|function|fn|struct|interface|type|enum|trait)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"


def defined_names(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_DEFINES), 1))


def edited_definitions(old, new) -> tuple[Column, Column]:
    """Names an edit adds and removes, in order of appearance."""
    return F.array_except(defined_names(new), defined_names(old)), F.array_except(defined_names(old), defined_names(new))


def definition_slice(text: str, name: str, most: int = 60) -> str | None:
    """The lines of a definition: from its head to before the next line that is indented no deeper, be it a closing brace."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if (m := re.search(_DEFINES, line)) and m[1] == name:
            deep = len(line) - len(line.lstrip())
            out = [line]
            for x in lines[i + 1 : i + most]:
                if x.strip() and len(x) - len(x.lstrip()) <= deep:
                    break
                out.append(x)
            return "\n".join(out).rstrip()
    return None


_SIGNATURE = re.compile(r"\A\s*(?:async\s+)?def\s[^\n]*?(?:\([\s\S]*?\))?[^\n]*?:[^\n]*(?:\n|\Z)")
_DOCSTRING = re.compile(r"\A\s*[a-zA-Z]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))[^\n]*\n?")


def plain_body(text: str) -> str:
    """A body without its signature, which may take several lines, a docstring that follows it, blank lines and white space at
    the ends of lines; a text without a signature loses nothing of these but the last two."""
    rest = _SIGNATURE.sub("", text, count=1)
    if rest != text:
        rest = _DOCSTRING.sub("", rest, count=1)
    return "\n".join(x.rstrip() for x in rest.split("\n") if x.strip())


@F.pandas_udf(T.DoubleType())
def body_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching characters of two bodies, as the longest-match heuristic gives it."""
    return pd.Series([difflib.SequenceMatcher(None, plain_body(x or ""), plain_body(y or "")).ratio() for x, y in zip(a, b)])


def group_likeness(members: DataFrame) -> DataFrame:
    """(cluster, avg_text, max_text) over pairs of members (cluster, key, body).

    The likeness has no index and its average is over all pairs, so every two distinct bodies of a cluster are
    compared; copies count as what they are without being compared. Clusters are of functions of one shape in one snapshot.
    """
    body = members.groupBy("cluster", "body").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    a, b = body.select("cluster", F.col("key").alias("ka"), F.col("n").alias("na"), F.col("body").alias("ba")), body.select("cluster", F.col("key").alias("kb"), F.col("n").alias("nb"), F.col("body").alias("bb"))
    two = a.join(b, "cluster").filter("ka < kb").withColumn("r", body_likeness("ba", "bb")).select("cluster", "r", (F.col("na") * F.col("nb")).alias("w"))
    same = body.filter("n > 1").select("cluster", F.lit(1.0).alias("r"), (F.col("n") * (F.col("n") - 1) / 2).alias("w"))
    every = two.select("cluster", "r", F.col("w").cast("double").alias("w")).unionByName(same)
    return every.groupBy("cluster").agg((F.sum(F.col("r") * F.col("w")) / F.sum("w")).alias("avg_text"), F.max("r").alias("max_text"))


def embedding_input(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 20].rstrip() + TRUNCATED


def embed(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 16, most_chars: int = 3000) -> DataFrame:
    """(id, embedding, skipped) of df (id, embedding_text): embedder is called in the workers with batches of texts.

    A batch it refuses is halved; a single text is halved down to 800 characters, then skipped. Null texts are skipped.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run(items: list[tuple[int, str]]) -> list[tuple]:
            try:
                return [(i, list(map(float, v)), False) for (i, _), v in zip(items, embedder([t for _, t in items]), strict=True)]
            except Exception:  # whatever the endpoint raises
                if len(items) > 1:
                    half = len(items) // 2
                    return run(items[:half]) + run(items[half:])
                i, t = items[0]
                return run([(i, t[: max(LEAST_CHARS, len(t) // 2)])]) if len(t) > LEAST_CHARS else [(i, None, True)]

        for pdf in batches:
            rows: list[tuple] = [(i, None, True) for i, t in zip(pdf["id"], pdf["embedding_text"]) if not t]
            todo = [(i, embedding_input(t, most_chars)) for i, t in zip(pdf["id"], pdf["embedding_text"]) if t]
            for k in range(0, len(todo), batch):
                rows += run(todo[k : k + batch])
            yield pd.DataFrame(rows, columns=["id", "embedding", "skipped"])

    return df.select("id", "embedding_text").mapInPandas(work, "id long, embedding array<float>, skipped boolean")


def rulepack_issues(packs: DataFrame) -> DataFrame:
    """(pack, issue, detail) of packs (pack, name, tier, rules array<struct<id, pattern>>): no name, unknown tier, no rules,
    rules without id or pattern, an id twice in a pack, an id in several packs."""
    of = lambda issue, df, detail: df.select("pack", F.lit(issue).alias("issue"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    rules = packs.select("pack", F.explode("rules").alias("r")).select("pack", F.col("r.id").alias("id"), F.col("r.pattern").alias("pattern"))
    twice = rules.filter("id <> ''").groupBy("pack", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = rules.filter("id <> ''").select("pack", "id").distinct()
    many = shared.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    parts = [
        of("no_name", packs.filter("coalesce(name, '') = ''"), none),
        of("unknown_tier", packs.filter("tier IS NULL OR tier NOT IN ('gate', 'advisory', 'experimental')"), F.col("tier")),
        of("no_rules", packs.filter("rules IS NULL OR size(rules) = 0"), none),
        of("incomplete_rule", rules.filter("coalesce(id, '') = '' OR coalesce(pattern, '') = ''"), F.col("id")),
        of("duplicate_id", twice, F.col("id")),
        of("shared_id", shared.join(many, "id"), F.col("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
