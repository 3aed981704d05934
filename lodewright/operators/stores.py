"""Writes to the index as merges: every function takes the stored rows and the new ones and gives the rows to store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.operators.versions import insert_new

MOST_ERROR, MOST_REASON = 2000, 500  # fixed values
SNAPSHOT_KEY = ("collection", "repo", "commit_sha", "tree_sha")
FAILURE_KEY = ["snapshot_id", "source_path", "parser", "error"]


def merged_json(*objects) -> Column:
    """JSON objects as one: of keys that several have, the last one's value. Texts that are no object count as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    typed = [F.coalesce(F.try_variant_get(F.try_parse_json(o), "$", "map<string,variant>"), empty) for o in objects]
    return F.to_json(reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b), typed))


def upsert_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots of both by (collection, repo, commit_sha, tree_sha): a known one takes branch, role, dirty and metadata of the
    newest new row and keeps its id, time and embedding contract."""
    one = new.groupBy(*SNAPSHOT_KEY).agg(F.max_by(F.struct(*new.columns), "id").alias("n"))
    both = old.select(F.struct(*old.columns).alias("o"), *SNAPSHOT_KEY).join(one, list(SNAPSHOT_KEY), "full")
    contract = F.get_json_object("o.metadata", "$.embedding_contract")
    kept = F.when(contract.isNotNull(), F.concat(F.lit('{"embedding_contract":'), contract, F.lit("}")))
    fresh = {"branch": F.col("n.branch"), "repo_role": F.col("n.repo_role"), "dirty": F.col("n.dirty"), "metadata": F.when(kept.isNull(), F.col("n.metadata")).otherwise(merged_json(F.col("n.metadata"), kept))}
    known, given = F.col("o").isNotNull(), F.col("n").isNotNull()
    return both.select(*[F.when(~given, F.col(f"o.{c}")).when(~known, F.col(f"n.{c}")).otherwise(fresh.get(c, F.col(f"o.{c}"))).alias(c) for c in old.columns])


def insert_failures(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parser failures (snapshot_id, source_path, language, parser, error): errors cut at MOST_ERROR characters, known ones ignored."""
    cut = lambda df: df.withColumn("error", F.left(F.coalesce("error", F.lit("")), F.lit(MOST_ERROR))).withColumn("parser", F.coalesce("parser", F.lit("unknown")))
    return insert_new(cut(old), cut(new), FAILURE_KEY, "source_path")


def update_embeddings(records: DataFrame, embedded: DataFrame, skipped: DataFrame) -> DataFrame:
    """records with the vectors of embedded (id, embedding, model) and the marks of skipped (id, reason, max_chars) in their metadata."""
    e = embedded.dropDuplicates(["id"]).select("id", F.col("embedding").alias("_v"), F.to_json(F.struct(F.col("model").alias("embedding_model"), F.size("embedding").alias("embedding_dimension"))).alias("_m"))
    s = skipped.dropDuplicates(["id"]).select("id", F.to_json(F.struct(F.lit(True).alias("embedding_skipped"), F.left("reason", F.lit(MOST_REASON)).alias("embedding_skip_reason"), F.col("max_chars").alias("embedding_skip_max_chars"))).alias("_s"))
    out = records.join(e, "id", "left").join(s, "id", "left")
    touched = F.coalesce(F.col("_m"), F.col("_s")).isNotNull()
    meta = F.when(touched, merged_json(F.col("metadata"), F.col("_m"), F.col("_s"))).otherwise(F.col("metadata"))
    return out.withColumn("metadata", meta).withColumn("embedding", F.coalesce("_v", "embedding")).drop("_v", "_m", "_s")


def stamp_types(snapshots: DataFrame, ids: DataFrame, types: list[str]) -> DataFrame:
    """snapshots with embed_record_types in the metadata of those in ids (id)."""
    stamp = F.lit('{"embed_record_types":[' + ",".join(f'"{t}"' for t in sorted(types)) + "]}")
    marked = snapshots.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return marked.withColumn("metadata", F.when(F.col("_hit"), merged_json(F.col("metadata"), stamp)).otherwise(F.col("metadata"))).drop("_hit")


def freeze_baseline(baseline: DataFrame, findings: DataFrame, keys: tuple = ("collection", "repo", "branch")) -> DataFrame:
    """The baseline with the sets of the (collection, repo, branch) that findings has replaced as a whole; a null branch is one."""
    scope = findings.select(*keys).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    return baseline.alias("b").join(F.broadcast(scope).alias("s"), same, "left_anti").unionByName(findings.select(*baseline.columns))


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Rows of parents that fresh does not have, and fresh: what a re-read parent no longer has goes."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh.select(*children.columns))


def without_repo(collection: str, repo: str, snapshots: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables without a repo: its snapshots, all that hang on them by snapshot_id, and its own rows."""
    gone = (F.col("collection") == collection) & (F.col("repo") == repo)
    ids = snapshots.filter(gone).select(F.col("id").alias("snapshot_id"))
    out = {"snapshots": snapshots.filter(~gone)}
    for name, t in tables.items():
        out[name] = t.join(F.broadcast(ids), "snapshot_id", "left_anti") if "snapshot_id" in t.columns else t.filter(~gone)
    return out


def reusable_files(previous: DataFrame, current: DataFrame, dirty: DataFrame) -> DataFrame:
    """current (source_path, git_blob_sha, ...) with reused: the path is listed before with the same blob and is not dirty (source_path)."""
    p = previous.filter("git_blob_sha IS NOT NULL").select("source_path", "git_blob_sha", F.lit(True).alias("_same")).distinct()
    out = current.join(p, ["source_path", "git_blob_sha"], "left").join(dirty.select("source_path", F.lit(True).alias("_dirty")).distinct(), "source_path", "left")
    return out.withColumn("reused", F.coalesce("_same", F.lit(False)) & F.col("_dirty").isNull()).drop("_same", "_dirty")


def tree_id(tree_sha, fingerprint) -> Column:
    """A working tree's id: that of the commit's tree, and of what is dirty in it."""
    return F.when(F.coalesce(fingerprint, F.lit("")) != "", F.concat(tree_sha, F.lit(":dirty:"), F.left(fingerprint, F.lit(16)))).otherwise(tree_sha)
