"""Changes between consecutive full snapshots, found top-down over trees of digests.

The paths of a snapshot hash into ``FANOUT ** LEVELS`` leaf buckets. A leaf's digest combines the
digests of its rows, a node's digest those of its children. Two consecutive snapshots are compared
from the root down: only children of differing nodes are looked at, and only rows of differing
leaves are compared with each other. Empty buckets have no row, so small snapshots have small trees.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewright.tables import counting_files, one_per_id

FANOUT_BITS = 4
LEVELS = 3


def consecutive(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, prev_id) per (collection, repo, branch), in order of (created_at, id); the first has none."""
    s = one_per_id(snapshots.select("id", "collection", "repo", "branch", "created_at")).filter(F.col("id").isNotNull())
    w = Window.partitionBy("collection", "repo", "branch").orderBy(F.col("created_at").asc_nulls_first(), "id")
    return s.select(F.col("id").alias("snapshot_id"), F.lag("id").over(w).alias("prev_id")).filter("prev_id IS NOT NULL")


def _digest(*cols) -> list:
    """Two independent 64-bit sums without order, and a count."""
    h = F.xxhash64(*cols)
    return [F.bit_xor(h).alias("d1"), F.bit_xor(F.xxhash64(h, F.lit("second"), *cols)).alias("d2"), F.count(F.lit(1)).alias("n")]


def digest_levels(rows: DataFrame) -> list[DataFrame]:
    """Digests (snapshot_id, node, d1, d2, n) from the leaves up to the root; rows has leaf and its content columns."""
    out = [rows.groupBy("snapshot_id", F.col("leaf").alias("node")).agg(*_digest("source_path", "sha", "blob", "size_bytes"))]
    for _ in range(LEVELS):
        below = out[-1]
        out.append(below.groupBy("snapshot_id", F.shiftright("node", FANOUT_BITS).alias("node")).agg(*_digest("node", "d1", "d2", "n")))
    return out


def _both_sides(df: DataFrame, pairs: DataFrame, cols: list[str]) -> DataFrame:
    """df's rows as later (side 1) and as earlier (side 0) snapshot of the pairs they belong to, in one join.

    A snapshot is in two pairs at most, so this copies a row twice at most.
    """
    roles = pairs.select(F.col("snapshot_id").alias("pair"), F.inline(F.array(F.struct(F.col("snapshot_id").alias("snapshot_id"), F.lit(1).alias("side")), F.struct(F.col("prev_id").alias("snapshot_id"), F.lit(0).alias("side")))))
    return df.join(roles, "snapshot_id").select("pair", "side", *cols)


def differing_leaves(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, leaf) whose digests differ, found from the root down."""
    levels = digest_levels(rows)
    alive = None
    for depth, level in enumerate(reversed(levels)):
        sides = _both_sides(level, pairs, ["node", "d1", "d2", "n"])
        if depth:
            parents = alive.withColumnRenamed("node", "parent")
            sides = sides.withColumn("parent", F.shiftright("node", FANOUT_BITS)).join(parents, ["pair", "parent"], "left_semi")
        at = lambda s: F.max(F.when(F.col("side") == s, F.struct("d1", "d2", "n")))
        alive = sides.groupBy("pair", "node").agg(at(0).alias("a"), at(1).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select("pair", "node")
    return alive.withColumnRenamed("node", "leaf")


def snapshot_changes(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(snapshot_id, source_path, change): change is added, removed or changed against the snapshot before.

    A path changed if file_sha256 differs without regard to case; if one of the two is null, if git_blob_sha
    differs; if one of these is null, if size_bytes differs (a null size differs from any number).
    The first snapshot of a branch gives no rows; a null branch is a branch; a snapshot without files has
    lost all paths. Empty tables give no rows. Extra columns are ignored. Rows with a null source_path are
    one path of their own.
    """
    rows = counting_files(files, "file_sha256", "git_blob_sha", "size_bytes").select(
        "snapshot_id", "source_path", F.lower("file_sha256").alias("sha"), F.lower("git_blob_sha").alias("blob"), "size_bytes"
    )
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("source_path"), F.lit(1 << (FANOUT_BITS * LEVELS))).cast("int"))
    pairs = consecutive(snapshots)
    leaves = differing_leaves(rows, pairs)
    cols = ["source_path", "leaf", "sha", "blob", "size_bytes"]
    sides = _both_sides(rows, pairs, cols).join(leaves, ["pair", "leaf"], "left_semi")
    at = lambda s: F.max(F.when(F.col("side") == s, F.struct("sha", "blob", "size_bytes")))
    both = sides.groupBy("pair", "source_path").agg(at(0).alias("a"), at(1).alias("b"))
    rule = [("sha",), ("blob",)]
    differs = ~F.col("a.size_bytes").eqNullSafe(F.col("b.size_bytes"))
    differs = reduce(lambda rest, k: F.when(F.col(f"a.{k[0]}").isNotNull() & F.col(f"b.{k[0]}").isNotNull(), F.col(f"a.{k[0]}") != F.col(f"b.{k[0]}")).otherwise(rest), reversed(rule), differs)
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(differs, "changed")
    return both.select(F.col("pair").alias("snapshot_id"), "source_path", change.alias("change")).filter("change IS NOT NULL")
