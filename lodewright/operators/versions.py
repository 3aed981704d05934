"""Which snapshots and rows count: newest per group, retention, changes, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(order: tuple = ("created_at", "id")) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order]


def newest_per(df: DataFrame, *keys: str, order: tuple = ("created_at", "id")) -> DataFrame:
    """The row of each group that is greatest by order; null keys are a group. A map-side combined maximum, no window."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_b")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best).select("_b.*")


def latest_scope(snapshots: DataFrame, by_branch: bool = False) -> DataFrame:
    """(snapshot_id): the newest snapshot of each (collection, repo), or of each branch of it, a null branch being one."""
    keys = ["collection", "repo", *(["branch"] if by_branch else [])]
    return newest_per(snapshots.select("id", "created_at", *keys), *keys).select(F.col("id").alias("snapshot_id"))


def branch_preferred(snapshots: DataFrame, branch: str) -> DataFrame:
    """Per (collection, repo) the snapshot of branch with the greatest id, else the greatest id of any branch."""
    on = (F.coalesce(F.col("branch"), F.lit("")) == branch).cast("int")
    return newest_per(snapshots.withColumn("_on", on), "collection", "repo", order=("_on", "id")).drop("_on")


def prune(snapshots: DataFrame, keep: int) -> DataFrame:
    """Snapshots to delete: of those not newest in their branch, all but the newest keep of the repo."""
    repo = ["collection", "repo"]
    by_branch = Window.partitionBy(*repo, F.coalesce("branch", F.lit(""))).orderBy(*_newest())
    rest = snapshots.withColumn("_r", F.row_number().over(by_branch)).filter("_r > 1")
    return rest.withColumn("_k", F.row_number().over(Window.partitionBy(*repo).orderBy(*_newest()))).filter(F.col("_k") > keep).drop("_r", "_k")


def prune_dead_branches(snapshots: DataFrame, live: list[str]) -> DataFrame:
    """Snapshots of named branches that are not live; never the repo's newest, never those without a branch."""
    newest = latest_scope(snapshots).withColumnRenamed("snapshot_id", "id")
    return snapshots.filter(F.col("branch").isNotNull() & ~F.col("branch").isin(*live)).join(newest, "id", "left_anti")


def changed_paths(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Paths of after as new, changed or unchanged against before by signature, and the deleted ones."""
    b, a = before.select(*keys, F.col("signature").alias("old")), after.select(*keys, F.col("signature").alias("new"))
    both = b.join(a, keys, "full")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return both.select(*keys, state.alias("state"))


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str, refresh: list[str], keep_if_null: tuple = ()) -> DataFrame:
    """Rows of both by key. Of new rows with one key the last in order counts; on conflict refresh columns are taken
    from it, keep_if_null ones only where it has a value, all others stay. Nulls in keys are equal."""
    cols = old.columns
    one = new.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*cols), order).alias("n")).select("n")
    on = reduce(lambda x, y: x & y, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    both = old.select(F.struct(*cols).alias("o")).join(one, on, "full")

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        kept = F.coalesce(n, o) if c in keep_if_null else n if c in refresh else o
        return F.when(F.col("n").isNull(), o).when(F.col("o").isNull(), n).otherwise(kept).alias(c)

    return both.select(*[pick(c) for c in cols])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old and the rows of new whose key it lacks, the first in order of each; null parts of keys equal the empty string."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    mark = lambda df: df.withColumn("_k", F.struct(*[x.alias(f"k{i}") for i, x in enumerate(k)]))
    fresh = mark(new).groupBy("_k").agg(F.min_by(F.struct(*new.columns), order).alias("n"))
    fresh = fresh.join(mark(old).select("_k"), "_k", "left_anti").select("n.*")
    return old.unionByName(fresh)
