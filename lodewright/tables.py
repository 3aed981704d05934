"""The index tables as DataFrames, with the reading rules of the data model applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered twice (same id) become one row; rows without an id all stay."""
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.filter(F.col(key).isNull()))


def is_set(col) -> F.Column:
    """Null and the empty string both mean "no reference"."""
    return col.isNotNull() & (col != "")


def counting_files(files: DataFrame, *cols: str) -> DataFrame:
    """The file row that counts of each (snapshot_id, source_path): the greatest (created_at, id).

    Null created_at or id sort lowest. Keeps snapshot_id, source_path and cols. One shuffle;
    the choice is made by a map-side combined max, so a hot snapshot is no hot task.
    """
    best = F.max(F.struct("created_at", "id", F.struct(*cols).alias("row"))).alias("_best")
    return files.groupBy("snapshot_id", "source_path").agg(best).select("snapshot_id", "source_path", *[F.col(f"_best.row.{c}").alias(c) for c in cols])


FILE_COLUMNS = ["id", "collection", "repo", "repo_role", "branch", "repo_rel_path", "git_blob_sha", "file_sha256", "size_bytes", "language", "file_role", "content_class", "is_generated", "is_vendor", "is_test", "is_source", "is_build", "is_config", "is_doc", "is_untracked", "indexed_dirty", "skipped_reason"]


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return one_per_id(table(spark, d, "project_code_intel_snapshots"))


def files(spark: SparkSession, d: str, *cols: str, scope: DataFrame | None = None) -> DataFrame:
    """Counting rows, digests in lower case; only cols if given, only the snapshots of scope (snapshot_id) if given.

    What a choice among a path's rows does not need is neither read nor shuffled, so both are applied before it.
    """
    t = table(spark, d, "project_code_intel_files")
    if scope is not None:
        t = t.join(scope, "snapshot_id", "left_semi")
    out = counting_files(t, *(cols or FILE_COLUMNS))
    return out.withColumns({c: F.lower(c) for c in ("file_sha256", "git_blob_sha") if c in out.columns})


def records(spark: SparkSession, d: str, *cols: str, where=None) -> DataFrame:
    """One row per id, digests in lower case; only cols, names or expressions, if given, and only rows where a condition
    holds. Rows delivered twice are equal, so both are applied before they are made one, and no wide column is shuffled in vain."""
    t = table(spark, d, "project_code_intel_records")
    t = t if where is None else t.filter(where)
    out = one_per_id(t.selectExpr("id", *cols) if cols else t)
    return out.withColumn("file_sha256", F.lower("file_sha256")) if "file_sha256" in out.columns else out


def edges(spark: SparkSession, d: str, scope: DataFrame | None = None) -> DataFrame:
    """One row per id, empty keys as null; only the snapshots of scope (snapshot_id) if given."""
    t = table(spark, d, "project_code_intel_edges")
    t = one_per_id(t if scope is None else t.join(scope, "snapshot_id", "left_semi"))
    return t.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("source_record_id", "target_record_id", "source_symbol", "target_symbol", "target_path")})
