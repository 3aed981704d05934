"""Sources: working copies as file rows, SARIF documents, JSON manifests; sinks that replace whole tables."""

from __future__ import annotations

import os
import re
import subprocess
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.functions import classify as C

MOST_BYTES, MOST_SARIF_BYTES = 512 * 1024, 50 * 1024 * 1024
BINARY = "png jpg jpeg gif ico pdf zip gz bz2 xz tar jar class so a o exe dll bin woff woff2 ttf mp3 mp4".split()
PRUNED = (".git", "node_modules", "target", "dist", "build", ".venv", "__pycache__")


def tracked_files(root: str) -> list[tuple[str, str | None]]:
    """(path, blob) of a repository's index, and untracked ones with no blob; the listing is git's own."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout
    out = [(m[2], m[1]) for m in re.finditer(r"\d+ ([0-9a-f]+) \d\t([^\0]+)\0", run("ls-files", "-s", "-z"))]
    return out + [(p, None) for p in run("ls-files", "-o", "--exclude-standard", "-z").split("\0") if p]


def dirty_paths(porcelain: str) -> set[str]:
    """Paths of `status --porcelain` lines; both ends of a rename."""
    out: set[str] = set()
    for line in porcelain.splitlines():
        if len(line) > 3:
            out.update(p.strip('"') for p in line[3:].split(" -> "))
    return out


def scan_tree(spark: SparkSession, root: str, collection: str, repo: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """File rows of a folder that all executors see: path, size, digest, language, flags, class, role, reason for skipping, text.

    Files are read by the executors with the binary source, one row a file; too large ones are not kept in memory.
    """
    base = os.path.abspath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base).replace("\\-", "-") + "/", "")
    df = files.select(rel.alias("repo_rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    df = df.filter(~F.exists(F.split("repo_rel_path", "/"), lambda p: p.isin(*PRUNED)))
    reason = (
        F.when(F.lower(F.regexp_extract("repo_rel_path", r"\.([^./]+)$", 1)).isin(*BINARY), "binary_suffix")
        .when(F.col("size_bytes") > most_bytes, "file_too_large")
        .when(F.position(F.lit(b"\x00"), F.col("content")) > 0, "binary_nul")
    )
    text = F.when(reason.isNull(), F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n"))
    df = df.select("repo_rel_path", "size_bytes", "modified_at", F.sha2("content", 256).alias("file_sha256"), reason.alias("skipped_reason"), text.alias("text"))
    path = F.concat(F.lit(f"{repo}/"), F.col("repo_rel_path")) if repo != "." else F.col("repo_rel_path")
    df = df.withColumns({"collection": F.lit(collection), "repo": F.lit(repo), "source_path": path, "language": C.refined_language(F.col("repo_rel_path"), F.col("text"))})
    fl = C.flags(F.col("repo_rel_path"), F.col("language"), F.col("text"))
    df = df.withColumns(fl)
    klass = C.content_class(F.col("language"), {k: F.col(k) for k in fl})
    return df.withColumn("content_class", klass).withColumn("file_role", C.file_role(F.col("repo_rel_path"), F.col("content_class")))


def sarif_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, error) of the SARIF files under root; too large ones have an error and no text."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.sarif*").load(root)
    f = f.filter(F.col("path").rlike(r"\.sarif(?:\.json)?$") & ~F.col("path").rlike("/(?:" + "|".join(re.escape(p) for p in PRUNED) + ")/"))
    big = F.col("length") > MOST_SARIF_BYTES
    return f.select("path", F.when(~big, F.decode("content", "UTF-8")).alias("text"), F.when(big, "file too large").alias("error"))


def json_manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifests with a _corrupt_record column where they do not parse."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def replace_table(df: DataFrame, path: str, *partition: str) -> None:
    """The table at path replaced as a whole, or with partition columns only the partitions df has."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition).option("partitionOverwriteMode", "dynamic") if partition else w).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


TRIAGE = "id string, scope string, members array<string>, status string, reason string, updated_at string"


def write_triage(entries: DataFrame, path: str) -> None:
    """Triage entries (id, scope, members, status, reason, updated_at) as JSON lines at path, replaced as a whole: they are
    written beside it and moved into its place, so that a reader or a failure sees the old ones or the new ones."""
    spark = entries.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    entries.select(*[c.split()[0] for c in TRIAGE.split(", ")]).write.json(beside)
    fs, at = _fs(spark, path)
    fs.delete(at, True)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), at):
        raise OSError(f"could not move {beside} to {path}")


def read_triage(spark: SparkSession, path: str) -> DataFrame:
    """Triage entries at path; entries of the first version, which have no scope, have null there; none if nothing is there."""
    fs, at = _fs(spark, path)
    return spark.read.schema(TRIAGE).json(path) if fs.exists(at) else spark.createDataFrame([], TRIAGE)


@contextmanager
def only_writer(spark: SparkSession, path: str):
    """Holds the lock file at path, which its file system creates for one writer only; another gets an error at once."""
    fs, at = _fs(spark, path)
    try:
        fs.create(at, False).close()
    except Exception as ex:
        raise RuntimeError(f"{path} is held by another writer") from ex
    try:
        yield
    finally:
        fs.delete(at, False)


def has_rows(df: DataFrame) -> bool:
    """Whether there is a row; reads until the first."""
    return not df.limit(1).isEmpty()


def recordset(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of a column of JSON arrays of objects, beside the other columns; texts that are no array give none."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.inline(F.from_json(column, f"array<struct<{schema}>>")))
