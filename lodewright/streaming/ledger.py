"""Streams: the run ledger's latest states, event counts in windows, changed files parsed as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewright.operators.runs import latest_state
from lodewright.session import shared_dir

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Events of the files at path, a folder or, written as a pattern, one file."""
    pattern = path[:-1] + f"[{path[-1]}]"  # a plain path would have to be a folder
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share, for sinks and stream checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(out: DataFrame, mode: str, name: str) -> DataFrame:
    """All that is there now, through the stream, into a table; a batch replayed after a failure replaces itself."""
    spark = out.sparkSession
    where = fresh(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        target = where + "/all" if mode == "complete" else f"{where}/all/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    q = out.writeStream.outputMode(mode).option("checkpointLocation", where + "/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    schema = out.schema
    return spark.read.schema(schema).parquet(where + "/all").select(*schema.names)


def ledger(events: DataFrame) -> DataFrame:
    """The last event of each run as the stream's state: one bounded row a run."""
    return latest_state(events.select("event_id", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), "event_type"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per window and type; windows end when the watermark has passed them, and their state is dropped."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def changed_files(files: DataFrame, signatures: list[str] = ["collection", "repo", "source_path", "signature"]) -> DataFrame:
    """File versions not seen before by the stream; late repeats within the watermark are dropped."""
    return files.withWatermark("fetched_at", "7 days").dropDuplicatesWithinWatermark(signatures)


def index_stream(files: DataFrame, name: str = "index") -> DataFrame:
    """Records of a stream of files (collection, repo, source_path, signature, fetched_at, path, language, text): every batch
    parses the paths whose signature is not the stored one, and takes the records of all other paths over.

    A batch writes a whole state beside the one before it, numbered, so that a batch replayed after a failure
    begins from the same state and replaces its own. Of several versions of a path in a batch the last fetched counts.
    """
    from lodewright.parse.chunks import RECORD, parse_files

    spark, key = files.sparkSession, ["collection", "repo", "source_path"]
    where = fresh(spark, name)
    stored = f"collection string, repo string, source_path string, signature string, {RECORD}"
    state = lambda n: spark.read.schema(stored).parquet(f"{where}/state-{n}") if n >= 0 else spark.createDataFrame([], stored)
    last = {"n": -1}

    def write(batch: DataFrame, number: int) -> None:
        before = state(number - 1)
        newest = batch.groupBy(*key).agg(F.max_by(F.struct("signature", "path", "language", "text"), F.struct("fetched_at", "signature")).alias("f")).select(*key, "f.*")
        known = before.select(*key, "signature").distinct()
        changed = newest.join(known, [*key, "signature"], "left_anti").withColumn("file_id", F.xxhash64(*key))
        changed = changed.persist()
        parsed = parse_files(changed.select("file_id", "path", "language", "text")).join(changed.select("file_id", *key, "signature"), "file_id")
        kept = before.join(changed.select(*key), key, "left_anti")
        columns = [c.split()[0] for c in stored.split(", ")]
        kept.select(*columns).unionByName(parsed.select(*columns)).write.mode("overwrite").parquet(f"{where}/state-{number}")
        changed.unpersist()
        last["n"] = number

    q = files.writeStream.option("checkpointLocation", where + "/progress").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return state(last["n"])
