"""The ledger of index runs: states, retention, newest and live runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_INTERVALS, MIN_STALE_SECONDS, KEEP_FINISHED = 3, 60, 20


def run_state(finished, heartbeat, interrupted, exit_code, now, interval: float = 15.0) -> Column:
    """running, stalled, ok, failed or interrupted."""
    limit = max(STALE_INTERVALS * interval, MIN_STALE_SECONDS)
    age = F.unix_micros(now) / 1e6 - F.unix_micros(heartbeat) / 1e6
    open_state = F.when(age > limit, "stalled").otherwise("running")
    return F.when(finished.isNull(), open_state).when(F.coalesce(interrupted, F.lit(False)), "interrupted").when(exit_code == 0, "ok").otherwise("failed")


def expired_runs(runs: DataFrame, keep: int = KEEP_FINISHED) -> DataFrame:
    """Finished runs beyond the newest keep of each collection."""
    w = Window.partitionBy("collection").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.filter("finished_at IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > keep).drop("_n")


def newest_and_live(runs: DataFrame, now, limit: int) -> DataFrame:
    """The newest runs and all unfinished ones with a heartbeat in the last hour, each once."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
    live = runs.filter(F.col("finished_at").isNull() & (F.col("heartbeat_at") > now - F.expr("INTERVAL 1 HOUR")))
    return newest.unionByName(live).distinct()


def latest_state(events: DataFrame, key: str = "run_id", at: str = "at") -> DataFrame:
    """The last event of each run; works on a batch, and per micro-batch of a stream."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(at, "event_id")).alias("e")).select(key, "e.*")
