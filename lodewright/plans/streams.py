"""Queries that run as streams over what is there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.streaming import ledger as L


def ledger_stream(spark, d):
    out = L.run_to_table(L.ledger(L.event_stream(spark, f"{d}/events.parquet")), "complete", "ledger")
    return out.select("run_id", "event_id", "event_type")


def windowed_stream(spark, d):
    """Counts of the days in complete mode, as the batch would have them."""
    out = L.run_to_table(L.windowed_counts(L.event_stream(spark, f"{d}/events.parquet")), "complete", "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {"ledger_stream": ledger_stream, "windowed_stream": windowed_stream}
SQL = {
    "ledger_stream": "SELECT DISTINCT ON (user_id) user_id run_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC",
    "windowed_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) n FROM events GROUP BY ALL",
}
