"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.llm.handwritten import source_labels
from lodewright.tables import table


def _labels(spark, d):
    return source_labels(table(spark, d, "raw_files"), table(spark, d, "project_code_intel_files"), table(spark, d, "third_party_files"))


def p6_found(spark, d):
    return _labels(spark, d).filter("label <> 'handwritten'").select("collection", "repo", "source_path")


def p6_labels(spark, d):
    """Paths per repo and label."""
    return _labels(spark, d).groupBy("collection", "repo", "label").agg(F.count(F.lit(1)).alias("n_paths"))


QUERIES = {"p6_found": p6_found, "p6_labels": p6_labels}
SQL: dict[str, str] = {}  # belief propagation is tested against enumeration of all labellings
