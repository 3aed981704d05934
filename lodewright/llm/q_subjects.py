"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.llm.subjects import document_subjects
from lodewright.tables import table


def p10_found(spark, d):
    return document_subjects(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))


def p10_composition(spark, d):
    """Documents and their share of the corpus per subject; a document of several counts for each."""
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_all"))
    per = p10_found(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"))
    return per.join(F.broadcast(n)).select("subject", "n_docs", F.round(F.col("n_docs") / F.col("n_all"), 6).alias("share"))


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition}
SQL: dict[str, str] = {}  # topics have no SQL; tests hold the subjects against labels
