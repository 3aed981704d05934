"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.llm.neighbours import nearest
from lodewright.tables import table


def _vectors(spark, d):
    return table(spark, d, "project_code_intel_records").filter("embedding IS NOT NULL").select("id", "embedding")


def p5_found(spark, d):
    near = nearest(_vectors(spark, d), k=10, visit=4000, min_cosine=0.95)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p5_nearest(spark, d):
    """The 10 nearest of every vector whose id is divisible by 100, with visits that find over 0.9 of them and grow less than the index."""
    near = nearest(_vectors(spark, d), k=10, visit=500, effort=8, queries="id % 100 = 0")
    return near.select("id", "neighbour", F.round("cosine", 6).alias("cosine"))


QUERIES = {"p5_found": p5_found, "p5_nearest": p5_nearest}
_UNITS = """
WITH u AS MATERIALIZED (SELECT id, embedding::DOUBLE[48] e FROM (SELECT DISTINCT ON (id) id, embedding FROM project_code_intel_records WHERE embedding IS NOT NULL)
  WHERE len(embedding) = 48 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""
# Brute force over all pairs. p5_nearest is approximate: its recall is tested, not compared.
SQL = {
    "p5_found": _UNITS
    + """, n AS (SELECT a.id, b.id o, array_cosine_similarity(a.e, b.e) c FROM u a JOIN u b ON a.id <> b.id AND array_cosine_similarity(a.e, b.e) >= 0.95)
SELECT DISTINCT least(id, o) id_a, greatest(id, o) id_b FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, o) <= 10)"""
}
