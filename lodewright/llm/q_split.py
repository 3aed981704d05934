"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.llm.split import LIMIT, OVERLAP_LINES, split_records
from lodewright.tables import table


def p2_pieces(spark, d):
    out = split_records(table(spark, d, "project_code_intel_records"))
    return out.select("id", "parent_record_id", "piece", "line_start", "line_end", "text")


def p2_found(spark, d):
    return split_records(table(spark, d, "project_code_intel_records")).select("id").distinct()


def p2_coverage(spark, d):
    """Per long record what its pieces cover: characters, lines, whether all keep the limit and follow each other, and the
    most lines that one repeats."""
    t = split_records(table(spark, d, "project_code_intel_records"))
    t = t.withColumn("lines", F.length("text") - F.length(F.replace("text", F.lit("\n"))))
    repeated = F.expr("substr(text, 1, int(char_new - char_start))")
    return t.groupBy("id").agg(
        F.sum(F.col("char_end") - F.col("char_new")).alias("n_chars"),
        (F.max("char_end") == F.sum(F.col("char_end") - F.col("char_new"))).alias("whole"),
        F.bool_and((F.length("text") <= LIMIT) & (F.length("text") == F.col("char_end") - F.col("char_start"))).alias("within_limit"),
        (F.max(F.length(repeated) - F.length(F.replace(repeated, F.lit("\n")))) <= OVERLAP_LINES).alias("overlap_kept"),
        F.bool_and(F.col("line_end") - F.col("line_start") == F.col("lines") - F.when(F.col("text").endswith("\n"), 1).otherwise(0)).alias("lines_kept"),
        F.min("line_start").alias("line_start"),
        F.max("line_end").alias("line_end"),
        F.countDistinct("piece").cast("long").alias("n"),
        F.max("piece").cast("long").alias("last"),
    ).withColumn("numbered", F.col("n") == F.col("last")).drop("n", "last")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_coverage": p2_coverage}
_BODY = r"regexp_extract(display_content, '(?s)\n`{3,}[^\n]*\n(.*)\n`{3,}$', 1)"
SQL = {
    "p2_found": f"SELECT DISTINCT id FROM project_code_intel_records WHERE length({_BODY}) > 2400",
    # what pieces must add up to, whatever their cuts
    "p2_coverage": f"""WITH b AS (SELECT DISTINCT ON (id) id, line_start, {_BODY} body FROM project_code_intel_records)
SELECT id, length(body)::BIGINT n_chars, true whole, true within_limit, true overlap_kept, true lines_kept, coalesce(line_start, 1)::BIGINT line_start,
  (coalesce(line_start, 1) + length(body) - length(replace(body, chr(10), '')) - CASE WHEN body LIKE '%' || chr(10) THEN 1 ELSE 0 END)::BIGINT line_end, true numbered
FROM b WHERE length(body) > 2400""",
}
