"""Queries of problem 7."""

from __future__ import annotations

from lodewright.llm.parsecheck import parse_check, rates
from lodewright.tables import table


def _checked(spark, d):
    return parse_check(table(spark, d, "raw_files"), table(spark, d, "project_code_intel_files"))


def p7_found(spark, d):
    return _checked(spark, d).filter("verdict <> 'valid'").select("collection", "repo", "source_path", "file_sha256").distinct()


def p7_rates(spark, d):
    return rates(_checked(spark, d), table(spark, d, "project_code_intel_files"))


def p7_verdicts(spark, d):
    return _checked(spark, d).filter("verdict <> 'valid'").select("raw_id", "language", "verdict", "parsed_as")


QUERIES = {"p7_found": p7_found, "p7_rates": p7_rates, "p7_verdicts": p7_verdicts}
SQL: dict[str, str] = {}  # SQL has no parsers; tests hold accepted and refused texts of each language
