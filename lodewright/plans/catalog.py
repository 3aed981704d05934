"""All core queries with their SQL."""

from __future__ import annotations

from lodewright.plans import code, index, ops, parsing, problems, sarif, search, stores, streams

FLAGSHIP = "text_any_terms"
_MODULES = (problems, index, search, code, ops, sarif, parsing, stores, streams)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
