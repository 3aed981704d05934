"""Queries of the training-data problems, with their SQL where SQL can say it."""

from __future__ import annotations

from lodewright.llm import q_handwritten, q_neardup, q_neighbours, q_source, q_split, q_subjects, q_tokens

_MODULES = (q_neardup, q_split, q_neighbours, q_handwritten, q_source, q_tokens, q_subjects)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
