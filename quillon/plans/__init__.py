"""Registered queries of the retrieval engine."""

from __future__ import annotations

from . import derived_queries, relational_queries, retrieval_queries, structure_queries  # noqa: F401
from .registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
