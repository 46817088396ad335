"""Queries of the llm subpackage and their oracle SQL."""

from __future__ import annotations

from . import queries_logs, queries_text

MODULES = (queries_logs, queries_text)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
