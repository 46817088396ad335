"""All core queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from . import agreement, files, rates, records, relations, scalars, sequences, timestamps

MODULES = (timestamps, rates, sequences, agreement, relations, scalars, records, files)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
