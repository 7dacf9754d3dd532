"""Named queries over the tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from snaplake.plans import analytics, builder, changes, extras, files, logs, requests, scale, transfers

MODULES = (builder, changes, analytics, logs, extras, transfers, requests, files, scale)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
