"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from scoutframe.plans import classes, extra, fits, markup, more, queries, trust

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (queries, more, extra, fits, classes, markup, trust):
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.ORACLE_SQL)
