"""Named queries of the library and their SQL counterparts."""

from __future__ import annotations

from korpora.plans import activity, maintenance, search, skew, text_index

MODULES = (text_index, search, maintenance, activity, skew)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
