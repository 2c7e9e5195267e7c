"""The engine's registered queries and their SQL."""

from __future__ import annotations

from quire.plans import queries as plans

FLAGSHIP = "q13_op_categories"


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
