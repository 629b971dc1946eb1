"""All registered queries."""

from __future__ import annotations

from tripleloom.plans import queries_clean, queries_joins, queries_stats, queries_score, queries_graph, queries_text, queries_prep, queries_io  # noqa: F401
from tripleloom.plans.registry import SQL, callables  # noqa: F401


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
