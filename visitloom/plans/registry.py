"""All queries of the analytics operators and their oracle SQL."""

from __future__ import annotations

from visitloom.plans import activity, catalogue, merging, recipes, records, shelves, stored, surface, tallies, text, timeline, visits  # noqa: F401
from visitloom.plans import streams  # noqa: F401, E402  (after timeline, whose SQL it reuses)
from visitloom.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
