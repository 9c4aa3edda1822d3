"""Registering queries beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The visits relation in DuckDB, to begin an oracle's WITH list.
VISITS = """
visits AS (
  SELECT event_id AS visit_id, user_id AS actor, event_type AS place, floor(epoch(ts))::BIGINT AS started_at,
         floor(epoch(ts))::BIGINT + floor(value * 10)::BIGINT AS ended_at, floor(value * 10)::BIGINT AS seconds,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS level,
         strftime(make_timestamp((floor(epoch(ts))::BIGINT + floor(value * 10)::BIGINT) * 1000000), '%Y-%m-%d') AS day,
         floor(value * 100)::BIGINT AS loot
  FROM events
)"""


def query(sql: str | None = None):
    """Register a (spark, sf_dir) function under its own name, with its SQL if SQL can say it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep
