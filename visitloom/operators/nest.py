"""Nested documents: parents with ordered lists of their children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]], ones: dict[str, DataFrame] | None = None) -> DataFrame:
    """Parents with one array of structs for each kind of children, in the order of the given columns.

    Children are aggregated by the parent's key before they meet the parents, so each kind
    costs one exchange. Parents without children get empty arrays; ``ones`` are at most one row
    a parent and become nullable structs.
    """
    out = parents
    for name, (rows, order) in children.items():
        rest = [c for c in rows.columns if c != key and c not in order]
        listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array()))
    for name, rows in (ones or {}).items():
        one = rows.select(key, F.struct(*[c for c in rows.columns if c != key]).alias(name))
        out = out.join(one, key, "left")
    return out


def unnest(documents: DataFrame, key: str, name: str) -> DataFrame:
    """The children again, with their 0-based position in the list."""
    told = documents.select(key, F.posexplode(name).alias("position", "child"))
    return told.select(key, "position", "child.*")


def compact_json(*columns: str):
    """JSON object of the given columns without those that are null."""
    return F.to_json(F.struct(*columns))


def used_columns(documents: DataFrame, lists: list[str]) -> list[str]:
    """Names of the lists that any document fills, from one pass over their sizes."""
    row = documents.agg(*[F.max(F.coalesce(F.size(c), F.lit(0))).alias(c) for c in lists]).first()
    return [c for c in lists if (row[c] or 0) > 0]
