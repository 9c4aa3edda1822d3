"""Segmented prefix scans: running values over ordered groups, without one task for a whole group.

A group's rows are cut in spans of about ``ROWS`` along their order. Each span is reduced to one
row of carries; these are scanned in turn, ``FAN`` spans at a time and level upon level, until one
row of a group is left; then a row's value is its span's carry combined with the rows before it
in its span. Any associative carry works: the last non-null value, sums, minima and maxima. Rows move
once, by (group, span), and no window has the group alone as its key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS = 20_000
FAN = 1024
#: Most pieces of a range that holds more than its share.
FINE = 1024


class Carry(NamedTuple):
    """A running value: ``last`` (non-null), ``sum``, ``min`` or ``max`` of ``value``.

    ``upto``: with the row itself, else of the rows before it. Nulls are passed over; nothing
    before gives null, or 0 for sums.
    """

    name: str
    kind: str
    value: Column
    upto: bool = True


def before(name: str, *columns: str) -> Carry:
    """The row before, as a struct of its columns; null at a group's first row."""
    return Carry(name, "last", F.struct(*columns), upto=False)


def joined(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with null-safe keys; the side's keys are dropped."""
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    return rows.join(side.withColumnsRenamed(named), on, how).drop(*named.values())


def by_number(order: str, rows: int | None = None) -> Column:
    """Spans of an order that counts the rows of its group: so many numbers each."""
    return F.floor(F.col(order) / (rows or ROWS)).cast("long")


def by_density(df: DataFrame, by: list[str], order: str, rows: int | None = None) -> DataFrame:
    """Rows with ``_span``: equal ranges of the order, as many as the group's rows ask for.

    Ranges that hold far more than their share are cut again by their own extremes. Rows of one
    group and one order value stay together. Rows whose order is null come first.
    """
    rows = rows or ROWS
    whole = df.groupBy(*by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count("*").alias("_n"))
    wide = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) * F.lit(float(rows)) / F.col("_n")))
    told = joined(df, whole.select(*by, "_lo", wide.alias("_wide")), by)
    told = told.withColumn("_coarse", F.coalesce(F.floor((F.col(order) - F.col("_lo")) / F.col("_wide")), F.lit(-1)).cast("long")).drop("_lo", "_wide")
    full = told.groupBy(*by, "_coarse").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count("*").alias("_n")).where(F.col("_n") > 4 * rows)
    cuts = F.least(F.lit(FINE), F.ceil(F.col("_n") / rows))
    full = full.select(*by, "_coarse", "_lo", ((F.col("_hi") - F.col("_lo") + 1) / cuts).alias("_wide"))
    told = joined(told, full, [*by, "_coarse"], "left")
    fine = F.coalesce(F.floor((F.col(order) - F.col("_lo")) / F.col("_wide")), F.lit(0)).cast("long")
    return told.withColumn("_span", F.col("_coarse") * FINE + fine).drop("_coarse", "_lo", "_wide")


def _reduced(c: Carry, value: Column, order: Column, backward: bool) -> Column:
    """One carry of many rows or spans."""
    if c.kind == "last":
        return (F.min_by if backward else F.max_by)(value, F.when(value.isNotNull(), order))
    return {"sum": F.sum, "min": F.min, "max": F.max}[c.kind](value)


def _running(c: Carry, value: Column, w) -> Column:
    return F.last(value, ignorenulls=True).over(w) if c.kind == "last" else {"sum": F.sum, "min": F.min, "max": F.max}[c.kind](value).over(w)


def _combined(c: Carry, earlier: Column, later: Column) -> Column:
    if c.kind == "last":
        return F.coalesce(later, earlier)
    if c.kind == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(later, F.lit(0))
    return (F.least if c.kind == "min" else F.greatest)(earlier, later)  # nulls are passed over


def _carried(spans: DataFrame, by: list[str], carries: list[Carry], most: int, backward: bool) -> DataFrame:
    """Each span's carries from all spans before it; ``most``: the highest span."""
    told = spans.withColumn("_group", F.floor(F.col("_span") / FAN).cast("long"))
    order = F.col("_span").desc() if backward else F.col("_span").asc()
    w = W.partitionBy(*by, "_group").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inside = told.select(*by, "_span", "_group", *[_running(c, F.col(c.name), w).alias(c.name) for c in carries])
    if most < FAN:
        return inside.drop("_group")
    groups = told.groupBy(*by, "_group").agg(*[_reduced(c, F.col(c.name), F.col("_span"), backward).alias(c.name) for c in carries])
    upper = _carried(groups.withColumnRenamed("_group", "_span"), by, carries, most // FAN, backward)
    upper = upper.select(*by, F.col("_span").alias("_group"), *[F.col(c.name).alias(f"_up_{c.name}") for c in carries])
    both = joined(inside, upper, [*by, "_group"])
    return both.select(*by, "_span", *[_combined(c, F.col(f"_up_{c.name}"), F.col(c.name)).alias(c.name) for c in carries])


def numbered(spanned: DataFrame) -> tuple[DataFrame, int]:
    """Rows whose spans count from 0, and the highest of them; one job, for all scans of these rows."""
    lowest, highest = spanned.agg(F.min("_span"), F.max("_span")).first()
    lowest, highest = (0, 0) if lowest is None else (int(lowest), int(highest))
    return spanned.withColumn("_span", F.col("_span") - lowest), highest - lowest


def scan(rows: DataFrame, most: int, by: list[str], order: list[str], carries: list[Carry], backward: bool = False) -> DataFrame:
    """Rows with a column for each carry, running over each group in order (or against it).

    The rows have ``_span``, a whole number from 0 to ``most`` that never falls along the order, and
    keep it. A scan reads its rows twice, so rows that are a scan's result are best written first
    (``Rounds.save``); else plans double with each scan.
    """
    place = F.struct(*order)
    spans = rows.groupBy(*by, "_span").agg(*[_reduced(c, c.value, place, backward).alias(c.name) for c in carries])
    carried = _carried(spans, by, carries, most, backward)
    carried = carried.select(*by, "_span", *[F.col(c.name).alias(f"_from_{c.name}") for c in carries])
    told = joined(rows, carried, [*by, "_span"])
    inside = W.partitionBy(*by, "_span").orderBy(*[F.col(o).desc() if backward else F.col(o).asc() for o in order])
    local = {c.name: _running(c, c.value, inside.rowsBetween(W.unboundedPreceding, 0 if c.upto else -1)) for c in carries}
    told = told.withColumns({c.name: _combined(c, F.col(f"_from_{c.name}"), local[c.name]) for c in carries})
    return told.drop(*[f"_from_{c.name}" for c in carries])
