"""Sessions, islands and what is summed over them.

A session is a run of visits in which each starts at most ``gap`` seconds after the latest
end seen so far (the frontier), whoever made them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP = 300
DAY = 86_400
SPAN_ROWS = 20_000


def sessionize(visits: DataFrame, gap: int = GAP, by: tuple[str, ...] = (), span: int | None = None) -> DataFrame:
    """Visits with session_no (from 1, in time order within ``by``).

    The frontier is a running maximum over all earlier visits. To keep one global order out of
    a single task, time is cut in spans: each span's largest end and number of new sessions are
    aggregated first, their running values are taken over that small table, and the rows are
    ordered only within their own span. Without ``span`` it is a day if ``by`` parts the visits,
    and else such that a span has about SPAN_ROWS visits, however dense they are.
    """
    keys = list(by)
    if span is None:
        span = DAY if keys else _span_of(visits)
    cut = visits.withColumn("_span", F.floor(F.col("started_at") / span))
    small = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    # two aggregates of rows, two windows over one row a span
    ends = cut.groupBy(*keys, "_span").agg(F.max("ended_at").alias("_end"))
    ends = ends.select(*keys, "_span", F.max("_end").over(small).alias("_carried"))
    rows = _joined(cut, ends, [*keys, "_span"])
    inside = W.partitionBy(*keys, "_span").orderBy("started_at", "ended_at", "visit_id")
    before = F.max("ended_at").over(inside.rowsBetween(W.unboundedPreceding, -1))
    frontier = F.greatest(before, F.col("_carried"))
    flagged = rows.withColumn("_new", (frontier.isNull() | (F.col("started_at") - frontier > gap)).cast("int"))
    news = flagged.groupBy(*keys, "_span").agg(F.sum("_new").alias("_news"))
    news = news.select(*keys, "_span", F.coalesce(F.sum("_news").over(small), F.lit(0)).alias("_base"))
    out = _joined(flagged, news, [*keys, "_span"])
    number = F.col("_base") + F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("session_no", number).drop("_span", "_carried", "_new", "_base")


def _span_of(visits: DataFrame) -> int:
    ends = visits.agg(F.count("started_at").alias("n"), F.min("started_at").alias("lo"), F.max("started_at").alias("hi")).first()
    return max(1, int((ends["hi"] - ends["lo"]) * SPAN_ROWS / ends["n"])) if ends["n"] else DAY


def _joined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with null-safe keys, the side's keys dropped."""
    side = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(side, on).drop(*[f"_k{i}" for i in range(len(keys))])


def session_totals(sessions: DataFrame, sums: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """One row a session: start, end, played and spanned seconds, day of its first visit, sums."""
    first = F.struct("started_at", "ended_at", "visit_id")
    return sessions.groupBy(*by, "session_no").agg(
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.sum("seconds").alias("played_seconds"),
        F.greatest(F.max("ended_at") - F.min("started_at"), F.lit(0)).alias("span_seconds"),
        F.min_by("day", first).alias("day"),
        F.count("*").alias("n_visits"),
        F.countDistinct("actor").alias("n_actors"),
        *[F.sum(c).alias(c) for c in sums],
    )


def session_cast(sessions: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """One row for each actor of a session, places in first-seen order and levels by maximum.

    Visits are summed by place first, so that only an actor's distinct places are gathered.
    """
    per_place = sessions.groupBy("session_no", "actor", "place").agg(
        F.min(F.struct("started_at", "ended_at", "visit_id")).alias("first"), F.sum("seconds").alias("seconds"), F.count("*").alias("n"), F.max("level").alias("level"), *[F.sum(c).alias(c) for c in sums]
    )
    named = F.when(F.col("place").isNotNull() & (F.col("place") != ""), F.struct("first", "place"))
    return per_place.groupBy("session_no", "actor").agg(
        F.sum("seconds").alias("seconds"),
        F.sum("n").alias("n_visits"),
        F.max("level").alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda s: s["place"]), ",").alias("places"),
        *[F.sum(c).alias(c) for c in sums],
    )


def islands(rows: DataFrame, value: str, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Rows with island_no: runs of equal ``value`` in the given order (gaps and islands)."""
    w = W.partitionBy(*by).orderBy(*order)
    changed = ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)
    return rows.withColumn("_changed", changed.cast("int")).withColumn(
        "island_no", F.sum("_changed").over(w.rowsBetween(W.unboundedPreceding, 0))
    ).drop("_changed")


def recent_chain(visits: DataFrame, gap: int = GAP) -> DataFrame:
    """Each actor's latest session: visits backwards while each ends within ``gap`` of the earliest start so far."""
    back = W.partitionBy("actor").orderBy(F.col("started_at").desc(), F.col("visit_id").desc())
    earliest = F.min("started_at").over(back.rowsBetween(W.unboundedPreceding, -1))
    broken = F.coalesce((earliest - F.col("ended_at") > gap).cast("int"), F.lit(0))
    cut = F.max("_broken").over(back.rowsBetween(W.unboundedPreceding, 0))
    return visits.withColumn("_broken", broken).withColumn("_cut", cut).where("_cut = 0").drop("_broken", "_cut")


def actor_profile(visits: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """One row an actor: days, first and last seen, level, and places by time spent, longest first."""
    per_place = visits.groupBy("actor", "place").agg(
        F.sum("seconds").alias("spent"), F.count("*").alias("n"), F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"),
        F.max("level").alias("level"), F.collect_set("day").alias("days"), *[F.sum(c).alias(c) for c in sums],
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("spent")).alias("k"), "place")))
    return per_place.groupBy("actor").agg(
        F.sum("n").alias("n_visits"), F.sum("spent").alias("seconds"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.max("level").alias("level"), F.size(F.array_distinct(F.flatten(F.collect_list("days")))).cast("long").alias("n_days"),
        F.array_join(F.transform(ordered, lambda p: p["place"]), ",").alias("places"), *[F.sum(c).alias(c) for c in sums],
    )


def within_range(visits: DataFrame, days: int | None, now: int) -> DataFrame:
    """Visits of the trailing ``days``; None keeps all."""
    if days is None:
        return visits
    at = F.coalesce(F.nullif(F.col("ended_at"), F.lit(0)), F.col("started_at"), F.lit(0))
    return visits.where(at >= now - days * DAY)


def highlights(kinds: list[tuple[str, DataFrame, str, int]], keep: int | None = None) -> DataFrame:
    """One ranked list out of several kinds of happenings in sessions.

    A kind is (name, rows with session_no and amount, style, rank). Style ``count`` weighs its
    rows, ``sum`` adds amounts and leaves out zero sums. A single row lends its own label.
    """
    out = None
    for name, rows, style, rank in kinds:
        amount = F.count("*") if style == "count" else F.sum("amount")
        one = rows.groupBy("session_no").agg(
            amount.cast("long").alias("weight"), F.when(F.count("*") == 1, F.min("label")).alias("label")
        )
        one = one.where("weight <> 0").select("session_no", F.lit(name).alias("kind"), F.lit(rank).alias("rank"), "weight", "label")
        out = one if out is None else out.unionByName(one)
    return _ranked(out, keep)


def highlights_of(rows: DataFrame, kinds: list[tuple[str, Column, str, int]], keep: int | None = None) -> DataFrame:
    """The same list when all kinds come out of one table: a kind is (name, condition, style, rank).

    The table is read once and grouped once; a row may count for several kinds.
    """
    told = F.array_compact(F.array(*[
        F.when(when, F.struct(F.lit(name).alias("kind"), F.lit(rank).alias("rank"), (F.lit(1) if style == "count" else F.col("amount")).cast("long").alias("amount")))
        for name, when, style, rank in kinds
    ]))
    one = rows.select("session_no", "label", F.explode(told).alias("k"))
    one = one.groupBy("session_no", "k.kind", "k.rank").agg(F.sum("k.amount").alias("weight"), F.when(F.count("*") == 1, F.min("label")).alias("label"))
    return _ranked(one.where("weight <> 0").select("session_no", "kind", "rank", "weight", "label"), keep)


def _ranked(happenings: DataFrame, keep: int | None) -> DataFrame:
    place = F.row_number().over(W.partitionBy("session_no").orderBy("rank", F.abs("weight").desc(), "kind"))
    out = happenings.withColumn("place", place)
    return out if keep is None else out.where(F.col("place") <= keep)


def levels_reached(sessions: DataFrame) -> DataFrame:
    """The highest level each actor reached in each session; who reached none is left out."""
    return sessions.where(F.col("level").isNotNull()).groupBy("session_no", "actor").agg(F.max("level").alias("level"))
