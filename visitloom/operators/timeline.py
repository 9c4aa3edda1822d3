"""Order-dependent operators over logs and encounters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.operators import scan as S
from visitloom.scratch import Rounds
from visitloom.session import ship

REARM = 30
SAMPLE_MS = 5_000


def rearmed(pulls: DataFrame, by: tuple[str, ...] = ("segment_id", "encounter_id"), gap: int = REARM) -> DataFrame:
    """Pulls of one encounter and difficulty within ``gap`` of the one before merge into one.

    Each merge moves the time on, so the gap is to the last merged pull: gaps and islands. A
    pull of another difficulty in between starts a new one.
    """
    order = ["at", "pull_id"]
    told, most = S.numbered(S.by_density(pulls, list(by), "at"))
    told = S.scan(told, most, list(by), order, [S.before("_b", "at", "difficulty")])
    fresh = F.col("_b").isNull() | (F.col("at") - F.col("_b.at") > gap) | ~F.col("_b.difficulty").eqNullSafe(F.col("difficulty"))
    told = Rounds(pulls.sparkSession, "rearmed").save(told.withColumn("_f", F.coalesce(fresh, F.lit(False)).cast("long")).drop("_b"))
    told = S.scan(told, most, list(by), order, [S.Carry("_n", "sum", F.col("_f"))])
    return told.groupBy(*by, "_n").agg(
        F.min("pull_id").alias("pull_id"), F.min("at").alias("started_at"), F.max("at").alias("at"), F.max_by("difficulty", F.struct("at", "pull_id")).alias("difficulty"),
        F.bool_or("success").alias("success"), F.count("*").alias("n_pulls"),
    ).drop("_n")


def credited(pulls: DataFrame, saved: DataFrame) -> DataFrame:
    """A lost pull counts as a kill if no pull of that boss won and the lockout says it is dead."""
    w = W.partitionBy("segment_id", "encounter_id")
    last = F.row_number().over(w.orderBy(F.col("at").desc(), F.col("pull_id").desc())) == 1
    known = pulls.join(saved.select("segment_id", "encounter_id").distinct().withColumn("_dead", F.lit(True)), ["segment_id", "encounter_id"], "left")
    won = F.bool_or(F.coalesce("success", F.lit(False))).over(w)
    credit = ~won & F.coalesce("_dead", F.lit(False)) & last
    return known.withColumn("credited", credit).withColumn("success", F.coalesce("success", F.lit(False)) | F.col("credited")).drop("_dead")


def with_years(lines: DataFrame, by: str, start_year: int) -> DataFrame:
    """Lines that name month and day only, with a year that moves on from December to January."""
    told, most = S.numbered(lines.withColumn("_span", S.by_number("line_no")))
    told = S.scan(told, most, [by], ["line_no"], [S.before("_b", "month")])
    turned = (F.col("_b.month") == 12) & (F.col("month") == 1)
    told = Rounds(lines.sparkSession, "years").save(told.withColumn("_t", F.coalesce(turned, F.lit(False)).cast("long")).drop("_b"))
    told = S.scan(told, most, [by], ["line_no"], [S.Carry("year", "sum", F.col("_t"))])
    return told.withColumn("year", start_year + F.col("year")).drop("_t", "_span")


def latest_before(lines: DataFrame, by: str, marker: str, value: str, name: str) -> DataFrame:
    """Each line with the value of the latest marker line at or before it."""
    shown = S.Carry(name, "last", F.when(F.col(marker), F.col(value)))
    told, most = S.numbered(lines.withColumn("_span", S.by_number("line_no")))
    return S.scan(told, most, [by], ["line_no"], [shown]).drop("_span")


def thinned(ticks: DataFrame, by: str, order: str, most: int = 12) -> DataFrame:
    """Every k-th tick so that at most about ``most`` remain, and always the last."""
    counts = ticks.groupBy(by).agg(F.count("*").alias("_n"))
    told, highest = S.numbered(S.by_density(ticks, [by], order))
    told = S.scan(told, highest, [by], [order], [S.Carry("_i", "sum", F.lit(1).cast("long"), upto=False)])
    told = S.joined(told, counts, [by]).withColumn("_k", F.ceil(F.col("_n") / most))
    return told.where((F.col("_i") % F.col("_k") == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_n", "_i", "_k", "_span")


def keep_samples(at: np.ndarray, place: np.ndarray, last: tuple | None, every: int) -> tuple[list[int], tuple | None]:
    """Indices of kept rows, in the order of ``at``, and the last kept (at, place): a gap of ``every``
    since the last kept row, or another place.

    The next kept row is the first after the gap or the first of the next place, whichever comes
    first, so the loop steps from kept row to kept row.
    """
    n = len(at)
    if not n:
        return [], last
    turns = np.append(np.flatnonzero(place[1:] != place[:-1]) + 1, n)

    def after(i: int, since, here) -> int:
        gap = np.searchsorted(at[i:], since + every) + i
        turn = i if here != place[i] else turns[np.searchsorted(turns, i, side="right")]
        return int(min(gap, turn))

    kept = []
    i = 0 if last is None else after(0, last[0], last[1])
    while i < n:
        kept.append(i)
        last = (at[i], place[i])
        i = after(i + 1, at[i], place[i]) if i + 1 < n else n
    return kept, last


def sampled(positions: DataFrame, by: str = "log", every: int = SAMPLE_MS) -> DataFrame:
    """Down-sampled positions: depends on the last row kept, so each log is folded in order.

    Rows arrive sorted by Spark and are read in batches; a task holds one batch and one last row
    a log, never a whole log.
    """
    ship(positions.sparkSession)
    columns = positions.columns
    at, place, key = columns.index("at_ms"), columns.index("place"), columns.index(by)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, last = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            logs, times, places = (pdf.iloc[:, c].to_numpy() for c in (key, at, place))
            keep = []
            starts = np.append(np.flatnonzero(np.append(True, logs[1:] != logs[:-1])), len(pdf))
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if logs[lo] != log:
                    log, last = logs[lo], None
                got, last = keep_samples(times[lo:hi], places[lo:hi], last, every)
                keep += [lo + i for i in got]
            yield pdf.iloc[keep]

    ordered = positions.repartition(by).sortWithinPartitions(by, "at_ms", *[c for c in columns if c not in (by, "at_ms")])
    return ordered.mapInPandas(fold, positions.schema)


def folded_fights(marks: DataFrame, by: str = "log") -> DataFrame:
    """Fights out of START and END marks: (log, kind, encounter_id, started_at, ended_at, success).

    Per log, kind and encounter an END closes the newest open START before it; an END without
    START stands by its end alone, a START without END stays open. Marks nest: the depth is the
    running sum of START = 1 and END = -1, floored at zero by taking off its running minimum. An
    END that makes a new minimum finds nothing open; the others follow their START at one depth.
    """
    group, rounds = [by, "kind", "encounter_id"], Rounds(marks.sparkSession, "fights")
    told, most = S.numbered(marks.where("mark in ('START', 'END')").withColumn("_span", S.by_number("line_no")))
    step = F.when(F.col("mark") == "START", 1).otherwise(-1).cast("long")
    told = rounds.save(S.scan(told, most, group, ["line_no"], [S.Carry("_sum", "sum", step)]))
    told = S.scan(told, most, group, ["line_no"], [S.Carry("_was", "min", F.col("_sum"), upto=False)])
    was = F.least(F.col("_was"), F.lit(0))  # the lowest sum before this line
    told = told.withColumn("_orphan", (F.col("mark") == "END") & (F.col("_sum") < was))
    told = told.withColumn("_depth", F.col("_sum") - F.least(was, F.col("_sum")) + (F.col("mark") == "END").cast("long"))
    pair = [*group, "_orphan", "_depth"]
    told = rounds.save(told.drop("_sum", "_was"))
    told = S.scan(told, most, pair, ["line_no"], [S.before("_then", "mark", "at", "success")], backward=True)
    told = told.select("*", F.col("_then.mark").alias("_next"), F.col("_then.at").alias("_end"), F.col("_then.success").alias("_ok"))
    starts = told.where("mark = 'START'").select(
        by, "kind", "encounter_id", "line_no", F.col("at").alias("started_at"),
        F.when(F.col("_next") == "END", F.col("_end")).alias("ended_at"), F.when(F.col("_next") == "END", F.col("_ok")).alias("success"),
    )
    orphans = told.where("_orphan").select(
        by, "kind", "encounter_id", "line_no", F.lit(None).cast(marks.schema["at"].dataType).alias("started_at"), F.col("at").alias("ended_at"), "success"
    )
    return starts.unionByName(orphans)


def close_open_fights(stored: DataFrame, marks: DataFrame, by: str = "log") -> DataFrame:
    """Stored fights after a later read of their logs: open ones take part as the STARTs that they are.

    An END of the later read closes the newest open row of its kind and encounter, stored or new;
    closed rows stay as they are.
    """
    opened = F.col("ended_at").isNull()
    again = stored.where(opened).select(
        by, "kind", "encounter_id", "line_no", F.col("started_at").alias("at"), F.lit("START").alias("mark"), F.lit(None).cast("boolean").alias("success")
    )
    marked = marks.where("mark in ('START', 'END')").select(*again.columns)
    return stored.where(~opened).unionByName(folded_fights(again.unionByName(marked), by))


def tracked(events: DataFrame, identity: list[str], by: str = "actor", gap: int | None = None) -> DataFrame:
    """Visits folded from an event stream: a new one begins when who, where or how changes.

    Only visits in which something happened (weight > 0) stay.
    """
    order = ["at", "event_id"]
    told, most = S.numbered(S.by_density(events, [by], "at"))
    told = S.scan(told, most, [by], order, [S.before("_b", "at", *[c for c in identity if c != "at"])])
    changed = F.col("_b").isNull()
    for c in identity:
        changed = changed | ~F.col(f"_b.{c}").eqNullSafe(F.col(c))
    if gap is not None:
        changed = changed | (F.col("at") - F.col("_b.at") > gap)
    told = Rounds(events.sparkSession, "tracked").save(told.withColumn("_c", F.coalesce(changed, F.lit(True)).cast("long")).drop("_b"))
    told = S.scan(told, most, [by], order, [S.Carry("visit_no", "sum", F.col("_c"))])
    out = told.groupBy(by, "visit_no").agg(
        *[F.min(c).alias(c) for c in identity if c != by], F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count("*").alias("n_events"), F.sum("weight").alias("weight")
    )
    return out.where("weight > 0")


def counter_gains(readings: DataFrame, by: list[str], value: str = "held", at: str = "at", order: str = "event_id") -> DataFrame:
    """What counters gained: the first sight is a baseline, later rises count, falls do not."""
    told, most = S.numbered(S.by_density(readings, by, at))
    told = S.scan(told, most, by, [at, order], [S.before("_b", value)])
    rise = F.greatest(F.col(value) - F.col(f"_b.{value}"), F.lit(0))
    return told.withColumn("_r", F.coalesce(rise, F.lit(0))).groupBy(*by).agg(F.sum("_r").alias("gained"), F.max_by(value, F.struct(at, order)).alias("total"))
