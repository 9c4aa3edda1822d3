"""The folds over logs and events as streams; each must end where its batch form does."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.plans.base import SQL, query
from visitloom.sources.tables import stream
from visitloom.streaming import jobs


def _events(spark, d):
    return stream(spark, d, "events")


def _seconds():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


@query("SELECT CAST(log AS VARCHAR) AS log, line_no, started_at, ended_at FROM (" + SQL["folded_fights"] + ")")
def streamed_fights(spark, d):
    marks = _events(spark, d).select(
        F.col("user_id").cast("string").alias("log"), F.col("event_type").alias("kind"), (F.col("event_id") % 3).alias("encounter_id"), F.col("event_id").alias("line_no"),
        _seconds().alias("at"), F.when(F.col("value") < 50, "START").otherwise("END").alias("mark"), (F.col("value") > 75).alias("success"),
    )
    told = jobs.drained(jobs.fights(marks), "fights")
    # a fight that opened and closed came twice; the closed row is the newer
    return told.groupBy("log", "line_no").agg(F.max("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))


@query("""WITH s AS (SELECT user_id AS actor, event_id, floor(epoch(ts))::BIGINT AS t, floor(value)::BIGINT AS held FROM events),
r AS (SELECT *, greatest(held - lag(held) OVER (PARTITION BY actor ORDER BY t, event_id), 0) AS rise FROM s)
SELECT actor, coalesce(sum(rise), 0)::BIGINT AS gained, arg_max(held, (t, event_id)) AS total FROM r GROUP BY actor""")
def streamed_counters(spark, d):
    readings = _events(spark, d).select(F.col("user_id").alias("actor"), "event_id", _seconds().alias("at"), F.floor("value").cast("long").alias("held"))
    told = jobs.drained(jobs.counter_gains(readings, "actor"), "counters")
    return told.groupBy("actor").agg(F.sum("gained").alias("gained"), F.max_by("total", F.struct("at", "event_id")).alias("total"))


@query("""WITH s AS (SELECT user_id AS actor, event_id, event_type AS place, floor(epoch(ts))::BIGINT AS t, CASE WHEN value > 60 THEN 1 ELSE 0 END AS weight FROM events),
c AS (SELECT *, CASE WHEN place IS DISTINCT FROM lag(place) OVER w THEN 1 ELSE 0 END AS turn, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY actor ORDER BY t, event_id)),
v AS (SELECT *, sum(CASE WHEN n = 1 THEN 1 ELSE turn END) OVER (PARTITION BY actor ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS no FROM c),
g AS (SELECT actor, no, min(place) AS place, min(t) AS started_at, max(t) AS ended_at, count(*) AS n_events, sum(weight)::BIGINT AS weight FROM v GROUP BY 1, 2)
SELECT actor, place, started_at, ended_at, n_events, weight FROM g WHERE weight > 0 AND no < (SELECT max(no) FROM g h WHERE h.actor = g.actor)""")
def streamed_visits(spark, d):
    """Finished visits; the one that goes on is still state."""
    s = _events(spark, d).select(F.col("user_id").alias("actor"), "event_id", F.col("event_type").alias("place"), _seconds().alias("at"), F.when(F.col("value") > 60, 1).otherwise(0).cast("long").alias("weight"))
    return jobs.drained(jobs.tracked(s, ["place"]), "visits")
