"""Inferred activities, log verdicts and retention over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.operators import activity as A
from visitloom.plans.base import VISITS, query
from visitloom.sources.tables import visits


def _rich(spark, d):
    v = visits(spark, d)
    k = F.col("visit_id")
    return v.select(
        "visit_id", "seconds", F.col("place").alias("instance"), F.lit("Heroic").alias("difficulty"),
        F.when(k % 5 == 0, "party").when(k % 5 == 1, "raid").when(k % 5 == 2, "scenario").otherwise("none").alias("instance_type"),
        F.when(k % 5 == 0, F.when(k % 2 == 0, 8).otherwise(2)).when(k % 5 == 2, 208).alias("difficulty_id"),
        F.when((k % 5 == 0) & (k % 3 == 0), F.struct(F.col("level").alias("level"), (k % 2 == 0).alias("on_time"), (F.col("seconds") * 1000).alias("duration_ms"))).alias("keystone"),
        F.when(k % 3 == 0, F.col("level")).alias("tier"), F.when(k % 2 == 0, F.lit(50).cast("long")).alias("latest_tier"),
        F.when(k % 7 == 0, F.struct((F.col("level") / 1000).alias("percent"))).alias("experience"), F.when(k % 11 == 0, 1).alias("levels"),
        F.when(k % 13 == 0, F.array(F.lit("Walk"), F.concat(F.lit("Prey: "), "place", F.lit(" (Hard)")))).when(k % 17 == 0, F.array(F.lit("Prey: Wolf"))).alias("quests"),
        F.when((k % 5 == 2) & (k % 4 == 0), F.struct(F.when(k % 8 == 0, F.col("level")).alias("tier"), F.col("started_at").alias("started_at"), F.col("ended_at").alias("completed_at"))).alias("delve"),
    )


@query(f"""WITH {VISITS}
SELECT visit_id, 'mythic_plus' AS kind, CASE WHEN visit_id % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM visits WHERE visit_id % 5 = 0 AND (visit_id % 3 = 0 OR visit_id % 2 = 0)
UNION ALL SELECT visit_id, CASE WHEN visit_id % 3 = 0 AND visit_id % 2 = 0 AND level >= 50 THEN 'progress_raid' ELSE 'legacy_raid' END, CASE WHEN visit_id % 3 = 0 AND visit_id % 2 = 0 AND level IS NOT NULL THEN 0.9 ELSE 0.4 END::DOUBLE FROM visits WHERE visit_id % 5 = 1
UNION ALL SELECT visit_id, 'levelling', 1.0 FROM visits WHERE visit_id % 11 = 0 OR (visit_id % 7 = 0 AND level / 1000.0 >= 0.05)
UNION ALL SELECT visit_id, 'prey', CASE WHEN visit_id % 13 = 0 THEN 0.9 ELSE 0.6 END FROM visits WHERE visit_id % 13 = 0 OR visit_id % 17 = 0
UNION ALL SELECT visit_id, 'delve', CASE WHEN visit_id % 8 = 0 AND level IS NOT NULL THEN 1.0 ELSE 0.5 END FROM visits WHERE visit_id % 5 = 2""")
def inferred_activities(spark, d):
    return A.infer(_rich(spark, d)).select("visit_id", "kind", "confidence")


@query(f"""WITH {VISITS}, g AS (SELECT actor, CASE WHEN actor % 10 = 0 THEN NULL ELSE max(ended_at) END AS p, max(started_at) - actor * 20 AS r FROM visits GROUP BY actor)
SELECT actor, CASE WHEN p IS NULL OR r IS NULL THEN 'unknown' WHEN abs(1706700000 - p) <= 3600 THEN 'live' WHEN p - r <= 300 THEN 'complete' ELSE 'missing' END AS verdict FROM g""")
def gap_verdicts(spark, d):
    g = visits(spark, d).groupBy("actor").agg(F.max("ended_at").alias("p"), F.max("started_at").alias("r"))
    return g.select("actor", A.gap_verdict(F.when(F.col("actor") % 10 != 0, F.col("p")), F.col("r") - F.col("actor") * 20, 1706700000).alias("verdict"))


def _logs(spark, d):
    return visits(spark, d).groupBy(F.concat(F.lit("log-"), F.col("actor").cast("string")).alias("name")).agg(
        F.max("ended_at").alias("modified_at"), F.sum("seconds").alias("bytes"), F.count("*").alias("lines"), F.min("actor").alias("actor")
    )


_LOGS = f"WITH {VISITS}, logs AS (SELECT 'log-' || actor AS name, max(ended_at) AS modified_at, sum(seconds)::BIGINT AS bytes, actor FROM visits GROUP BY actor), v AS (SELECT name, bytes, modified_at, CASE WHEN name = (SELECT name FROM logs ORDER BY modified_at DESC, name DESC LIMIT 1) THEN 'active' WHEN actor % 4 = 0 THEN 'unread' WHEN actor % 4 = 1 THEN 'partial' WHEN modified_at < 1706700000 - 86400 * 1 THEN 'doomed' ELSE 'kept' END AS verdict FROM logs)"


def _plan(spark, d):
    logs = _logs(spark, d)
    cursors = logs.where("actor % 4 <> 0").select("name", F.when(F.col("actor") % 4 == 1, F.col("bytes") - 1).otherwise(F.col("bytes")).alias("offset"))
    return A.retention_plan(logs, cursors, 1, 1706700000)


@query(_LOGS + " SELECT name, verdict FROM v")
def retention_verdicts(spark, d):
    return _plan(spark, d).select("name", "verdict")


@query(_LOGS + ", r AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY modified_at, name) AS k FROM v) SELECT verdict, count(*) AS n, sum(bytes)::BIGINT AS bytes, string_agg(name, ',' ORDER BY k) FILTER (k <= 10) AS first_names FROM r GROUP BY verdict")
def retention_piles(spark, d):
    return A.piles(_plan(spark, d)).withColumn("first_names", F.array_join("first_names", ","))


@query(f"""WITH {VISITS}, o AS (SELECT place AS folder, visit_id AS seen_at, 'log-' || (visit_id // 50)::VARCHAR AS name, seconds AS bytes, ended_at AS modified_at FROM visits)
SELECT folder, seen_at, (coalesce(lag(name) OVER w IS DISTINCT FROM name AND lag(seen_at) OVER w IS NOT NULL, false) OR coalesce(bytes > lag(bytes) OVER w, false) OR abs(1705000000 - modified_at) <= 3600) AS growing
FROM o WINDOW w AS (PARTITION BY folder ORDER BY seen_at)""")
def growing_logs(spark, d):
    o = visits(spark, d).select(
        F.col("place").alias("folder"), F.col("visit_id").alias("seen_at"), F.concat(F.lit("log-"), F.floor(F.col("visit_id") / 50).cast("string")).alias("name"),
        F.col("seconds").alias("bytes"), F.col("ended_at").alias("modified_at"),
    )
    return A.growing(o, 1705000000).select("folder", "seen_at", "growing")


@query(f"""WITH {VISITS}, c AS (SELECT actor, CASE WHEN actor % 3 = 0 THEN NULL ELSE actor % 3 = 1 END AS complete, count(*) AS held, count(*) + actor % 2 AS counted FROM visits GROUP BY actor)
SELECT actor, CASE WHEN complete IS NULL THEN 'unwalked' WHEN complete THEN 'whole' ELSE 'partial' END AS verdict, CASE WHEN counted > held THEN counted - held END AS short FROM c""")
def census_verdicts(spark, d):
    c = visits(spark, d).groupBy("actor").agg(F.count("*").alias("held"))
    word, short = A.census_verdict(F.when(F.col("actor") % 3 != 0, F.col("actor") % 3 == 1), F.col("held") + F.col("actor") % 2, F.col("held"))
    return c.select("actor", word.alias("verdict"), short.alias("short"))


@query(f"""WITH {VISITS}
SELECT visit_id, 'levelling' AS kind, '{{"percentOfLevel":' || round(CASE WHEN visit_id % 7 = 0 THEN level / 1000.0::DOUBLE ELSE 0 END * 100, 1)::DOUBLE || ',"levelsGained":' || CASE WHEN visit_id % 11 = 0 THEN 1 ELSE 0 END || '}}' AS metadata
FROM visits WHERE visit_id % 11 = 0 OR (visit_id % 7 = 0 AND level / 1000.0 >= 0.05)
UNION ALL SELECT visit_id, 'prey', CASE WHEN visit_id % 13 = 0 THEN '{{"title":"' || place || '","difficulty":"Hard","huntsCompleted":1}}' ELSE '{{"title":"Wolf","huntsCompleted":1}}' END FROM visits WHERE visit_id % 13 = 0 OR visit_id % 17 = 0""")
def activity_metadata(spark, d):
    return A.infer(_rich(spark, d)).where("kind in ('levelling', 'prey')").select("visit_id", "kind", "metadata")
