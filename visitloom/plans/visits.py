"""Shipped questions, sessions and profiles over visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.operators import sessions as S
from visitloom.plans.base import VISITS, query
from visitloom.sources.tables import catalog, table, visits


@query(f"WITH {VISITS} SELECT actor, round(sum(seconds) / 3600.0, 1) AS hours FROM visits GROUP BY actor")
def hours_per_actor(spark, d):
    return visits(spark, d).groupBy("actor").agg(F.round(F.sum("seconds") / 3600.0, 1).alias("hours"))


@query(f"WITH {VISITS} SELECT day, round(sum(seconds) / 3600.0, 2) AS hours FROM visits GROUP BY day")
def hours_per_day(spark, d):
    return visits(spark, d).groupBy("day").agg(F.round(F.sum("seconds") / 3600.0, 2).alias("hours"))


@query(f"""WITH {VISITS} SELECT ((started_at // 3600) % 24)::INT AS hour_of_day, round(sum(seconds) / 3600.0, 1) AS hours
FROM visits GROUP BY 1""")
def hours_by_hour(spark, d):
    hour = F.hour(F.timestamp_seconds("started_at"))
    return visits(spark, d).groupBy(hour.alias("hour_of_day")).agg(F.round(F.sum("seconds") / 3600.0, 1).alias("hours"))


@query(f"""WITH {VISITS} SELECT place, round(sum(loot) / 10000.0 / (sum(seconds) / 3600.0), 3) AS value_per_hour,
round(sum(seconds) / 3600.0, 1) AS hours FROM visits GROUP BY place HAVING sum(seconds) > 900
ORDER BY value_per_hour DESC, place LIMIT 20""")
def value_per_hour_by_place(spark, d):
    spent = F.sum("seconds")
    told = visits(spark, d).groupBy("place").agg(
        F.round(F.sum("loot") / 10000.0 / (spent / 3600.0), 3).alias("value_per_hour"), F.round(spent / 3600.0, 1).alias("hours"), spent.alias("s")
    )
    return told.where("s > 900").drop("s").orderBy(F.col("value_per_hour").desc(), "place").limit(20)


@query("""SELECT p_brand AS boss, sum((l_returnflag = 'R')::INT)::BIGINT AS kills, (count(*) - sum((l_returnflag = 'R')::INT))::BIGINT AS wipes
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY wipes DESC, kills DESC, boss LIMIT 25""")
def wins_and_losses(spark, d):
    won = (F.col("l_returnflag") == "R").cast("int")
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    told = rows.groupBy(F.col("p_brand").alias("boss")).agg(F.sum(won).alias("kills"), (F.count("*") - F.sum(won)).alias("wipes"))
    return told.orderBy(F.col("wipes").desc(), F.col("kills").desc(), "boss").limit(25)


@query("""SELECT o_orderpriority AS tier, round(avg(o_totalprice) / 1000.0, 1) AS average, count(*) AS runs
FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL GROUP BY 1""")
def avg_by_level(spark, d):
    done = table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_totalprice").isNotNull())
    return done.groupBy(F.col("o_orderpriority").alias("tier")).agg(F.round(F.avg("o_totalprice") / 1000.0, 1).alias("average"), F.count("*").alias("runs"))


@query("""SELECT p_name AS currency, round(sum(l_quantity), 2) AS gained FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_name ORDER BY gained DESC, currency LIMIT 20""")
def top_gains(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    told = rows.groupBy(F.col("p_name").alias("currency")).agg(F.round(F.sum("l_quantity"), 2).alias("gained"))
    return told.orderBy(F.col("gained").desc(), "currency").limit(20)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def latest_fifty(spark, d):
    newest = table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50)
    return newest.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT max(epoch(o_orderdate))::BIGINT AS newest, count(*) AS n, min(epoch(o_orderdate))::BIGINT AS oldest, round(sum(o_totalprice), 0) AS total FROM orders")
def global_summary(spark, d):
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").agg(F.max(at).alias("newest"), F.count("*").alias("n"), F.min(at).alias("oldest"), F.round(F.sum("o_totalprice"), 0).alias("total"))


@query("""SELECT 'events' AS table_name, count(*) AS row_count FROM events UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'part', count(*) FROM part""")
def schema_catalog(spark, d):
    told = catalog(spark, d, {"events": ("event_id",), "orders": ("o_orderkey",), "part": ("p_partkey",)})
    return told.where("primary_key").select("table_name", "row_count")


_SESSIONS = f"""WITH {VISITS},
f AS (SELECT *, max(ended_at) OVER (ORDER BY started_at, ended_at, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier FROM visits),
sessions AS (SELECT *, sum(CASE WHEN frontier IS NULL OR started_at - frontier > 300 THEN 1 ELSE 0 END)
  OVER (ORDER BY started_at, ended_at, visit_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM f)"""


@query(_SESSIONS + " SELECT visit_id, session_no FROM sessions")
def sessions_global(spark, d):
    return S.sessionize(visits(spark, d)).select("visit_id", "session_no")


@query(f"""WITH {VISITS},
f AS (SELECT *, max(ended_at) OVER (PARTITION BY actor ORDER BY started_at, ended_at, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier FROM visits)
SELECT visit_id, actor, sum(CASE WHEN frontier IS NULL OR started_at - frontier > 3600 THEN 1 ELSE 0 END)
  OVER (PARTITION BY actor ORDER BY started_at, ended_at, visit_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM f""")
def sessions_by_actor(spark, d):
    return S.sessionize(visits(spark, d), 3600, ("actor",)).select("visit_id", "actor", "session_no")


@query(_SESSIONS + """ SELECT session_no, min(started_at) AS started_at, max(ended_at) AS ended_at, sum(seconds)::BIGINT AS played_seconds,
greatest(max(ended_at) - min(started_at), 0) AS span_seconds, arg_min(day, (started_at, ended_at, visit_id)) AS day,
count(*) AS n_visits, count(DISTINCT actor) AS n_actors, sum(loot)::BIGINT AS loot FROM sessions GROUP BY session_no""")
def session_totals(spark, d):
    return S.session_totals(S.sessionize(visits(spark, d)), ("loot",))


@query(_SESSIONS + """, firsts AS (SELECT session_no, actor, place, min((started_at, ended_at, visit_id)) AS seen FROM sessions GROUP BY ALL),
places AS (SELECT session_no, actor, string_agg(place, ',' ORDER BY seen) AS places FROM firsts WHERE place <> '' GROUP BY ALL)
SELECT session_no, actor, sum(seconds)::BIGINT AS seconds, count(*) AS n_visits, max(level) AS level, any_value(places) AS places, sum(loot)::BIGINT AS loot
FROM sessions JOIN places USING (session_no, actor) GROUP BY session_no, actor""")
def session_cast(spark, d):
    return S.session_cast(S.sessionize(visits(spark, d)), ("loot",))


@query(f"""WITH {VISITS}, pp AS (SELECT actor, place, sum(seconds) AS spent FROM visits GROUP BY ALL),
pl AS (SELECT actor, string_agg(place, ',' ORDER BY spent DESC, place) AS places FROM pp GROUP BY actor)
SELECT actor, count(*) AS n_visits, sum(seconds)::BIGINT AS seconds, min(started_at) AS first_at, max(ended_at) AS last_at, max(level) AS level,
count(DISTINCT day) AS n_days, any_value(places) AS places, sum(loot)::BIGINT AS loot FROM visits JOIN pl USING (actor) GROUP BY actor""")
def actor_profile(spark, d):
    return S.actor_profile(visits(spark, d), ("loot",))


@query(f"""WITH {VISITS}, c AS (SELECT *, lag(day) OVER w IS DISTINCT FROM day OR row_number() OVER w = 1 AS changed FROM visits
WINDOW w AS (PARTITION BY actor ORDER BY started_at, visit_id))
SELECT visit_id, actor, day, sum(changed::INT) OVER (PARTITION BY actor ORDER BY started_at, visit_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island_no FROM c""")
def islands_by_day(spark, d):
    return S.islands(visits(spark, d), "day", ("actor",), ("started_at", "visit_id")).select("visit_id", "actor", "day", "island_no")


@query(f"""WITH {VISITS}, b AS (SELECT *, coalesce((min(started_at) OVER (PARTITION BY actor ORDER BY started_at DESC, visit_id DESC
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ended_at > 7200)::INT, 0) AS broken FROM visits),
c AS (SELECT *, max(broken) OVER (PARTITION BY actor ORDER BY started_at DESC, visit_id DESC ROWS UNBOUNDED PRECEDING) AS cut FROM b)
SELECT actor, count(*) AS n, min(started_at) AS started_at FROM c WHERE cut = 0 GROUP BY actor""")
def recent_chains(spark, d):
    return S.recent_chain(visits(spark, d), 7200).groupBy("actor").agg(F.count("*").alias("n"), F.min("started_at").alias("started_at"))


@query(f"""WITH {VISITS}, e AS (SELECT max(ended_at) AS now FROM visits)
SELECT visit_id, ended_at FROM visits, e WHERE coalesce(nullif(ended_at, 0), started_at, 0) >= now - 7 * 86400""")
def trailing_week(spark, d):
    v = visits(spark, d)
    now = v.agg(F.max("ended_at")).first()[0]  # callers pass their own clock; one scalar here
    return S.within_range(v, 7, now or 0).select("visit_id", "ended_at")


@query(_SESSIONS + """, k AS (
SELECT session_no, 'purchases' AS kind, 1 AS rank, count(*) AS weight, CASE WHEN count(*) = 1 THEN min(place) END AS label FROM sessions WHERE place = 'purchase' GROUP BY 1
UNION ALL SELECT session_no, 'errors', 2, count(*), CASE WHEN count(*) = 1 THEN min(place) END FROM sessions WHERE place = 'error' GROUP BY 1
UNION ALL SELECT session_no, 'loot', 3, sum(loot)::BIGINT, CASE WHEN count(*) = 1 THEN min(place) END FROM sessions GROUP BY 1 HAVING sum(loot) <> 0)
SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY rank, abs(weight) DESC, kind)::INT AS place FROM k""")
def session_highlights(spark, d):
    rows = S.sessionize(visits(spark, d)).withColumns({"label": F.col("place"), "amount": F.col("loot")})
    kinds = [("purchases", F.col("place") == "purchase", "count", 1), ("errors", F.col("place") == "error", "count", 2), ("loot", F.lit(True), "sum", 3)]
    return S.highlights_of(rows, kinds)


@query(_SESSIONS + """, k AS (
SELECT session_no, 'buys' AS kind, 1 AS rank, count(*) AS weight, CASE WHEN count(*) = 1 THEN min(place) END AS label FROM sessions WHERE place = 'purchase' GROUP BY 1
UNION ALL SELECT session_no, 'worth', 2, sum(loot)::BIGINT, CASE WHEN count(*) = 1 THEN min(place) END FROM sessions WHERE place = 'view' GROUP BY 1 HAVING sum(loot) <> 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY rank, abs(weight) DESC, kind)::INT AS place FROM k) WHERE place <= 1""")
def top_highlights(spark, d):
    """The first of each session, from kinds that come as tables of their own."""
    rows = S.sessionize(visits(spark, d)).withColumns({"label": F.col("place"), "amount": F.col("loot")})
    return S.highlights([("buys", rows.where("place = 'purchase'"), "count", 1), ("worth", rows.where("place = 'view'"), "sum", 2)], keep=1)


@query(f"""WITH {VISITS} SELECT place AS name, sum(loot - 500)::BIGINT AS amount FROM visits GROUP BY place ORDER BY abs(sum(loot - 500)) DESC, name""")
def totals_by_name(spark, d):
    told = visits(spark, d).groupBy(F.col("place").alias("name")).agg(F.sum(F.col("loot") - 500).alias("amount"))
    return told.orderBy(F.abs("amount").desc(), "name")


@query(f"""WITH {VISITS}, a AS (SELECT 'actor' AS spec, actor::VARCHAR AS name, seconds, loot FROM visits UNION ALL SELECT 'day', day, seconds, loot FROM visits)
SELECT spec, name, count(*) AS n, sum(seconds)::BIGINT AS seconds, sum(loot)::BIGINT AS loot FROM a GROUP BY ALL""")
def table_totals(spark, d):
    v = visits(spark, d)
    both = v.select(F.explode(F.array(F.struct(F.lit("actor").alias("spec"), F.col("actor").cast("string").alias("name")), F.struct(F.lit("day").alias("spec"), F.col("day").alias("name")))).alias("s"), "seconds", "loot")
    return both.groupBy("s.spec", "s.name").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"), F.sum("loot").alias("loot"))


@query(_SESSIONS + " SELECT session_no, actor, max(level) AS level FROM sessions WHERE level IS NOT NULL GROUP BY 1, 2")
def levels_reached(spark, d):
    return S.levels_reached(S.sessionize(visits(spark, d)))
