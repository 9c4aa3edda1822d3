"""Visit summaries out of events, snapshots of what is held, walks, triggers and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.operators import tally as T
from visitloom.operators.timeline import sampled
from visitloom.plans.base import query
from visitloom.sources.tables import table

_E = """WITH e AS (SELECT event_id AS seq, user_id AS visit_id, floor(epoch(ts))::BIGINT AS "at", event_type AS kind, floor(value)::BIGINT AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("visit_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("kind"),
        F.floor("value").cast("long").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


@query(_E + """, r AS (SELECT *, greatest(v - lag(v) OVER (PARTITION BY visit_id ORDER BY "at", seq), 0) AS rise FROM e WHERE kind IN ('view', 'click'))
SELECT visit_id, coalesce(sum(rise), 0)::BIGINT AS money_gained, arg_max(v, ("at", seq)) AS wallet FROM r GROUP BY visit_id""")
def money_of_visits(spark, d):
    return T.money_gained(_events(spark, d).where("kind in ('view', 'click')").withColumnRenamed("v", "money"))


@query(_E + """, p AS (SELECT k AS item, arg_min(v, ("at", seq)) AS price FROM e WHERE kind = 'purchase' AND k % 3 > 0 GROUP BY 1)
SELECT visit_id, coalesce(sum((v % 5 + 1) * price), 0)::BIGINT AS loot_value, sum(v % 5 + 1)::BIGINT AS items, coalesce(sum(v % 5 + 1) FILTER (price IS NULL), 0)::BIGINT AS unpriced
FROM e LEFT JOIN p ON k = item WHERE kind = 'view' GROUP BY visit_id""")
def loot_of_visits(spark, d):
    """Prices may come after the drops: an item's price is joined whenever it was said."""
    e = _events(spark, d)
    drops = e.where("kind = 'view'").select("visit_id", F.col("k").alias("item"), (F.col("v") % 5 + 1).alias("quantity"))
    prices = e.where("kind = 'purchase' and k % 3 > 0").select(F.col("k").alias("item"), F.col("v").alias("price"), F.struct("at", "seq").alias("priced_at"))
    return T.loot_value(drops, prices)


@query(_E + """, x AS (SELECT visit_id, "at", seq, 10 + seq // 2000 AS level, v AS xp, 100 + k AS m FROM e),
l AS (SELECT *, lag(level) OVER w AS ll, lag(xp) OVER w AS lx, lag(m) OVER w AS lm FROM x WINDOW w AS (PARTITION BY visit_id ORDER BY "at", seq)),
g AS (SELECT *, CASE WHEN ll IS NULL THEN 0 WHEN level = ll THEN xp - lx WHEN level > ll THEN greatest(lm - lx, 0) + (level - ll - 1) * m + xp ELSE 0 END AS gained,
CASE WHEN level = ll THEN (xp - lx)::DOUBLE / lm WHEN level > ll THEN greatest(lm - lx, 0)::DOUBLE / lm + (level - ll - 1) + xp::DOUBLE / m ELSE 0 END AS share FROM l)
SELECT visit_id, sum(CASE WHEN gained > 0 THEN gained ELSE 0 END)::BIGINT AS gained, round(sum(CASE WHEN gained > 0 THEN share ELSE 0 END), 6) AS percent, arg_min(level, ("at", seq)) AS start_level, arg_max(level, ("at", seq)) AS end_level FROM g GROUP BY visit_id""")
def experience_of_visits(spark, d):
    e = _events(spark, d).select("visit_id", "at", "seq", F.expr("10 + seq div 2000").alias("level"), F.col("v").alias("xp"), (F.col("k") + 100).alias("xp_max"))
    return T.experience(e).withColumn("percent", F.round("percent", 6))


@query(_E + """, s AS (SELECT visit_id, max(("at", seq)) AS s, arg_max(k, ("at", seq)) AS level FROM e WHERE kind = 'click' GROUP BY 1),
f AS (SELECT s.visit_id, min((e."at", e.seq)) AS f, arg_min(v > 50, (e."at", e.seq)) AS ok FROM s JOIN e ON e.visit_id = s.visit_id AND e.kind = 'purchase' AND (e."at", e.seq) > s.s GROUP BY 1)
SELECT s.visit_id, level, s.s[1] AS started_at, f.f[1] AS completed_at, f.f IS NOT NULL AS completed, coalesce(ok, false) AS on_time, f.f[1] - s.s[1] AS seconds,
(SELECT count(*) FROM e WHERE e.visit_id = s.visit_id AND kind = 'view') AS views FROM s LEFT JOIN f USING (visit_id)""")
def runs_of_visits(spark, d):
    e = _events(spark, d)
    named = e.withColumn("kind", F.when(F.col("kind") == "click", "run_start").when(F.col("kind") == "purchase", "run_end").otherwise(F.col("kind")))
    named = named.select("visit_id", "at", "seq", "kind", F.col("k").alias("level"), (F.col("v") > 50).alias("success"))
    told = T.summary(T.run_lifecycle(named, "run"), [T.counted(named, {"views": "view"})])
    return told


@query(_E + """, r AS (SELECT visit_id % 20 AS owner, k, "at", seq, CASE WHEN seq % 5 = 0 THEN -1 ELSE v END AS total, CASE WHEN seq % 3 = 0 THEN 'n' || v END AS name, CASE WHEN seq % 4 = 0 THEN v > 50 END AS shared FROM e)
SELECT owner, k, arg_max(total, ("at", seq)) AS total, arg_max(name, ("at", seq)) FILTER (name IS NOT NULL) AS name, coalesce(arg_max(shared, ("at", seq)) FILTER (shared IS NOT NULL), false) AS shared, max("at") AS "at" FROM r WHERE total >= 0 GROUP BY 1, 2""")
def held_now(spark, d):
    e = _events(spark, d)
    r = e.select(
        (F.col("visit_id") % 20).alias("owner"), "k", "at", "seq", F.when(F.col("seq") % 5 == 0, -1).otherwise(F.col("v")).alias("total"),
        F.when(F.col("seq") % 3 == 0, F.concat(F.lit("n"), "v")).alias("name"), F.when(F.col("seq") % 4 == 0, F.col("v") > 50).alias("shared"),
    )
    return T.holdings(r, "owner", "k")


_WALK = _E + """, held AS (SELECT DISTINCT visit_id % 30 AS scope, k FROM e WHERE kind = 'view'), seen AS (SELECT DISTINCT visit_id % 30 AS scope, k + 5 AS k FROM e WHERE kind = 'click' AND visit_id % 30 > 5),
c AS (SELECT DISTINCT scope, scope % 2 = 0 AND scope IN (SELECT scope FROM seen) AS complete, scope % 3 = 0 AS grow_only FROM held)"""


def _walk(spark, d):
    e = _events(spark, d).withColumn("scope", F.col("visit_id") % 30)
    held = e.where("kind = 'view'").select("scope", "k").distinct()
    seen = e.where("kind = 'click' and scope > 5").select("scope", (F.col("k") + 5).alias("k"))
    claims = held.select("scope").distinct().select("scope", (F.col("scope") % 2 == 0).alias("complete"), (F.col("scope") % 3 == 0).alias("grow_only"))
    return T.swept(held, seen, claims, ["scope"], "k")


@query(_WALK + """ SELECT scope, k FROM held WHERE scope NOT IN (SELECT scope FROM c WHERE complete AND NOT grow_only) UNION SELECT scope, k FROM seen""")
def swept_walk(spark, d):
    return _walk(spark, d)[0]


@query(_WALK + """ SELECT scope, complete, grow_only, (SELECT count(*) FROM seen WHERE seen.scope = c.scope) AS observed FROM c""")
def believed_claims(spark, d):
    return _walk(spark, d)[1].select("scope", "complete", "grow_only", "observed")


@query("""SELECT o_orderkey AS request_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def pending_requests(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"))
    return T.pending(r, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("request_id")))


@query(_E + """ SELECT seq FROM e WHERE "at" >= (SELECT max("at") FROM e) - 7 * 86400""")
def retained_week(spark, d):
    e = _events(spark, d)
    return T.retained(e, "at", e.agg(F.max("at")).first()[0]).select("seq")


_TRIGGERS = _E + """, t AS (SELECT visit_id AS actor, "at", seq, CASE WHEN kind = 'view' THEN (CASE WHEN v > 70 THEN 'accountFirstAchievement' END) WHEN kind = 'click' THEN 'mount' WHEN kind = 'purchase' THEN (CASE WHEN v > 70 THEN 'keystoneOnTime' ELSE 'keystone' END) END AS trigger,
CASE WHEN kind = 'purchase' AND v <= 70 THEN 2 ELSE 1 END AS rank FROM e WHERE k % 4 <> 0), d AS (SELECT * FROM t WHERE trigger IS NOT NULL)"""
_ALLOWED = ["accountFirstAchievement", "mount", "keystoneOnTime", "keystone"]


def _decisions(spark, d):
    e = _events(spark, d)
    kind = F.when(F.col("kind") == "view", "achievement").when(F.col("kind") == "click", "mount").when(F.col("kind") == "purchase", "keystone").otherwise("other")
    named = e.select(F.col("visit_id").alias("actor"), "at", "seq", kind.alias("kind"), (F.col("v") > 70).alias("special"), (F.col("k") % 4 == 0).alias("obscured"))
    return T.triggered(named, _ALLOWED)


@query(_TRIGGERS + """, b AS (SELECT *, sum(CASE WHEN prev IS NULL OR "at" - prev > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY "at", seq ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM (SELECT *, lag("at") OVER (PARTITION BY actor ORDER BY "at", seq) AS prev FROM d))
SELECT actor, burst, min("at") AS "at", arg_min(trigger, (rank, "at", seq)) AS trigger, arg_min(seq, (rank, "at", seq)) AS seq, count(*) AS n FROM b GROUP BY 1, 2""")
def trigger_bursts(spark, d):
    return T.bursts(_decisions(spark, d), gap=3600)


@query(_TRIGGERS.replace("WITH e", "WITH RECURSIVE e") + """, p AS (SELECT actor, "at", seq, row_number() OVER (PARTITION BY actor ORDER BY "at", seq) AS n FROM d),
f(actor, n, seq, kept, last) AS (SELECT actor, n, seq, true, "at" FROM p WHERE n = 1 UNION ALL SELECT p.actor, p.n, p.seq, p."at" - last >= 86400, CASE WHEN p."at" - last >= 86400 THEN p."at" ELSE last END FROM f JOIN p ON p.actor = f.actor AND p.n = f.n + 1)
SELECT actor, seq FROM f WHERE kept""")
def cooled_triggers(spark, d):
    """Pictures at least a day apart: whether one is taken depends on the last one taken."""
    told = _decisions(spark, d).select("actor", F.col("at").alias("at_ms"), "seq", F.lit("all").alias("place"))
    return sampled(told, "actor", 86_400).select("actor", "seq")


@query(_E + """ SELECT visit_id, 'f' || (k % 5) AS faction, sum(v)::BIGINT AS amount, arg_max(CASE WHEN v % 3 > 0 THEN v % 7 END, ("at", seq)) FILTER (v % 3 > 0) AS standing FROM e WHERE kind = 'view' GROUP BY ALL""")
def reputation_of_visits(spark, d):
    e = _events(spark, d).where("kind = 'view'")
    return T.reputation(e.select("visit_id", "at", "seq", F.concat(F.lit("f"), F.col("k") % 5).alias("faction"), F.col("v").alias("amount"), F.when(F.col("v") % 3 > 0, F.col("v") % 7).alias("standing")))


@query(_E + """, c AS (SELECT *, k % 6 AS currency, v % 9 - 4 AS change, CASE v % 4 WHEN 0 THEN '' WHEN 1 THEN 'gold ' || v END AS name FROM e WHERE kind IN ('click', 'purchase'))
SELECT visit_id, currency, coalesce(arg_max(name, ("at", seq)) FILTER (name <> ''), currency::VARCHAR) AS name, sum(change)::BIGINT AS amount, arg_max(v, ("at", seq)) FILTER (v % 2 = 0) AS total
FROM c WHERE change <> 0 GROUP BY visit_id, currency""")
def currencies_of_visits(spark, d):
    e, v = _events(spark, d).where("kind IN ('click', 'purchase')"), F.col("v")
    name = F.when(v % 4 == 0, "").when(v % 4 == 1, F.concat(F.lit("gold "), v))
    return T.currencies(e.select("visit_id", "at", "seq", (F.col("k") % 6).alias("currency"), (v % 9 - 4).alias("change"), name.alias("name"), F.when(v % 2 == 0, v).alias("total")))


@query(_E + """, r AS (SELECT visit_id, "at", seq, k % 4 AS item, v // 10 AS total FROM e WHERE kind = 'click'),
o AS (SELECT DISTINCT visit_id, 1 AS item, 5 AS held FROM r),
c AS (SELECT r.*, total - coalesce(lag(total) OVER (PARTITION BY visit_id, item ORDER BY "at", seq), held, total) AS change FROM r LEFT JOIN o USING (visit_id, item))
SELECT visit_id, item, item::VARCHAR AS name, sum(change)::BIGINT AS amount, arg_max(total, ("at", seq)) AS total FROM c WHERE change <> 0 GROUP BY visit_id, item""")
def item_currencies_of_visits(spark, d):
    r = _events(spark, d).where("kind = 'click'").select("visit_id", "at", "seq", (F.col("k") % 4).alias("item"), F.expr("v div 10").alias("total"), F.lit(None).cast("string").alias("name"))
    return T.item_currencies(r, r.select("visit_id", F.lit(1).cast("long").alias("item"), F.lit(5).cast("long").alias("held")).distinct())


_RUNS = """, k0 AS (SELECT visit_id, "at", seq, CASE kind WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'reset' END AS kind, CASE WHEN v % 5 > 0 THEN k END AS level, v FROM e)"""


def _runs(spark, d):
    kind = F.when(F.col("kind") == "click", "start").when(F.col("kind") == "purchase", "complete").when(F.col("kind") == "error", "reset")
    return _events(spark, d).select("visit_id", "at", "seq", kind.alias("kind"), F.when(F.col("v") % 5 > 0, F.col("k")).alias("level"), "v")


@query(_E + _RUNS + """, o AS (SELECT visit_id, coalesce(max(("at", seq)) FILTER (kind = 'start' AND level IS NOT NULL), min(("at", seq)) FILTER (kind = 'complete')) AS o FROM k0 GROUP BY 1),
r AS (SELECT k0.*, o FROM k0 JOIN o USING (visit_id) WHERE (k0."at", k0.seq) >= o AND (kind IN ('complete', 'reset') OR kind = 'start' AND level IS NOT NULL)),
g AS (SELECT visit_id, arg_max(level, ("at", seq)) FILTER (level IS NOT NULL AND kind <> 'reset') AS level, any_value(o[1]) AS started_at, coalesce(arg_max(kind, ("at", seq)) FILTER (kind <> 'start') = 'complete', false) AS completed,
max("at") FILTER (kind = 'complete') AS e_at, arg_max(v, ("at", seq)) FILTER (kind = 'complete') AS v FROM r GROUP BY visit_id)
SELECT visit_id, level, started_at, completed, CASE WHEN completed THEN e_at END AS completed_at, CASE WHEN completed THEN v > 50 END AS on_time FROM g""")
def keystones_of_visits(spark, d):
    none = F.lit(None).cast("long")
    r = _runs(spark, d)
    level = F.when(F.col("kind") != "reset", F.col("level"))
    told = T.keystone(r.select("visit_id", "at", "seq", "kind", level.alias("level"), none.alias("map"), F.col("v").alias("duration_ms"), (F.col("v") > 50).alias("on_time"), none.alias("upgrades")))
    return told.select("visit_id", "level", "started_at", "completed", "completed_at", "on_time")


@query(_E + _RUNS + """, o AS (SELECT visit_id, min(("at", seq)) AS o FROM k0 WHERE kind = 'start' GROUP BY 1)
SELECT visit_id, arg_max(level, ("at", seq)) FILTER (level IS NOT NULL) AS tier, any_value(o[1]) AS started_at, count(*) FILTER (kind = 'complete') > 0 AS completed, max("at") FILTER (kind = 'complete') AS completed_at
FROM k0 JOIN o USING (visit_id) WHERE ("at", seq) >= o AND kind IN ('start', 'complete') GROUP BY visit_id""")
def delves_of_visits(spark, d):
    r = _runs(spark, d)
    return T.delve(r.select("visit_id", "at", "seq", "kind", F.col("level").alias("tier"), F.lit(None).cast("string").alias("scenario"))).drop("scenario")


@query(_E + """ SELECT visit_id, seq AS set_id, CASE k % 3 WHEN 0 THEN 'updated' WHEN 1 THEN 'added' ELSE 'removed' END AS kind, (row_number() OVER (PARTITION BY visit_id ORDER BY "at", seq) - 1)::INT AS position
FROM e WHERE kind = 'error' AND NOT (k % 3 = 0 AND v % 2 = 0)""")
def equipset_changes_of_visits(spark, d):
    e = _events(spark, d).where("kind = 'error'")
    kind = F.when(F.col("k") % 3 == 0, "updated").when(F.col("k") % 3 == 1, "added").otherwise("removed")
    items = F.when(F.col("v") % 2 == 1, F.array("k")).otherwise(F.array().cast("array<bigint>"))
    return T.equipset_changes(e.select("visit_id", "at", "seq", F.col("seq").alias("set_id"), kind.alias("kind"), items.alias("items"))).select("visit_id", "set_id", "kind", "position")


_MET = """, m AS (SELECT visit_id, "at", seq, CASE kind WHEN 'view' THEN 'achievement' WHEN 'click' THEN 'quest' WHEN 'error' THEN 'housing_xp' ELSE kind END AS kind,
CASE WHEN v % 7 > 0 THEN k END AS id, CASE k % 3 WHEN 0 THEN 'name ' || k WHEN 1 THEN '' END AS name, CASE v % 3 WHEN 0 THEN true WHEN 1 THEN false END AS first FROM e)"""


def _met(spark, d):
    kind = F.when(F.col("kind") == "view", "achievement").when(F.col("kind") == "click", "quest").when(F.col("kind") == "error", "housing_xp").otherwise(F.col("kind"))
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("name "), F.col("k"))).when(F.col("k") % 3 == 1, "")
    first = F.when(F.col("v") % 3 == 0, True).when(F.col("v") % 3 == 1, False)
    return _events(spark, d).select("visit_id", "at", "seq", kind.alias("kind"), F.when(F.col("v") % 7 > 0, F.col("k")).alias("id"), name.alias("name"), first.alias("first"))


@query(_E + _MET + """ SELECT visit_id, kind, (row_number() OVER (PARTITION BY visit_id, kind ORDER BY "at", seq) - 1)::BIGINT AS position, id,
CASE WHEN kind = 'achievement' THEN coalesce(name, id::VARCHAR) ELSE nullif(name, '') END AS name, first, "at" FROM m WHERE id IS NOT NULL AND kind IN ('achievement', 'quest')""")
def collected_in_visits(spark, d):
    return T.collected(_met(spark, d), ("achievement",), ("quest",))


@query(_E + _MET + """ SELECT visit_id, coalesce(sum(id) FILTER (kind = 'housing_xp'), 0)::BIGINT AS housing_xp, count(*) FILTER (kind = 'quest' AND id IS NOT NULL) AS quests,
count(*) FILTER (kind = 'achievement' AND id IS NOT NULL) AS achievements FROM m GROUP BY visit_id HAVING housing_xp <> 0 OR quests + achievements > 0""")
def visits_worth_keeping(spark, d):
    """A visit's counts and sums, without the visits in which nothing happened."""
    met = _met(spark, d)
    sums = T.added(met, {"housing_xp": "housing_xp"}, "id")
    counts = T.counted(met.where("id is not null"), {"quests": "quest", "achievements": "achievement"})
    told = T.summary(met.select("visit_id").distinct(), [sums, counts]).na.fill(0)
    return T.has_events(told, [sums.where("housing_xp <> 0"), counts.where("quests + achievements > 0")])
