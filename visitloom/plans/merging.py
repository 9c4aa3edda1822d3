"""Latest readings, merges, ledgers and nested documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.operators import latest as L
from visitloom.operators import merge as M
from visitloom.plans.base import VISITS, query
from visitloom.sources.tables import table, visits


@query("""SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price, lag(o_orderstatus) OVER w AS status_before, o_orderstatus AS status
FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def slot_ledger(spark, d):
    w = W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"), F.lag("o_orderstatus").over(w).alias("status_before"), F.col("o_orderstatus").alias("status")
    )


_READINGS = f"""WITH {VISITS},
shallow AS (SELECT actor, place AS pot, loot AS total, ended_at AS "at" FROM visits),
deep AS (SELECT user_id AS actor, event_type AS pot, floor(value)::BIGINT AS total, floor(epoch(ts))::BIGINT + 86400 * (event_id % 3 - 1) AS "at" FROM events)"""


def _readings(spark, d):
    shallow = visits(spark, d).select("actor", F.col("place").alias("pot"), F.col("loot").alias("total"), F.col("ended_at").alias("at"))
    e = table(spark, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp")) + 86400 * (F.col("event_id") % 3 - 1)
    deep = e.select(F.col("user_id").alias("actor"), F.col("event_type").alias("pot"), F.floor("value").cast("long").alias("total"), at.alias("at"))
    return shallow, deep


@query(_READINGS + """, u AS (SELECT *, 0 AS depth FROM shallow UNION ALL SELECT *, 1 FROM deep)
SELECT actor, pot, total, "at", depth FROM (SELECT *, row_number() OVER (PARTITION BY actor, pot ORDER BY coalesce("at", 0) DESC, depth DESC, total DESC) AS rn FROM u) WHERE rn = 1""")
def freshest_reading(spark, d):
    return L.freshest(list(_readings(spark, d)), ["actor", "pot"]).select("actor", "pot", "total", "at", "depth")


@query(_READINGS + """, u AS (SELECT *, 0 AS depth FROM shallow UNION ALL SELECT *, 1 FROM deep),
f AS (SELECT actor, pot, total, "at" FROM (SELECT *, row_number() OVER (PARTITION BY actor, pot ORDER BY coalesce("at", 0) DESC, depth DESC, total DESC) AS rn FROM u) WHERE rn = 1)
SELECT pot, CASE WHEN pot IN ('purchase', 'error') THEN arg_max(total, (coalesce("at", -1), -actor)) ELSE sum(total)::BIGINT END AS total,
min("at") AS oldest, pot IN ('purchase', 'error') AS shared, count(*) AS n_readings FROM f GROUP BY pot""")
def one_pot_rollup(spark, d):
    fresh = L.freshest(list(_readings(spark, d)), ["actor", "pot"])
    return L.one_pot(fresh.withColumn("shared", F.col("pot").isin("purchase", "error")))


@query(f"""WITH {VISITS}, s AS (SELECT place AS subject, actor, CASE level % 3 WHEN 0 THEN 'renown' WHEN 1 THEN 'friend' ELSE 'paragon' END AS ladder,
CASE WHEN loot % 7 = 0 THEN NULL ELSE level END AS rank, loot AS current, visit_id FROM visits),
u AS (SELECT * FROM s WHERE rank IS NOT NULL),
c AS (SELECT subject, ladder, count(*) AS n FROM u GROUP BY subject, ladder),
m AS (SELECT subject, ladder FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, ladder) AS r FROM c) WHERE r = 1)
SELECT subject, ladder, rank, current, actor FROM (SELECT u.*, row_number() OVER (PARTITION BY subject ORDER BY rank DESC, current DESC, actor) AS r FROM u JOIN m USING (subject, ladder)) WHERE r = 1""")
def modal_best(spark, d):
    ladder = F.when(F.col("level") % 3 == 0, "renown").when(F.col("level") % 3 == 1, "friend").otherwise("paragon")
    s = visits(spark, d).select(
        F.col("place").alias("subject"), "actor", ladder.alias("ladder"), F.when(F.col("loot") % 7 != 0, F.col("level")).alias("rank"), F.col("loot").alias("current")
    )
    return L.modal_best(s).select("subject", "ladder", "rank", "current", "actor")


@query(f"""WITH {VISITS}, w AS (SELECT loot AS gold, ended_at AS "at" FROM visits UNION ALL SELECT seconds, started_at FROM visits WHERE place = 'purchase')
SELECT sum(gold)::BIGINT AS gold, min("at") AS oldest, count(*) AS n_readings FROM w WHERE gold IS NOT NULL""")
def account_gold(spark, d):
    v = visits(spark, d)
    return L.account_gold(
        v.select(F.col("loot").alias("gold"), F.col("ended_at").alias("at")),
        v.where("place = 'purchase'").select(F.col("seconds").alias("gold"), F.col("started_at").alias("at")),
    )


@query(f"""WITH {VISITS}, s AS (SELECT actor, place AS activity, level AS difficulty, ended_at AS expires_at, loot % 8 AS killed, 6 AS total FROM visits)
SELECT actor, activity, max(expires_at) AS expires_at, arg_max(killed, (expires_at, killed, -difficulty)) AS killed, 6 AS total,
arg_max(difficulty, (expires_at, killed, -difficulty)) AS difficulty,
CASE WHEN max(expires_at) <= 1704500000 THEN 'available' WHEN arg_max(killed, (expires_at, killed, -difficulty)) >= 6 THEN 'locked' ELSE 'partial' END AS state
FROM s GROUP BY actor, activity""")
def lockout_states(spark, d):
    s = visits(spark, d).select(
        "actor", F.col("place").alias("activity"), F.col("level").alias("difficulty"), F.col("ended_at").alias("expires_at"), (F.col("loot") % 8).alias("killed"), F.lit(6).alias("total")
    )
    return L.latest_lockouts(s, 1704500000)


@query(f"""WITH {VISITS} SELECT actor, sum(seconds)::BIGINT AS seconds, arg_max(level, visit_id) FILTER (level IS NOT NULL) AS level,
string_agg(place, ',' ORDER BY visit_id) AS places FROM visits GROUP BY actor""")
def merged_summaries(spark, d):
    parts = visits(spark, d).select("actor", "visit_id", "seconds", "level", F.array("place").alias("places"))
    told = L.merge_summaries(parts, "actor", "visit_id", ["seconds"], ["level"], ["places"])
    return told.withColumn("places", F.array_join("places", ","))


_HALVES = f"""WITH {VISITS}, old AS (SELECT actor, place, min(level) AS level, sum(loot)::BIGINT AS loot, bool_or(loot > 900) AS flag FROM visits WHERE visit_id % 3 <> 0 GROUP BY 1, 2),
new AS (SELECT actor, place, CASE WHEN max(level) % 2 = 0 THEN max(level) END AS level, sum(loot)::BIGINT AS loot, bool_or(loot > 950) AS flag FROM visits WHERE visit_id % 3 <> 1 GROUP BY 1, 2)"""


def _halves(spark, d):
    v = visits(spark, d)
    old = v.where("visit_id % 3 <> 0").groupBy("actor", "place").agg(F.min("level").alias("level"), F.sum("loot").alias("loot"), F.bool_or(F.col("loot") > 900).alias("flag"))
    new = v.where("visit_id % 3 <> 1").groupBy("actor", "place").agg(
        F.when(F.max("level") % 2 == 0, F.max("level")).alias("level"), F.sum("loot").alias("loot"), F.bool_or(F.col("loot") > 950).alias("flag")
    )
    return old, new


@query(_HALVES + """ SELECT coalesce(n.actor, o.actor) AS actor, coalesce(n.place, o.place) AS place, CASE WHEN n.actor IS NULL THEN o.level ELSE n.level END AS level,
CASE WHEN n.actor IS NULL THEN o.loot ELSE n.loot END AS loot, CASE WHEN n.actor IS NULL THEN o.flag ELSE n.flag END AS flag
FROM old o FULL JOIN new n ON o.actor = n.actor AND o.place = n.place""")
def merge_upsert(spark, d):
    return M.upsert(*_halves(spark, d), ["actor", "place"])


@query(_HALVES + """ SELECT coalesce(n.actor, o.actor) AS actor, coalesce(n.place, o.place) AS place, coalesce(n.level, o.level) AS level,
coalesce(o.loot, 0) + coalesce(n.loot, 0) AS loot, coalesce(o.flag, false) OR coalesce(n.flag, false) AS flag
FROM old o FULL JOIN new n ON o.actor = n.actor AND o.place = n.place""")
def merge_rules(spark, d):
    return M.upsert(*_halves(spark, d), ["actor", "place"], {"level": "coalesce", "loot": "add", "flag": "sticky"})


@query(_HALVES + " SELECT count(*) FILTER (o.actor IS NULL) AS added, count(*) FILTER (o.actor IS NOT NULL) AS updated FROM new n LEFT JOIN old o USING (actor, place)")
def merge_counts(spark, d):
    return M.change_counts(*_halves(spark, d), ["actor", "place"])


@query(_HALVES + " SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.actor = n.actor AND o.place = n.place)")
def merge_ignore(spark, d):
    return M.insert_new(*_halves(spark, d), ["actor", "place"])


@query(_HALVES + " SELECT * FROM old WHERE actor NOT IN (SELECT actor FROM new WHERE actor % 2 = 0) UNION ALL SELECT * FROM new WHERE actor % 2 = 0")
def merge_replace_group(spark, d):
    old, new = _halves(spark, d)
    return M.replace_groups(old, new.where("actor % 2 = 0"), ["actor"])


@query(_HALVES + " SELECT * FROM old o WHERE actor % 2 = 1 OR EXISTS (SELECT 1 FROM new n WHERE n.actor = o.actor AND n.place = o.place)")
def prune_if_complete(spark, d):
    old, new = _halves(spark, d)
    claims = old.select("actor").distinct().withColumn("complete", F.col("actor") % 2 == 0)
    return M.prune_if_complete(old, new, claims, ["actor"], "place")


@query(f"""WITH {VISITS}, r AS (SELECT DISTINCT actor AS request_id, CASE WHEN actor % 5 = 0 THEN 'kept' END AS outcome FROM visits),
o AS (SELECT actor AS request_id, arg_min(place, visit_id) AS f FROM visits WHERE actor % 3 <> 0 GROUP BY actor)
SELECT request_id, coalesce(outcome, f) AS outcome FROM r LEFT JOIN o USING (request_id)""")
def first_outcomes(spark, d):
    v = visits(spark, d)
    requests = v.select(F.col("actor").alias("request_id"), F.when(F.col("actor") % 5 == 0, F.lit("kept")).alias("outcome")).distinct()
    outcomes = v.where("actor % 3 <> 0").select(F.col("actor").alias("request_id"), F.col("place").alias("outcome"), F.col("visit_id").alias("seq"))
    return M.first_outcome(requests, outcomes)


@query(f"WITH {VISITS} SELECT visit_id, place FROM visits WHERE visit_id NOT IN (SELECT visit_id FROM visits WHERE place = 'error')")
def tombstones(spark, d):
    v = visits(spark, d)
    return M.bury(v, v.where("place = 'error'"), "visit_id").select("visit_id", "place")


@query(f"""WITH {VISITS} SELECT visit_id, place AS kind FROM visits WHERE NOT (visit_id % 4 = 0 AND place = 'view')
UNION ALL SELECT visit_id, 'manual' FROM visits WHERE visit_id % 100 = 0""")
def suppressions(spark, d):
    inferred = visits(spark, d).select("visit_id", F.col("place").alias("kind"))
    manual = inferred.where("visit_id % 100 = 0").withColumn("kind", F.lit("manual"))
    return M.suppress(inferred, manual, inferred.where("visit_id % 4 = 0 and kind = 'view'"), ["visit_id", "kind"])


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 10 <> 0""")
def cascade_delete(spark, d):
    tables = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    rules = [("customer", "c_custkey", "orders", "o_custkey", "delete"), ("orders", "o_orderkey", "lineitem", "l_orderkey", "delete")]
    left = M.cascade(
        {"customer": tables["customer"].select("c_custkey"), "orders": tables["orders"].select("o_orderkey", "o_custkey"), "lineitem": tables["lineitem"]},
        tables["customer"].where("c_custkey % 10 = 0"), "customer", rules,
    )
    known = left["lineitem"].join(tables["orders"].select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return known.select("l_orderkey", "l_linenumber", "l_quantity")


@query(_HALVES + """ SELECT coalesce(n.actor, o.actor) AS actor, coalesce(n.place, o.place) AS place,
CASE WHEN o.actor IS NULL THEN 'created' WHEN n.actor IS NULL THEN 'deleted' ELSE 'updated' END AS change,
o.level AS level_before, o.loot AS loot_before, n.level AS level_after, n.loot AS loot_after
FROM old o FULL JOIN new n ON o.actor = n.actor AND o.place = n.place
WHERE o.actor IS NULL OR n.actor IS NULL OR o.level IS DISTINCT FROM n.level OR o.loot IS DISTINCT FROM n.loot""")
def snapshot_diff(spark, d):
    return M.snapshot_diff(*_halves(spark, d), ["actor", "place"], ["level", "loot"])


@query("""SELECT o_orderkey, count(l_orderkey) AS n_items, coalesce(string_agg(l_partkey::VARCHAR || 'x' || (l_quantity::BIGINT)::VARCHAR, ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), '') AS items
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def nested_orders(spark, d):
    from visitloom.operators.nest import nest

    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    doc = nest(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", {"items": (items, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])})
    text = F.transform("items", lambda x: F.concat_ws("x", x["l_partkey"].cast("string"), x["l_quantity"].cast("long").cast("string")))
    return doc.select("o_orderkey", F.size("items").cast("long").alias("n_items"), F.array_join(text, ";").alias("items"))
