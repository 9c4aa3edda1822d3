"""Saved records and logs, rendered from the tables as the game writes them and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.operators import merge as M
from visitloom.operators import timeline as T
from visitloom.plans.base import VISITS, query
from visitloom.sources import combat_logs as L
from visitloom.sources import saved_records as R
from visitloom.sources.tables import table, visits


def _customers(spark, d):
    """Customers dealt to all cores: a text is parsed for much longer than its row takes to move, and few bytes hold many."""
    return table(spark, d, "customer").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")


def _saved(spark, d):
    """One saved-variable text for each customer, with a segment, markers, holdings and a census."""
    c = _customers(spark, d)
    body = F.format_string(
        'Saved = {\n  -- written by hand\n  ["segments"] = {\n    { ["id"] = "%d", ["character"] = "%s", ["level"] = %d, ["instance"] = %s, ["endedAt"] = %d,\n'
        '      ["quests"] = { { ["id"] = %d, ["name"] = "a \\"quoted\\" name" }, }, },\n    { ["id"] = "no end" },\n  },\n'
        '  ["entries"] = { { ["id"] = "m%d", ["at"] = %d, ["note"] = [[long; text]] }, { ["note"] = "no id" } },\n'
        '  ["characters"] = { ["%s"] = { ["gold"] = { ["total"] = %d, ["at"] = %d }, ["currencies"] = { ["%d"] = { ["name"] = "coin", ["total"] = %d, ["accountWide"] = %s }, ["junk"] = { ["total"] = 1 } },\n'
        '    ["factions"] = { ["%d"] = { ["name"] = "f", ["rank"] = %d } } } },\n}\n',
        F.col("c_custkey"), F.col("c_name"), F.col("c_custkey") % 80, F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))).otherwise("nil"),
        1_700_000_000 + F.col("c_custkey"), F.col("c_custkey") * 3, F.col("c_custkey"), F.col("c_custkey") + 7, F.col("c_name"), F.floor("c_acctbal").cast("long"), F.col("c_custkey"),
        F.col("c_nationkey") + 1000, F.col("c_custkey") * 2, F.when(F.col("c_nationkey") < 10, "true").otherwise("false"), F.col("c_nationkey") + 50, F.col("c_custkey") % 9,
    )
    return c.select("c_custkey", body.alias("text"))


@query("""SELECT c_custkey::VARCHAR AS id, c_name AS character, c_custkey % 80 AS level, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'Unknown' END AS instance,
1700000000 + c_custkey AS "startedAt", 0 AS seconds, strftime(make_timestamp((1700000000 + c_custkey) * 1000000), '%Y-%m-%d') AS day, c_custkey * 3 AS quest, 'a "quoted" name' AS quest_name FROM customer""")
def saved_segments(spark, d):
    told = R.parsed(_saved(spark, d), "text", "Saved", f"struct<segments: array<{R.SEGMENT}>>")
    one = R.normalise(told.select(F.explode("record.segments").alias("s")).select("s.*"))
    quests = R.events_of(one, "quests").select(F.col("segment_id").alias("id"), F.col("name").alias("quest_name"))
    known = one.select("id", "character", "level", "instance", "startedAt", "seconds", "day", F.get("quests", F.lit(0))["id"].alias("quest"))
    return known.join(quests, "id").select("id", "character", "level", "instance", "startedAt", "seconds", "day", "quest", "quest_name")


@query("""SELECT c_custkey, 0 AS position, 'm' || c_custkey AS id, c_custkey + 7 AS "at", 'long; text' AS note FROM customer""")
def saved_markers(spark, d):
    return R.markers(R.parsed(_saved(spark, d), "text", "Saved", R.MARKERS), "c_custkey").select("c_custkey", "position", "id", "at", "note")


@query("""SELECT c_custkey, 'gold' AS kind, NULL::BIGINT AS id, floor(c_acctbal)::BIGINT AS total, NULL::BOOLEAN AS shared FROM customer WHERE floor(c_acctbal) >= 0
UNION ALL SELECT c_custkey, 'currency', c_nationkey + 1000, c_custkey * 2, c_nationkey < 10 FROM customer
UNION ALL SELECT c_custkey, 'standing', c_nationkey + 50, c_custkey % 9, false FROM customer""")
def saved_holdings(spark, d):
    told = R.parsed(_saved(spark, d), "text", "Saved", R.HOLDINGS)
    none = F.lit(None)
    gold = R.wallets(told, "c_custkey").select("c_custkey", F.lit("gold").alias("kind"), none.cast("long").alias("id"), F.col("gold").alias("total"), none.cast("boolean").alias("shared"))
    money = R.held_currencies(told, "c_custkey").select("c_custkey", F.lit("currency").alias("kind"), F.col("currency_id").alias("id"), "total", "shared")
    rank = R.held_standings(told, "c_custkey").select("c_custkey", F.lit("standing").alias("kind"), F.col("faction_id").alias("id"), F.col("rank").alias("total"), "shared")
    return gold.unionByName(money).unionByName(rank)


def _census(spark, d):
    """A census text for each customer: mounts of the account, titles of a character, titles without owner."""
    c = _customers(spark, d)
    body = F.format_string(
        'Census = { ["account"] = { ["mounts"] = { ["complete"] = %s, ["held"] = 1, ["counted"] = %d, ["entries"] = { ["%d"] = { ["name"] = "m" }, ["x"] = {} } },\n'
        '  ["titles"] = { ["complete"] = true, ["entries"] = { ["5"] = {} } }, ["toys"] = { ["held"] = 2 } },\n'
        '  ["characters"] = { ["%s"] = { ["titles"] = { ["complete"] = true, ["revision"] = 3, ["entries"] = { ["%d"] = { ["count"] = 2 } } } } } }',
        F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false"), F.col("c_custkey") % 5, F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey") + 1,
    )
    return R.parsed(c.select("c_custkey", body.alias("text")), "text", "Census", R.CENSUS)


@query("""SELECT c_custkey, NULL AS character, 'mounts' AS domain, c_custkey % 2 = 0 AS complete, 0 AS revision, 1 AS held, c_custkey % 5 AS counted, false AS grow_only FROM customer
UNION ALL SELECT c_custkey, NULL, 'titles', true, 0, 0, NULL, false FROM customer UNION ALL SELECT c_custkey, NULL, 'toys', false, 0, 2, NULL, true FROM customer
UNION ALL SELECT c_custkey, c_name, 'titles', true, 3, 0, NULL, false FROM customer""")
def saved_claims(spark, d):
    return R.census_claims(_census(spark, d), "c_custkey")


@query("""SELECT c_custkey, NULL AS character, 'mounts' AS domain, c_custkey AS entry_id, 'm' AS name, 0 AS n FROM customer
UNION ALL SELECT c_custkey, c_name, 'titles', c_nationkey + 1, NULL, 2 FROM customer""")
def saved_census(spark, d):
    return R.census_entries(_census(spark, d), "c_custkey")


def _log(spark, d, events=None):
    """A combat-log line for each event: stamps with and without year, glued offsets, quotes, groups."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    local = F.date_format(F.col("t") + F.expr("make_dt_interval(0, 2, 0, 0)"), "M/d/yyyy HH:mm:ss.SSS")
    stamp = F.when(F.col("event_id") % 2 == 0, F.concat(local, F.lit("+2"))).otherwise(F.date_format("t", "M/d/yyyy HH:mm:ss.SSS"))
    guid = F.format_string("Player-%d", F.col("user_id"))
    flags = F.when(F.col("event_id") % 3 == 0, "0x511").otherwise("0x514")
    block = F.concat(guid, F.lit(",0000,10,20,1,2,3,4,0,5,6,7,8,"), F.format_string("%.2f", F.col("value")), F.lit(",-3.50,"), (F.col("event_id") % 50).cast("string"), F.lit(",1.25,70"))
    who = F.concat(guid, F.lit(',"A, name-Realm",'), flags, F.lit(",0x0"))
    swing = F.concat(F.lit("SWING_DAMAGE,"), who, F.lit(",Creature-1,nil,0x10a48,0x0,"), block)
    cast = F.concat(F.lit("SPELL_CAST_SUCCESS,Creature-1,nil,0xa48,0x0,"), who, F.lit(",17,\"Spell (Rank 1)\",0x2,"), block)
    info = F.concat(F.lit("COMBATANT_INFO,"), guid, F.lit(",1,10,20,"), (F.col("event_id") % 70).cast("string"), F.lit(",[(1,2,1),(3,4,1)],(0,0),[(100,"), (F.col("event_id") % 400).cast("string"), F.lit(",(),(11,12),()),(101,0,(),(),())],[]"))
    text = F.when(F.col("event_type") == "view", swing).when(F.col("event_type") == "click", cast).when(F.col("event_type") == "purchase", info).otherwise("junk without a comma")
    line = F.when(F.col("event_type") == "error", "no stamp at all").otherwise(F.concat(stamp, F.lit("  "), text))
    lines = e.select(F.format_string("log%d", F.col("user_id") % 7).alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))
    return L.parse(lines, 2024, events=events)


_LINES = """WITH e AS (SELECT *, 'log' || (user_id % 7) AS log, epoch_us(ts) // 1000 AS at_ms FROM events)"""


@query(_LINES + """ SELECT log, event_id AS line_no, at_ms, CASE event_type WHEN 'view' THEN 'SWING_DAMAGE' WHEN 'click' THEN 'SPELL_CAST_SUCCESS' ELSE 'COMBATANT_INFO' END AS event,
CASE event_type WHEN 'view' THEN 26 WHEN 'click' THEN 29 ELSE 9 END AS n_fields FROM e WHERE event_type IN ('view', 'click', 'purchase')""")
def log_lines(spark, d):
    return _log(spark, d).select("log", "line_no", "at_ms", "event", F.size("fields").alias("n_fields"))


@query(_LINES + """ SELECT log, event_id AS line_no, at_ms, 'Player-' || user_id AS guid, 'A, name-Realm' AS actor, printf('%.2f', value)::DOUBLE AS x, -3.5::DOUBLE AS y, event_id % 50 AS map_id, 1.25::DOUBLE AS facing
FROM e WHERE event_type IN ('view', 'click') AND event_id % 3 = 0""")
def log_positions(spark, d):
    return L.positions(_log(spark, d, tuple(L.ADVANCED)))


@query(_LINES + """ SELECT log, event_id AS line_no, 'Player-' || user_id AS guid, 1 AS faction, event_id % 70 AS spec_id, 2 AS n_talents, 2 AS n_worn,
CASE WHEN event_id % 400 > 0 THEN (event_id % 400)::DOUBLE END AS item_level, '11,12' AS bonus FROM e WHERE event_type = 'purchase'""")
def log_combatants(spark, d):
    told = L.combatants(_log(spark, d, ("COMBATANT_INFO",)))
    bonus = F.array_join(F.transform(F.get("worn", F.lit(0))["bonus"], lambda b: b.cast("string")), ",")
    return told.select("log", "line_no", "guid", "faction", "spec_id", "n_talents", F.size("worn").alias("n_worn"), "item_level", bonus.alias("bonus"))


@query(f"""WITH {VISITS}, f AS (SELECT actor % 5 AS log, visit_id AS line_no, CASE WHEN place = 'purchase' THEN 'encounter' ELSE 'keystone' END AS kind, CASE WHEN seconds < 990 THEN visit_id + seconds // 10 END AS last_line FROM visits WHERE place IN ('purchase', 'error')),
c AS (SELECT actor % 5 AS log, visit_id AS line_no, 'g' || actor AS guid FROM visits WHERE place IN ('view', 'click'))
SELECT c.log, c.line_no, guid, arg_max(kind, (kind = 'encounter', f.line_no)) AS fight_kind, arg_max(f.line_no, (kind = 'encounter', f.line_no)) AS fight_line
FROM c JOIN f ON c.log = f.log AND c.line_no >= f.line_no AND (last_line IS NULL OR c.line_no <= last_line) GROUP BY ALL""")
def attached_combatants(spark, d):
    """Purchases and errors as fights, the longest of them never closed; views and clicks as who took part."""
    v = visits(spark, d).withColumn("log", F.col("actor") % 5)
    kind = F.when(F.col("place") == "purchase", "encounter").otherwise("keystone")
    last = F.when(F.col("seconds") < 990, F.col("visit_id") + F.expr("seconds div 10"))
    fights = v.where("place in ('purchase', 'error')").select("log", F.col("visit_id").alias("line_no"), kind.alias("kind"), last.alias("last_line"))
    people = v.where("place in ('view', 'click')").select("log", F.col("visit_id").alias("line_no"), F.concat(F.lit("g"), "actor").alias("guid"))
    return L.attached(people, fights)


@query("""SELECT event_id, user_id FROM events WHERE event_id % 3 = 0 AND event_type = 'view'""")
def own_players(spark, d):
    e = table(spark, d, "events")
    flags = F.when(F.col("event_id") % 3 == 0, "0x511").otherwise("0x512")
    guid = F.concat(F.when(F.col("event_type") == "view", "Player-").otherwise("Pet-"), "user_id")
    return L.own_players(e.select("event_id", "user_id", flags.alias("flags"), guid.alias("guid"))).select("event_id", "user_id")


@query("""WITH marks AS (SELECT user_id AS log, event_type AS kind, event_id % 3 AS encounter_id, event_id AS line_no, floor(epoch(ts))::BIGINT AS t, CASE WHEN value < 50 THEN 'START' ELSE 'END' END AS mark FROM events),
l AS (SELECT *, sum(CASE mark WHEN 'START' THEN 1 ELSE -1 END) OVER (PARTITION BY log, kind, encounter_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) + (mark = 'END')::INT AS level FROM marks),
x AS (SELECT *, lead(mark) OVER w AS nm, lag(mark) OVER w AS pm, lead(t) OVER w AS nt FROM l WINDOW w AS (PARTITION BY log, kind, encounter_id, level ORDER BY line_no))
SELECT log, line_no, t AS started_at, CASE WHEN nm = 'END' THEN nt END AS ended_at FROM x WHERE mark = 'START' UNION ALL SELECT log, line_no, NULL, t FROM x WHERE mark = 'END' AND pm IS DISTINCT FROM 'START'""")
def stored_fights(spark, d):
    """Fights that an earlier read left open, closed by what a later read brings: the same as one read."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("log"), F.col("event_type").alias("kind"), (F.col("event_id") % 3).alias("encounter_id"), F.col("event_id").alias("line_no"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("value") < 50, "START").otherwise("END").alias("mark"), (F.col("value") > 75).alias("success"),
    )
    half = e.agg(F.expr("percentile_approx(line_no, 0.5)").alias("h")).first()["h"]
    stored = T.folded_fights(e.where(F.col("line_no") <= half))
    return T.close_open_fights(stored, e.where(F.col("line_no") > half)).select("log", "line_no", "started_at", "ended_at")


@query(f"""WITH {VISITS}, old AS (SELECT visit_id AS id, CASE WHEN level % 2 = 0 THEN level END AS level, CASE WHEN actor % 3 = 0 THEN 'unknown' ELSE place END AS kind FROM visits WHERE visit_id % 3 <> 0),
new AS (SELECT visit_id AS id, level + 1 AS level, CASE WHEN actor % 2 = 0 THEN 'unknown' ELSE 'fresh' END AS kind FROM visits WHERE visit_id % 3 <> 1)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN n.level ELSE coalesce(o.level, n.level) END AS level,
CASE WHEN o.id IS NULL THEN n.kind WHEN n.id IS NULL THEN o.kind WHEN n.kind <> 'unknown' THEN n.kind ELSE o.kind END AS kind FROM old o FULL JOIN new n ON o.id = n.id""")
def merge_fill_known(spark, d):
    v = visits(spark, d)
    old = v.where("visit_id % 3 <> 0").select(
        F.col("visit_id").alias("id"), F.when(F.col("level") % 2 == 0, F.col("level")).alias("level"), F.when(F.col("actor") % 3 == 0, "unknown").otherwise(F.col("place")).alias("kind")
    )
    new = v.where("visit_id % 3 <> 1").select(F.col("visit_id").alias("id"), (F.col("level") + 1).alias("level"), F.when(F.col("actor") % 2 == 0, "unknown").otherwise("fresh").alias("kind"))
    return M.upsert(old, new, ["id"], {"level": "fill", "kind": "known"})
