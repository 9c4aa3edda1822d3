"""Catalogue browsing, lockout texts and derived facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.functions import derive as D
from visitloom.functions import scalars as X
from visitloom.operators import nest as N
from visitloom.operators import search as Q
from visitloom.operators import shelves as S
from visitloom.plans.base import VISITS, query
from visitloom.sources.store import history_summary, lua_requests
from visitloom.sources.tables import table, visits


@query("""SELECT p_partkey, p_size % 20 IN (11, 12, 13, 14) AND p_partkey % 5 = 4 AND p_partkey % 7 = 6 AS shield,
p_size % 20 IN (11, 12, 13, 14) AND p_partkey % 5 = 4 AND p_partkey % 7 = 0 AS off_hand, p_size % 20 = 3 AS chest FROM part""")
def look_kinds(spark, d):
    of = (F.col("p_size") % 20, F.col("p_partkey") % 5, F.col("p_partkey") % 7)
    return table(spark, d, "part").select(
        "p_partkey", S.is_kind(S.SHIELD, *of).alias("shield"), S.is_kind(S.OFF_HAND, *of).alias("off_hand"), S.is_kind(S.Kind((3,)), *of).alias("chest")
    )


_SHELF = """WITH s AS (SELECT o_orderkey AS set_id, o_orderpriority AS name, o_orderstatus AS status, o_orderkey % 11 = 0 AS folded, o_custkey AS ord FROM orders),
b AS (SELECT l_orderkey AS set_id, count(*) FILTER (l_discount < 0.02) AS open_slots, list_sort(list(DISTINCT l_linenumber) FILTER (l_discount >= 0.02)) AS blocked FROM lineitem GROUP BY 1),
shelf AS (SELECT set_id, name, status, ord, open_slots, blocked, len(list_filter(blocked, lambda x: x % 2 = 0)) > 0 AS any_exact FROM s JOIN b USING (set_id)
WHERE NOT folded AND len(blocked) BETWEEN 1 AND 2 AND open_slots > 0)"""


def _shelf(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("set_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 11 == 0).alias("folded"), F.col("o_custkey").alias("ord")
    )
    far = F.col("l_discount") >= 0.02
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("set_id")).agg(
        F.count_if(~far).alias("open_slots"), F.array_sort(F.collect_set(F.when(far, F.col("l_linenumber")))).alias("blocked")
    )
    return S.shelf(o, b, F.col("slot") % 2 == 0)


@query(_SHELF + " SELECT set_id, len(blocked)::INT AS n_blocked, any_exact, open_slots FROM shelf ORDER BY n_blocked, any_exact DESC, ord, set_id")
def near_open_shelf(spark, d):
    return _shelf(spark, d).select("set_id", F.size("blocked").alias("n_blocked"), "any_exact", "open_slots")


@query(_SHELF + " SELECT set_id FROM shelf WHERE contains(lower(name || ' ' || status), 'urgent') AND contains(lower(name || ' ' || status), 'f')")
def shelf_search(spark, d):
    return S.search_words(_shelf(spark, d), " F  urgent ", [F.col("name"), F.col("status")]).select("set_id")


@query("""WITH m AS (SELECT p_partkey % 50 AS family, p_partkey AS set_id, p_partkey % 4 = 0 AS folded, p_name, p_brand, p_type FROM part),
said AS (SELECT family, bool_or(contains(lower(p_name), '1')) AS w, bool_or(contains(lower(p_brand), '#1')) AS b FROM m GROUP BY family),
marked AS (SELECT DISTINCT family FROM m WHERE NOT folded AND set_id % 3 = 0)
SELECT family FROM said JOIN marked USING (family) WHERE w AND b""")
def family_search(spark, d):
    m = table(spark, d, "part").select(
        (F.col("p_partkey") % 50).alias("family"), F.col("p_partkey").alias("set_id"), (F.col("p_partkey") % 4 == 0).alias("folded"), "p_name", "p_brand"
    )
    marks = m.select("set_id", (F.col("set_id") % 3 == 0).alias("favourite"), F.array().cast("array<struct<key:string,value:string>>").alias("tags"))
    return S.search_families(m.select("family").distinct(), m, "1 brand:#1", F.col("p_name"), F.array(Q.facet("brand", F.col("p_brand"))), marks, favourite=True)


@query("""WITH r AS (SELECT l_orderkey AS look, l_suppkey AS item, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'n' END AS name, CASE WHEN l_suppkey % 4 = 0 THEN 65535 WHEN l_suppkey % 4 = 1 THEN 0 ELSE 5 END AS mask FROM lineitem WHERE l_suppkey <> 0),
l AS (SELECT look, bool_or(mask = 65535) AS o, count(*) FILTER (mask <> 0) AS k, arg_min(item, (name = '', item)) FILTER (mask = 65535) AS item FROM r GROUP BY look)
SELECT o_custkey AS set_id, o_orderkey AS look, CASE WHEN o THEN 'open' WHEN coalesce(k, 0) > 0 THEN 'blocked' ELSE 'withheld' END AS state, CASE WHEN o THEN item END AS item
FROM orders LEFT JOIN l ON look = o_orderkey""")
def set_openings(spark, d):
    """A customer's orders as looks of a set, their lines as items; of some items nothing is known."""
    looks = table(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("look"))
    s = F.col("l_suppkey") % 4
    reached = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("look"), F.col("l_suppkey").alias("item"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise("n").alias("name"),
        F.when(s == 0, 65535).when(s == 1, 0).otherwise(5).alias("mask"),
    )
    return S.openings(looks, reached)


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN NULL ELSE p_name END AS title FROM part)
SELECT p_partkey, title, (SELECT count(*) FROM c) - (SELECT count(*) FROM c WHERE title <> '') AS withheld FROM c WHERE title <> ''""")
def named_catalogue(spark, d):
    title = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 != 1, F.col("p_name"))
    return S.catalogue_list(table(spark, d, "part").select("p_partkey", title.alias("title")), "title")


@query("""SELECT event_type, abs(approx - exact) <= greatest(0.1 * exact, 2) AS near FROM (SELECT event_type, count(DISTINCT user_id) AS exact, count(DISTINCT user_id) AS approx FROM events GROUP BY 1)""")
def collections_near(spark, d):
    e = table(spark, d, "events")
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    told = S.collections_approx(e, ["event_type"], "user_id").join(exact, "event_type")
    return told.select("event_type", (F.abs(F.col("n_approx") - F.col("exact")) <= F.greatest(F.col("exact") * 0.1, F.lit(2))).alias("near"))


_LOCKS = f"""WITH {VISITS}, k AS (SELECT visit_id, 'c' || actor AS character, place AS activity, CASE WHEN level % 3 = 0 THEN NULL ELSE 'd' || level END AS difficulty, ended_at AS expiry,
CASE WHEN visit_id % 5 = 0 THEN 'world_boss' WHEN visit_id % 5 = 1 THEN 'raid' WHEN visit_id % 5 = 2 THEN 'odd' END AS told, visit_id % 2 = 0 AS is_raid,
CASE visit_id % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'never' END AS period FROM visits)"""


def _locks(spark, d):
    v, i = visits(spark, d), F.col("visit_id")
    return v.select(
        i, F.concat(F.lit("c"), "actor").alias("character"), F.col("place").alias("activity"), F.when(F.col("level") % 3 != 0, F.concat(F.lit("d"), "level")).alias("difficulty"), F.col("ended_at").alias("expiry"),
        F.when(i % 5 == 0, "world_boss").when(i % 5 == 1, "raid").when(i % 5 == 2, "odd").alias("told"), (i % 2 == 0).alias("is_raid"), F.when(i % 4 == 0, "daily").when(i % 4 == 1, "never").alias("period"),
    )


@query(_LOCKS + """, x AS (SELECT *, CASE WHEN told IN ('world_boss', 'raid') THEN told WHEN is_raid THEN 'raid' ELSE 'dungeon' END AS kind FROM k)
SELECT visit_id, kind, CASE WHEN period = 'daily' THEN 'daily' WHEN kind = 'dungeon' THEN 'daily' ELSE 'weekly' END AS period,
expiry <= 1704500000 AS expired, CASE WHEN visit_id % 3 > 0 THEN (CASE WHEN visit_id % 3 = 2 THEN 1 ELSE 0 END) || '/' || (visit_id % 3) || ' bosses defeated' WHEN kind = 'world_boss' THEN 'Defeated' ELSE 'No boss data' END AS bosses FROM x""")
def lockout_facts(spark, d):
    none = F.lit(None)
    k = _locks(spark, d)
    kind = D.lockout_kind(none.cast("string"), F.col("told"), none.cast("boolean"), F.col("is_raid"))
    met = F.transform(F.sequence(F.lit(1), F.col("visit_id") % 3), lambda j: F.struct((j > 1).alias("killed")))
    k = k.withColumn("kind", kind).withColumn("period", D.lockout_period(F.col("period"), F.col("kind"))).withColumn("encounters", F.when(F.col("visit_id") % 3 > 0, met))
    return S.lockout_texts(k, 1704500000).select("visit_id", "kind", "period", "expired", "bosses")


@query(_LOCKS + """ SELECT visit_id, activity, character, difficulty, expiry FROM k ORDER BY activity DESC, character DESC, coalesce(difficulty, '') DESC, expiry""")
def lockout_order(spark, d):
    return S.sort_lockouts(_locks(spark, d), "activity", False).select("visit_id", "activity", "character", "difficulty", "expiry")


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Renown 7' WHEN 1 THEN 'Paragon' WHEN 2 THEN 'Pal' WHEN 3 THEN 'Honored' END AS standing,
CASE s_suppkey % 5 WHEN 0 THEN least(s_suppkey, 2500) WHEN 1 THEN s_suppkey * 7 % 1000 WHEN 2 THEN 1 WHEN 3 THEN least(greatest(s_suppkey - 30, 0), 100) END AS current,
CASE s_suppkey % 5 WHEN 0 THEN 2500 WHEN 1 THEN 1000 WHEN 2 THEN 1 WHEN 3 THEN 100 END AS max,
CASE s_suppkey % 5 WHEN 0 THEN 7 WHEN 1 THEN 6 WHEN 2 THEN s_suppkey WHEN 3 THEN 6 END AS rank,
CASE s_suppkey % 5 WHEN 0 THEN 'renown' WHEN 1 THEN 'paragon' WHEN 2 THEN 'friendship' WHEN 3 THEN 'reaction' END AS system FROM supplier""")
def faction_bars(spark, d):
    k, case = F.col("s_suppkey"), F.col("s_suppkey") % 5
    num = lambda v: F.lit(v).cast("long")
    renown = F.when(case == 0, F.struct(num(7).alias("level"), k.alias("earned"), num(2500).alias("threshold")))
    paragon = F.when(case == 1, F.struct((k * 7).alias("value"), num(1000).alias("threshold")))
    friend = F.when(case == 2, F.struct(num(9).alias("id"), F.lit("Pal").alias("reaction"), k.alias("standing"), num(500).alias("floor"), num(None).alias("ceiling")))
    faction = F.when(case != 4, F.struct(num(6).alias("reaction"), k.alias("standing"), num(30).alias("floor"), num(130).alias("ceiling")))
    told = table(spark, d, "supplier").select("s_suppkey", D.faction_standing(F.lit("Honored"), renown, paragon, friend, faction).alias("b"))
    return told.select("s_suppkey", "b.standing", "b.current", "b.max", "b.rank", "b.system")


@query(f"""WITH {VISITS}, a AS (SELECT visit_id, greatest(1704500000 - started_at, 0) AS s, strftime(make_timestamp(started_at * 1000000), '%Y-%m-%d') AS dd, actor, level FROM visits)
SELECT visit_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age,
CASE WHEN s < 45 THEN 'just now' WHEN s // 60 < 2 THEN 'a minute ago' WHEN s // 60 < 60 THEN (s // 60) || ' minutes ago' WHEN s // 3600 = 1 THEN 'an hour ago' WHEN s // 3600 < 24 THEN (s // 3600) || ' hours ago'
 WHEN s // 86400 = 1 THEN 'yesterday' ELSE (s // 86400) || ' days ago' END AS words,
CASE WHEN dd = '2024-01-06' THEN 'Today' WHEN dd = '2024-01-05' THEN 'Yesterday' WHEN dd LIKE '2024%' THEN strftime(dd::DATE, '%a, %-d %b') ELSE strftime(dd::DATE, '%a, %-d %b %Y') END AS day,
CASE WHEN actor % 2 = 0 THEN 'off' WHEN actor % 3 <> 0 THEN 'basic' WHEN level % 2 = 0 THEN 'advanced' ELSE 'stale' END AS status,
CASE WHEN actor % 3 = 0 THEN 'unwalked' WHEN level > actor % 7 THEN (level - actor % 7) || ' more counted' END AS note,
(actor % 7) || ' held at revision 2' || CASE WHEN level <> actor % 7 THEN '; ' || level || ' counted' ELSE '' END AS evidence FROM a""")
def told_facts(spark, d):
    a = visits(spark, d).withColumn("dd", F.date_format(F.timestamp_seconds("started_at"), "yyyy-MM-dd"))
    held = F.col("actor") % 7
    return a.select(
        "visit_id", D.age(F.lit(1704500000) - F.col("started_at")).alias("age"), D.ago_in_words(F.col("started_at"), 1704500000).alias("words"), D.day_label(F.col("dd"), "2024-01-06").alias("day"),
        D.install_status(F.col("actor") % 2 != 0, F.when(F.col("actor") % 3 == 0, True), F.col("level") % 2 == 0).alias("status"),
        D.collected_note(F.col("actor") % 3 != 0, held, F.col("level")).alias("note"),
        F.array_join(D.reading_evidence(held, F.lit(2), F.col("level")), "; ").alias("evidence"),
    )


@query("""SELECT p_partkey, 'Vendor: ' || p_brand || '. Zone: [' || p_type || '] here' AS source, p_name AS thing, p_size AS amount,
p_partkey & 255 AS points, CASE p_size % 3 WHEN 0 THEN 'Poor' WHEN 1 THEN 'Common' ELSE 'Uncommon' END AS quality, CASE WHEN p_size % 20 IN (1, 14) THEN 'Normal' WHEN p_size % 20 IN (2, 15) THEN 'Heroic' WHEN p_size % 20 = 8 THEN 'Mythic Keystone' WHEN p_size % 20 = 16 THEN 'Mythic' WHEN p_size % 20 = 17 THEN 'Looking For Raid' END AS difficulty,
substr(sha256(p_name), 1, 2) AS folder, sha256(p_name) AS digest,
array_to_string(list_filter(['Warrior', 'Paladin', 'Hunter'], lambda x, i: (p_size >> (i - 1)::INT) & 1 = 1), ',') AS classes FROM part""")
def game_texts(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.lit("|cFFFFD200Vendor: |r"), "p_brand", F.lit(".|n|n |T123:0|t Zone: |Hplace:1|h["), "p_type", F.lit("]|h here |"))
    said = D.parse_message(F.concat(F.lit("You receive (x) "), "p_name", F.lit(" x"), F.col("p_size").cast("string"), F.lit(".")), ["You lose %s.", "You receive (x) %s x%d."])
    folder, digest = D.content_name(F.col("p_name").cast("binary"))
    return p.select(
        "p_partkey", D.plain(raw).alias("source"), said["text"].alias("thing"), said["amount"].alias("amount"), D.points_of(F.col("p_partkey")).alias("points"),
        D.named(F.col("p_size") % 3, D.QUALITIES).alias("quality"), D.named(F.col("p_size") % 20, D.DIFFICULTIES).alias("difficulty"), folder.alias("folder"), digest.alias("digest"),
        F.array_join(X.class_names(F.col("p_size"), D.CLASSES[:3]), ",").alias("classes"),
    )


@query("""SELECT o_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber) AS slots FROM orders JOIN (SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_suppkey, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey GROUP BY 1""")
def worn_slots(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_suppkey", "l_partkey", "l_linenumber"))).alias("x"))
    slots = F.transform("x", lambda s: F.struct(s["l_linenumber"].alias("slot"), s["l_partkey"].alias("part")))
    told = li.withColumn("s", D.slots_in_order(slots)).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    text = F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["slot"].cast("string"), s["part"].cast("string"))), ",")
    return told.select(F.col("l_orderkey").alias("o_orderkey"), text.alias("slots"))


@query("""SELECT o_orderkey, string_agg('{"part":' || l_partkey || '}', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def copied_events(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s")).alias("e"))
    doc = li.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("e")).alias("found"))
    doc = doc.select("o_orderkey", F.array(F.struct(F.lit(1).alias("id"), F.lit("x").alias("other"), F.col("found"))).alias("events"))
    kept = D.copied(F.col("events"), ["id", ("found", ["part"])])
    told = doc.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi").withColumn("k", kept[0]["found"])
    return told.select("o_orderkey", F.array_join(F.transform("k", lambda e: F.to_json(e)), "").alias("items"))


@query("""SELECT p_partkey, [p_size, p_partkey]::BIGINT[] AS ids_list FROM (SELECT 1 AS p_partkey, 1 AS p_size WHERE false) UNION ALL
SELECT p_partkey, list_sort([p_size + 100, p_partkey + 1000]::BIGINT[]) FROM part""")
def integer_ids(spark, d):
    m = F.map_from_arrays(
        F.array((F.col("p_partkey") + 1000).cast("string"), F.lit("junk"), (F.col("p_size") + 100).cast("string")), F.array(F.lit(1), F.lit(2), F.lit(3))
    )
    return table(spark, d, "part").select("p_partkey", X.integer_keys(m).alias("ids_list"))


@query("""SELECT 'orders' AS used, max(n) AS most FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1)""")
def used_lists(spark, d):
    """Which lists of the nested orders any order fills: items do, notes do not."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    notes = items.where("l_linenumber < 0")
    doc = N.nest(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", {"items": (items, ["l_linenumber"]), "notes": (notes, ["l_linenumber"])})
    used = N.used_columns(doc, ["items", "notes"])
    return doc.agg(F.lit("orders").alias("used"), F.max(F.size(used[0])).cast("long").alias("most")).where(F.lit(used == ["items"]))


@query(f"""WITH {VISITS} SELECT count(*) AS segments, max(day) AS newest_day, (SELECT count(*) FROM customer) AS characters, (SELECT count(*) FROM part) AS captures FROM visits""")
def arriving_history(spark, d):
    return history_summary(visits(spark, d).withColumnRenamed("day", "ended_day"), table(spark, d, "customer"), table(spark, d, "part"))


@query("""WITH w AS (SELECT s_suppkey AS id, string_agg('{ ["slot"] = ' || n || ', ["appearance"] = ' || (s_suppkey * n) || CASE WHEN n = 2 THEN ', ["illusion"] = 5' ELSE '' END || ' }', ', ' ORDER BY n) AS slots FROM supplier, (VALUES (1), (2)) t(n) GROUP BY 1),
r AS (SELECT 1 AS part, id, '        { ["id"] = ' || id || ', ["name"] = "a ' || chr(92) || '"b' || chr(92) || '"' || '"' || CASE WHEN id % 2 = 0 THEN ', ["icon"] = ' || id ELSE '' END || ', ["slots"] = { ' || slots || ' } },' AS value FROM w),
f(part, id, value) AS (VALUES (0, 0, 'local _, ns = ...'), (0, 1, 'ns.customSetRequests = {'), (0, 2, '    ["issuedAt"] = 1704500000,'), (0, 3, '    ["requests"] = {'), (2, 0, '    },'), (2, 1, '}'))
SELECT row_number() OVER (ORDER BY part, id)::INT AS n, value FROM (SELECT * FROM r UNION ALL SELECT * FROM f)""")
def request_module(spark, d):
    s = table(spark, d, "supplier")
    requests = s.select(F.col("s_suppkey").alias("id"), F.lit('a "b"').alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("icon"))
    slots = s.select(F.col("s_suppkey").alias("request_id"), F.explode(F.array(F.lit(2), F.lit(1))).alias("slot"))
    slots = slots.select("*", (F.col("request_id") * F.col("slot")).alias("appearance"), F.lit(None).cast("long").alias("secondary"), F.when(F.col("slot") == 2, 5).alias("illusion"))
    return Q.placed(lua_requests(requests, slots, 1704500000), [F.col("ord")]).select(F.col("place").alias("n"), "value")
