"""Catalogue questions over parts, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.operators import catalogue as C
from visitloom.plans.base import query
from visitloom.sources.tables import table


def _held(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_quantity")


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45) AS held FROM part")
def held_vs_catalogue(spark, d):
    return C.held_and_missing(table(spark, d, "part").select("p_partkey"), _held(spark, d), "p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def missing_parts(spark, d):
    return table(spark, d, "part").join(_held(spark, d), "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("""WITH t AS (SELECT *, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45) AS held FROM part),
m AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name, p_partkey) AS r FROM t WHERE NOT held),
l AS (SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY r) AS missing FROM m WHERE r <= 5 GROUP BY p_brand)
SELECT p_brand, count(*) FILTER (held) AS held, count(*) AS total, coalesce(sum(p_size) FILTER (held), 0)::BIGINT AS held_points,
sum(p_size)::BIGINT AS total_points, coalesce(any_value(missing), '') AS missing FROM t LEFT JOIN l USING (p_brand) GROUP BY p_brand""")
def points_by_category(spark, d):
    return C.by_category(table(spark, d, "part"), _held(spark, d), "p_partkey", "p_brand", "p_size", "p_name")


@query("SELECT sum(coalesce(p_size, l_quantity::BIGINT, 0))::BIGINT AS points, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON l_partkey = p_partkey WHERE l_quantity >= 45")
def points_earned(spark, d):
    worth = table(spark, d, "part").where("p_size > 10").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return C.points_earned(_held(spark, d).withColumn("l_quantity", F.col("l_quantity").cast("long")), worth, "p_partkey", "p_size", "l_quantity")


@query("""WITH c AS (SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE year(o_orderdate) % 3 <> 1 GROUP BY 1),
y AS (SELECT unnest(range((SELECT min(year) FROM c), (SELECT max(year) FROM c) + 1))::INT AS year)
SELECT year, coalesce(n, 0) AS n FROM y LEFT JOIN c USING (year)""")
def by_year_gapfilled(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).where("year % 3 <> 1")
    return C.by_year(o)


@query("""SELECT l_suppkey, count(*) AS earned, coalesce(sum(p_size), 0)::BIGINT AS points FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
WHERE l_quantity >= 45 GROUP BY l_suppkey""")
def carriers(spark, d):
    return C.carriers(_held(spark, d), table(spark, d, "part"), "p_partkey", "l_suppkey", "p_size")


@query("SELECT c_custkey, count(o_orderkey) AS n_children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def child_counts(spark, d):
    kids = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return C.with_child_counts(table(spark, d, "customer").select("c_custkey"), kids, "c_custkey")


@query("SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS reached_by FROM lineitem GROUP BY l_partkey")
def inverted_reach(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("s"))
    return C.inverted(rows, "l_partkey", "s").withColumn("reached_by", F.array_join("reached_by", ","))


@query("""SELECT o_orderkey, c_name, coalesce(n_name, '') AS n_name, coalesce(r_name, '') AS r_name FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def join_chain(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, d, "region")
    return C.chain(o, [(c, "c_custkey", {}), (n, "n_nationkey", {"n_name": ""}), (r, "r_regionkey", {"r_name": ""})]).select("o_orderkey", "c_name", "n_name", "r_name")


@query("""WITH t0 AS (SELECT l_partkey AS k, min(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30 GROUP BY 1),
t1 AS (SELECT l_partkey AS k, min(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 20 GROUP BY 1)
SELECT p_partkey AS k, coalesce(t0.a, t1.a, p_size::DOUBLE) AS a, CASE WHEN t0.a IS NOT NULL THEN 0 WHEN t1.a IS NOT NULL THEN 1 ELSE 2 END AS tier
FROM part LEFT JOIN t0 ON t0.k = p_partkey LEFT JOIN t1 ON t1.k = p_partkey""")
def fallback_cascade(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("a"), "l_returnflag")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("a"))
    return C.first_answer(p, [li.where("l_returnflag = 'R' and a > 30"), li.where("l_returnflag = 'A' and a > 20"), p], "k", "a")


@query("""SELECT n_nationkey, coalesce(r.r_regionkey, n2.k)::BIGINT AS icon FROM nation n
LEFT JOIN (SELECT lower(trim(r_name)) AS f, min(r_regionkey) AS r_regionkey FROM region WHERE r_regionkey <> 0 GROUP BY 1) r ON r.f = lower(trim(n.n_name))
LEFT JOIN (SELECT lower(trim(n_name)) AS f, min(n_regionkey) AS k FROM nation WHERE n_regionkey <> 0 GROUP BY 1) n2 ON n2.f = lower(trim(n.n_name))""")
def folded_names(spark, d):
    r = table(spark, d, "region").select(F.upper("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("icon"))
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit(" "), F.lower("n_name")).alias("name"), F.col("n_regionkey").cast("long").alias("icon"))
    return C.by_folded_name(n.select("n_nationkey", "name"), [r, n.select("name", "icon")], "name", "icon").select("n_nationkey", "icon")


@query("""WITH a AS (SELECT DISTINCT event_type AS activity FROM events), s AS (SELECT user_id AS actor, event_type AS activity, CASE WHEN count(*) > 20 THEN 'locked' ELSE 'partial' END AS state
FROM events WHERE value > 50 GROUP BY 1, 2)
SELECT u.actor, activity, coalesce(state, 'available') AS state FROM (SELECT DISTINCT user_id AS actor FROM events) u CROSS JOIN a LEFT JOIN s USING (actor, activity)""")
def lockout_grid(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("actor"), F.col("event_type").alias("activity"), "value")
    s = e.where("value > 50").groupBy("actor", "activity").agg(F.when(F.count("*") > 20, "locked").otherwise("partial").alias("state"))
    return C.grid(e.select("actor").distinct(), e.select("activity").distinct(), s, ["actor", "activity"])


@query("""SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type) - 1 AS n_siblings,
(SELECT min(q.p_partkey) FROM part q WHERE q.p_type = p.p_type AND q.p_partkey <> p.p_partkey) AS first_sibling FROM part p""")
def shape_siblings(spark, d):
    return C.siblings(table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey", "p_type")


def _looks(spark, d):
    p = table(spark, d, "part")
    items = p.select(F.col("p_partkey").alias("item"), (F.col("p_partkey") % 400).alias("look"), F.when(F.col("p_partkey") % 400 % 9 == 0, 0).otherwise(F.expr("shiftleft(1, p_size % 13)")).alias("mask"),
                     F.col("p_name").alias("name"), F.col("p_size").alias("required_level"))
    slots = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("set_id"), F.col("l_linenumber").alias("slot"), (F.col("l_partkey") % 400).alias("look")).distinct()
    return items, slots


_LOOKS = """WITH items AS (SELECT p_partkey AS item, p_partkey % 400 AS look, CASE WHEN p_partkey % 400 % 9 = 0 THEN 0 ELSE (1 << (p_size % 13)::INT) END::INT AS mask, p_name AS name, p_size AS required_level FROM part),
slots AS (SELECT DISTINCT l_orderkey % 500 AS set_id, l_linenumber AS slot, l_partkey % 400 AS look FROM lineitem)"""


@query(_LOOKS + """, lm AS (SELECT look, bit_or(CASE WHEN mask = 0 THEN 65535 ELSE mask END) AS mask FROM items GROUP BY look),
sm AS (SELECT set_id, slot, bit_or(mask) AS mask FROM slots JOIN lm USING (look) GROUP BY 1, 2)
SELECT set_id, bit_and(mask)::INT AS mask, count(*) AS n_slots FROM sm GROUP BY set_id""")
def set_cover_masks(spark, d):
    return C.set_wearers(*_looks(spark, d))


_OPEN = _LOOKS + """, lo AS (SELECT look, bool_or(mask IN (0, 65535)) AS open FROM items GROUP BY look),
so AS (SELECT set_id, slot, bool_or(open) AS open FROM slots JOIN lo USING (look) GROUP BY 1, 2),
op AS (SELECT set_id, count(*) FILTER (open) AS open_slots, count(*) AS slots, coalesce(string_agg(slot::VARCHAR, ',' ORDER BY slot) FILTER (NOT open), '') AS blocked,
count(*) FILTER (NOT open) AS nb FROM so GROUP BY set_id)"""


@query(_OPEN + """ SELECT set_id, open_slots, slots, blocked, CASE WHEN open_slots = slots THEN 'all' WHEN open_slots / slots >= 0.75 THEN 'most' WHEN open_slots > 0 THEN 'some' ELSE 'none' END AS words FROM op""")
def openness(spark, d):
    return C.set_openness(*_looks(spark, d)).withColumn("blocked", F.array_join("blocked", ","))


@query(_OPEN + " SELECT set_id, open_slots, blocked FROM op WHERE nb BETWEEN 1 AND 2 AND open_slots >= 1")
def near_miss_sets(spark, d):
    return C.near_misses(C.set_openness(*_looks(spark, d))).select("set_id", "open_slots", F.array_join("blocked", ",").alias("blocked"))


@query(_LOOKS + """ SELECT look, arg_min(item, (coalesce(name, '') = '', mask <> 0, required_level, item)) AS item, bool_or(mask = 0) AND bool_or(mask <> 0) AS lifts_restriction FROM items GROUP BY look""")
def representative_items(spark, d):
    return C.representative(_looks(spark, d)[0])


@query("""WITH m AS (SELECT l_orderkey AS set_id, list_sort(list_distinct(list(l_partkey % 3))) AS m FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey AS set_id, o_orderpriority, m FROM orders JOIN m ON o_orderkey = set_id),
f AS (SELECT m, arg_min(set_id, (o_orderpriority, set_id)) AS shown_id FROM t GROUP BY m)
SELECT set_id, shown_id, set_id <> shown_id AS folded FROM t JOIN f USING (m)""")
def dedupe_by_content(spark, d):
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("set_id"), (F.col("l_partkey") % 3).alias("member"))
    return C.fold_equal_sets(table(spark, d, "orders").select(F.col("o_orderkey").alias("set_id"), "o_orderpriority"), members, ["o_orderpriority"])


@query("""WITH r AS (SELECT p_type, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_type) AS n FROM part),
c AS (SELECT p_type, max(p_retailprice) FILTER (i = least(floor(n * 1 / 3)::BIGINT, n - 1)) AS c0, max(p_retailprice) FILTER (i = least(floor(n * 2 / 3)::BIGINT, n - 1)) AS c1 FROM r GROUP BY 1)
SELECT p_partkey, CASE WHEN p_retailprice < c0 THEN 'small' WHEN p_retailprice < c1 THEN 'medium' ELSE 'large' END AS band FROM part JOIN c USING (p_type)""")
def size_bands(spark, d):
    return C.bands(table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice"), "p_type", "p_retailprice").select("p_partkey", "band")


def _prints(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("slot"), C.sign_bits(F.col("embedding"), 64, 32).alias("bits"))


_BITS = "SELECT vec_id AS id, label AS slot, list_transform(embedding, lambda x: (x > 0)::INT) AS bits FROM embeddings"
_HAMMING = "list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] <> b.bits[i])::INT))::INT"


@query(f"""WITH p AS ({_BITS}), m AS (SELECT a.id, b.id AS other, {_HAMMING} AS distance FROM p a JOIN p b ON a.slot = b.slot AND a.id <> b.id WHERE a.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other)::INT AS rank FROM m) SELECT id, rank, other, distance FROM r WHERE rank <= 8""")
def hamming_knn(spark, d):
    p = _prints(spark, d)
    return C.nearest_by_bits(p, p.where("id % 100 = 0"), 64)


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY slot) AS n FROM ({_BITS})),
m AS (SELECT a.slot, {_HAMMING} AS d FROM p a JOIN p b ON a.slot = b.slot AND b.i = (a.i + greatest(a.n // 2, 1)) % a.n AND a.i <> b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY slot) AS n FROM m)
SELECT slot, max(d) FILTER (k = least(floor(n * 0.005)::BIGINT, n - 1) AND n >= 4) AS cut, count(*) AS n_pairs FROM r GROUP BY slot""")
def stranger_cuts(spark, d):
    def distance(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)

    return C.stranger_cut(_prints(spark, d), distance)


_TREE = """WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_partkey ELSE p_partkey // 4 END AS parent, p_brand AS name FROM part),
w(id, root, next, path, n) AS (SELECT id, id, parent, name, 0 FROM t UNION ALL
SELECT w.id, t.id, t.parent, t.name || '/' || w.path, n + 1 FROM w JOIN t ON w.next = t.id AND w.next <> w.root WHERE n < 8),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM w)"""


def _tree(spark, d):
    p = table(spark, d, "part")
    parent = F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 4).cast("long"))
    return p.select(F.col("p_partkey").alias("id"), parent.alias("parent"), F.col("p_brand").alias("name"), (F.col("p_size") % 3).alias("mask"), F.col("p_size").alias("ord"))


@query(_TREE + " SELECT id, root, path FROM last WHERE r = 1")
def hierarchy_path(spark, d):
    return C.paths(_tree(spark, d))


@query(_TREE.replace("n < 8", "n < 12") + """ SELECT root, min(p_type) AS subject, min(l.id) AS leaf FROM last l JOIN part ON p_partkey = l.id WHERE r = 1 GROUP BY root HAVING count(DISTINCT p_type) = 1""")
def unique_roots(spark, d):
    leaves = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("leaf"), F.col("p_type").alias("subject"))
    return C.unique_roots(leaves, _tree(spark, d))


@query(_TREE + """, s AS (SELECT l.id, root, p_size % 3 AS mask, p_size AS ord FROM last l JOIN part ON p_partkey = l.id WHERE r = 1)
SELECT root, mask, arg_min(id, (ord, id)) AS shown_id, min(ord) AS ord, count(*) AS n_sets FROM s GROUP BY root, mask""")
def family_fold(spark, d):
    return C.fold_families(_tree(spark, d))


@query("""SELECT coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END), ''), p_type) AS bucket, min(p_size) AS first_ord, count(*) AS n FROM part GROUP BY 1""")
def collection_groups(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_brand")).alias("c"), "p_type", F.col("p_size").alias("ord"))
    return C.group_by_collection(p, "c", "p_type")


@query("""WITH px AS (SELECT l_suppkey AS k, (l_partkey % 256)::INT AS r, ((l_partkey * 7) % 256)::INT AS g, (l_orderkey % 256)::INT AS b, l_quantity::BIGINT AS w FROM lineitem),
h AS (SELECT k, (r >> 4) * 17 AS r, (g >> 4) * 17 AS g, (b >> 4) * 17 AS b, sum(w)::BIGINT AS w FROM px GROUP BY ALL), c AS (SELECT *, r * 65536 + g * 256 + b AS rgb FROM h),
p AS (SELECT k, arg_max(rgb, (w, -rgb)) AS primary_rgb, arg_max(r, (w, -rgb)) AS pr, arg_max(g, (w, -rgb)) AS pg, arg_max(b, (w, -rgb)) AS pb FROM c GROUP BY k)
SELECT c.k, any_value(primary_rgb) AS primary_rgb, arg_max(rgb, (w, -rgb)) FILTER (abs(r - pr) + abs(g - pg) + abs(b - pb) >= 96) AS accent_rgb FROM c JOIN p USING (k) GROUP BY c.k""")
def colour_buckets(spark, d):
    li = table(spark, d, "lineitem")
    px = li.select(
        F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 256).cast("int").alias("r"), ((F.col("l_partkey") * 7) % 256).cast("int").alias("g"),
        (F.col("l_orderkey") % 256).cast("int").alias("b"), F.col("l_quantity").cast("long").alias("weight"),
    )
    return C.colour_buckets(px, "k")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(c_name, '') AS c_name, coalesce(n_name, '') AS n_name, coalesce(r_name, '') AS r_name, coalesce(p_size, 0) AS p_size
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) c ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey""")
def five_hops(spark, d):
    """Line to order to customer to nation to region, and to its part; what is missing on the way is '' or 0."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_custkey")
    c = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    hops = [
        (o, "l_orderkey", {"o_orderstatus": ""}), (c, "o_custkey", {"c_name": ""}), (n, "c_nationkey", {"n_name": ""}),
        (r, "n_regionkey", {"r_name": ""}), (p, "l_partkey", {"p_size": 0}),
    ]
    return C.chain(li, hops).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus", "c_name", "n_name", "r_name", "p_size")
