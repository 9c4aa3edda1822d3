"""Search, scalar functions and text cleaning over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.functions import scalars as X
from visitloom.operators import search as Q
from visitloom.plans.base import VISITS, query
from visitloom.sources.tables import table, visits


@query("""SELECT doc_id FROM documents WHERE lower(lang) LIKE '%en%' AND contains(lower(source), 'src1') AND contains(lower(text), 'the') AND contains(lower(text), 'tion')""")
def facet_search(spark, d):
    facets = F.array(Q.facet("lang", F.col("lang")), Q.facet("source", F.col("source")))
    return table(spark, d, "documents").where(Q.matches('lang:en source:src1 "the" tion', F.col("text"), facets)).select("doc_id")


@query("""SELECT c_custkey FROM customer WHERE (contains(lower(c_name), '00') OR contains(lower(c_mktsegment), '00')) AND c_nationkey = 7""")
def ledger_filter(spark, d):
    return table(spark, d, "customer").where((F.col("c_nationkey") == 7) & Q.any_field_contains(["c_name", "c_mktsegment"], " 00 ")).select("c_custkey")


@query("""SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND contains(lower(p_type), 'a') AND p_partkey % 2 = 0""")
def marked_rows(spark, d):
    p = table(spark, d, "part")
    marks = p.where("p_partkey % 3 = 0").select(
        "p_partkey", (F.col("p_partkey") % 2 == 0).alias("favourite"), F.array(F.struct(F.lit("Type").alias("key"), F.col("p_type").alias("value"))).alias("tags")
    )
    return Q.with_marks(p, marks, "p_partkey", favourite=True, tag="type:a").select("p_partkey")


@query("""SELECT lower(p_brand) AS key_fold, min(p_brand) AS spelling, string_agg(DISTINCT lower(p_type), ',' ORDER BY lower(p_type)) AS choices, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1""")
def tag_choices(spark, d):
    tags = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("key"), F.col("p_type").alias("value"))
    return Q.tag_choices(tags).withColumn("choices", F.array_join("choices", ","))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[\x00-\x1F\x7F]', '', 'g')) AS cleaned,
CASE WHEN length(text) > 40 THEN text[1:40] || '…' ELSE text END AS clip FROM conversations""")
def clean_turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.collapse(F.col("text")).alias("cleaned"), X.clipped(F.col("text"), 40).alias("clip"))


@query(f"""WITH {VISITS} SELECT visit_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h' ELSE (s // 86400)::VARCHAR || 'd' END AS age,
CASE WHEN seconds >= 3600 THEN (seconds // 3600)::VARCHAR || 'h ' || (seconds % 3600 // 60)::VARCHAR || 'm' WHEN seconds >= 60 THEN (seconds // 60)::VARCHAR || 'm ' || (seconds % 60)::VARCHAR || 's' ELSE seconds::VARCHAR || 's' END AS spent,
CASE WHEN c < 0 THEN '-' ELSE '' END || (abs(c) // 10000)::VARCHAR || 'g ' || (abs(c) % 10000 // 100)::VARCHAR || 's ' || (abs(c) % 100)::VARCHAR || 'c' AS money
FROM (SELECT *, greatest(1706000000 - started_at, 0) AS s, loot * 37 - 200000 AS c FROM visits)""")
def visit_texts(spark, d):
    v = visits(spark, d)
    return v.select("visit_id", X.ago(F.col("started_at"), 1706000000).alias("age"), X.duration(F.col("seconds")).alias("spent"), X.gold(F.col("loot") * 37 - 200000).alias("money"))


@query("""SELECT o_orderkey, split_part(k, '-', 1) AS name, CASE WHEN contains(k, '-') THEN k[position('-' IN k) + 1:] ELSE '' END AS realm
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority || '-x' END AS k FROM orders)""")
def split_keys(spark, d):
    k = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.concat("o_orderpriority", F.lit("-x")))
    name, realm = X.split_key(k)
    return table(spark, d, "orders").select("o_orderkey", name.alias("name"), realm.alias("realm"))


@query("""WITH t AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'Prey: ' || p_name || ' (' || p_brand || ')' WHEN 1 THEN 'Prey: ' || p_name WHEN 2 THEN ' Prey: A (b) (C) ' ELSE p_name END AS q FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN trim(q[7:position(' (' IN q)]) WHEN 1 THEN trim(q[7:]) WHEN 2 THEN 'A (b)' END AS title, CASE p_partkey % 4 WHEN 0 THEN split_part(split_part(q, '(', 2), ')', 1) WHEN 2 THEN 'C' END AS difficulty FROM t""")
def hunt_titles(spark, d):
    p = table(spark, d, "part")
    m = F.col("p_partkey") % 4
    q = F.when(m == 0, F.concat(F.lit("Prey: "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))).when(m == 1, F.concat(F.lit("Prey: "), "p_name")).when(m == 2, F.lit(" Prey: A (b) (C) ")).otherwise(F.col("p_name"))
    title, level = X.hunt(q)
    return p.select("p_partkey", title.alias("title"), level.alias("difficulty"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE WHEN y0 <> y1 THEN (y0 - l_quantity) / (y0 - y1) END AS map_x, CASE WHEN x0 <> x1 THEN (x0 - l_extendedprice) / (x0 - x1) END AS map_y
FROM (SELECT *, 100.0::DOUBLE AS y0, (l_linenumber * 25)::DOUBLE AS y1, 1000.0::DOUBLE AS x0, 90000.0::DOUBLE AS x1 FROM lineitem)""")
def map_coordinates(spark, d):
    li = table(spark, d, "lineitem")
    x, y = X.normalised(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(1000.0), F.lit(90000.0), F.lit(100.0), (F.col("l_linenumber") * 25).cast("double"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", x.alias("map_x"), y.alias("map_y"))


_RGB = "SELECT p_partkey, r, g, b, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT p_partkey, (p_partkey * 37 % 256) / 255.0::DOUBLE AS r, (p_partkey * 91 % 256) / 255.0::DOUBLE AS g, (p_partkey * 13 % 256) / 255.0::DOUBLE AS b FROM part)"


@query(f"""WITH c AS ({_RGB}), h AS (SELECT *, (hi + lo) / 2 AS l, hi - lo AS s0, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN 60 * ((((g - b) / (hi - lo)) + 6) % 6) WHEN hi = g THEN 60 * ((b - r) / (hi - lo) + 2) ELSE 60 * ((r - g) / (hi - lo) + 4) END AS hue FROM c),
s AS (SELECT *, CASE WHEN s0 = 0 THEN 0 ELSE s0 / (1 - abs(2 * l - 1)) END AS sat FROM h)
SELECT p_partkey, CASE WHEN l < 0.08 THEN 'black' WHEN l > 0.92 THEN 'white' WHEN sat < 0.12 THEN 'grey' WHEN hue BETWEEN 15 AND 45 AND l < 0.42 THEN 'brown' WHEN hue < 15 THEN 'red' WHEN hue < 45 THEN 'orange' WHEN hue < 70 THEN 'yellow'
WHEN hue < 165 THEN 'green' WHEN hue < 200 THEN 'cyan' WHEN hue < 255 THEN 'blue' WHEN hue < 290 THEN 'purple' WHEN hue < 345 THEN 'pink' ELSE 'red' END AS colour FROM s""")
def colour_names(spark, d):
    k = F.col("p_partkey")
    two = lambda n: F.lpad(F.hex((k * n % 256).cast("long")), 2, "0")
    return table(spark, d, "part").select("p_partkey", X.colour_name(F.concat(two(37), two(91), two(13))).alias("colour"))


@query("""SELECT p_partkey, (m = 0 OR m = 65535 OR m & 4 <> 0) AS wearable, bit_count(xor(m, 5))::INT AS differing, ('0x' || lower(to_hex(m)))::VARCHAR AS flags FROM (SELECT p_partkey, (p_partkey % 16)::INT AS m FROM part)""")
def mask_tests(spark, d):
    m = (F.col("p_partkey") % 16).cast("int")
    return table(spark, d, "part").select(
        "p_partkey", X.has_bit(m, 2).alias("wearable"), F.bit_count(m.bitwiseXOR(5)).alias("differing"), F.concat(F.lit("0x"), F.lower(F.hex(X.from_hex(F.concat(F.lit("0X"), F.hex(m.cast("long"))))))).alias("flags")
    )


@query("""SELECT event_id, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', 2000 + y, m, d) END AS day FROM (SELECT event_id, (event_id % 30)::INT AS y, (event_id % 14)::INT AS m, (event_id % 33)::INT AS d FROM events)""")
def calendar_days(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", X.calendar_day((k % 30).cast("int"), (k % 14).cast("int"), (k % 33).cast("int")).alias("day"))
