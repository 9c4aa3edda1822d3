"""Range joins, windows and folds over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.operators import ranges as R
from visitloom.operators import timeline as T
from visitloom.plans.base import VISITS, query
from visitloom.sources.tables import table, visits


def _spans(spark, d):
    return visits(spark, d).where("place in ('view', 'click')").select(
        F.col("visit_id").alias("span_id"), F.col("started_at").alias("lo"), F.col("ended_at").alias("hi"), F.col("actor").alias("name")
    )


def _points(spark, d, place):
    return visits(spark, d).where(F.col("place") == place).select(F.col("visit_id").alias("point_id"), F.col("started_at").alias("at"), F.col("actor").alias("name"))


_SPANS = f"WITH {VISITS}, s AS (SELECT visit_id AS span_id, started_at AS lo, ended_at AS hi, actor AS name FROM visits WHERE place IN ('view', 'click')), "


@query(_SPANS + """p AS (SELECT visit_id AS point_id, started_at AS t, actor AS name FROM visits WHERE place = 'purchase'),
m AS (SELECT point_id, arg_max(span_id, ((p.name = s.name)::INT, lo, span_id)) AS span_id FROM p JOIN s ON t BETWEEN lo AND hi GROUP BY point_id)
SELECT p.point_id, span_id FROM p LEFT JOIN m USING (point_id)""")
def link_points_to_visits(spark, d):
    return R.link_points(_points(spark, d, "purchase"), _spans(spark, d)).select("point_id", "span_id")


@query(_SPANS + """f AS (SELECT visit_id AS fight_id, started_at AS a, ended_at AS b FROM visits WHERE place = 'error'),
m AS (SELECT fight_id, least(b, hi) - greatest(a, lo) AS overlap, span_id, row_number() OVER (PARTITION BY fight_id ORDER BY least(b, hi) - greatest(a, lo) DESC, lo DESC, span_id DESC) AS r FROM f JOIN s ON a <= hi AND b >= lo)
SELECT f.fight_id, span_id, overlap FROM f LEFT JOIN m ON m.fight_id = f.fight_id AND r = 1""")
def link_by_overlap(spark, d):
    f = visits(spark, d).where("place = 'error'").select(F.col("visit_id").alias("fight_id"), F.col("started_at").alias("a"), F.col("ended_at").alias("b"))
    return R.link_overlaps(f, _spans(spark, d)).select("fight_id", "span_id", "overlap")


@query(f"""WITH {VISITS}, m AS (SELECT visit_id AS moment_id, started_at AS t, level % 5 AS k FROM visits WHERE place = 'error'),
p AS (SELECT visit_id AS point_id, started_at AS u, level % 5 AS k FROM visits WHERE place = 'view'),
b AS (SELECT moment_id, point_id, abs(t - u) AS gap, row_number() OVER (PARTITION BY moment_id ORDER BY abs(t - u), u, point_id) AS r FROM m JOIN p ON m.k = p.k AND abs(t - u) <= 900)
SELECT m.moment_id, point_id, gap FROM m LEFT JOIN b ON b.moment_id = m.moment_id AND r = 1""")
def place_nearest(spark, d):
    v = visits(spark, d).withColumn("place_key", F.col("level") % 5)
    m = v.where("place = 'error'").select(F.col("visit_id").alias("moment_id"), F.col("started_at").alias("at"), "place_key")
    p = v.where("place = 'view'").select(F.col("visit_id").alias("point_id"), F.col("started_at").alias("at"), "place_key")
    return R.place_nearest(m, p, 900).select("moment_id", "point_id", "gap")


@query(f"""WITH {VISITS} SELECT visit_id AS point_id, started_at FROM visits v WHERE place = 'view' AND (started_at >= 1704900000 OR
EXISTS (SELECT 1 FROM visits p WHERE p.place = 'purchase' AND abs(p.started_at - v.started_at) <= 120))""")
def compact_unanchored(spark, d):
    kept = R.drop_unanchored(_points(spark, d, "view"), _points(spark, d, "purchase"), 120, 1704900000)
    return kept.select("point_id", F.col("at").alias("started_at"))


@query(f"""WITH {VISITS}, e AS (SELECT min(started_at) AS lo, max(ended_at) AS hi FROM visits WHERE place = 'purchase')
SELECT visit_id AS point_id FROM visits, e WHERE place = 'view' AND started_at BETWEEN lo AND hi""")
def bounded_points(spark, d):
    s = visits(spark, d).where("place = 'purchase'").select(F.col("started_at").alias("lo"), F.col("ended_at").alias("hi"))
    return R.bounded(_points(spark, d, "view"), s).select("point_id")


@query(f"""WITH {VISITS}, m AS (SELECT visit_id AS moment_id, started_at // 60 AS t FROM visits WHERE place = 'error'),
f AS (SELECT visit_id AS file_id, started_at // 60 AS t FROM visits WHERE place = 'purchase'),
p0 AS (SELECT moment_id, file_id, 0 AS slip FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY moment_id) AS n FROM m) a JOIN (SELECT *, row_number() OVER (PARTITION BY t ORDER BY file_id) AS n FROM f) b USING (t, n)),
m1 AS (SELECT * FROM m WHERE moment_id NOT IN (SELECT moment_id FROM p0)), f1 AS (SELECT * FROM f WHERE file_id NOT IN (SELECT file_id FROM p0)),
p1 AS (SELECT moment_id, file_id, 1 AS slip FROM (SELECT moment_id, t + 1 AS t, row_number() OVER (PARTITION BY t ORDER BY moment_id) AS n FROM m1) a JOIN (SELECT *, row_number() OVER (PARTITION BY t ORDER BY file_id) AS n FROM f1) b USING (t, n)),
m2 AS (SELECT * FROM m1 WHERE moment_id NOT IN (SELECT moment_id FROM p1)), f2 AS (SELECT * FROM f1 WHERE file_id NOT IN (SELECT file_id FROM p1)),
p2 AS (SELECT moment_id, file_id, -1 AS slip FROM (SELECT moment_id, t - 1 AS t, row_number() OVER (PARTITION BY t ORDER BY moment_id) AS n FROM m2) a JOIN (SELECT *, row_number() OVER (PARTITION BY t ORDER BY file_id) AS n FROM f2) b USING (t, n))
SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2""")
def paired_stamps(spark, d):
    minute = F.floor(F.col("started_at") / 60)
    v = visits(spark, d)
    m = v.where("place = 'error'").select(F.col("visit_id").alias("moment_id"), minute.alias("at"))
    f = v.where("place = 'purchase'").select(F.col("visit_id").alias("file_id"), minute.alias("at"))
    return R.pair_stamps(m, f)


_PULLS = f"WITH {VISITS}, pulls AS (SELECT visit_id AS pull_id, actor AS segment_id, place AS encounter_id, started_at AS t, level % 2 AS difficulty, loot > 900 AS success FROM visits)"


def _pulls(spark, d):
    return visits(spark, d).select(
        F.col("visit_id").alias("pull_id"), F.col("actor").alias("segment_id"), F.col("place").alias("encounter_id"), F.col("started_at").alias("at"),
        (F.col("level") % 2).alias("difficulty"), (F.col("loot") > 900).alias("success"),
    )


@query(_PULLS + """, g AS (SELECT *, (lag(t) OVER w IS NULL OR t - lag(t) OVER w > 3600 OR lag(difficulty) OVER w IS DISTINCT FROM difficulty)::INT AS f FROM pulls
WINDOW w AS (PARTITION BY segment_id, encounter_id ORDER BY t, pull_id)),
n AS (SELECT *, sum(f) OVER (PARTITION BY segment_id, encounter_id ORDER BY t, pull_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT segment_id, encounter_id, min(pull_id) AS pull_id, min(t) AS started_at, max(t) AS "at", arg_max(difficulty, (t, pull_id)) AS difficulty, bool_or(success) AS success, count(*) AS n_pulls
FROM n GROUP BY segment_id, encounter_id, k""")
def rearmed_pulls(spark, d):
    return T.rearmed(_pulls(spark, d), gap=3600)


@query(_PULLS + """, k AS (SELECT *, bool_or(success) OVER (PARTITION BY segment_id, encounter_id) AS won, row_number() OVER (PARTITION BY segment_id, encounter_id ORDER BY t DESC, pull_id DESC) AS r FROM pulls),
c AS (SELECT pull_id, success, NOT won AND segment_id % 2 = 0 AND r = 1 AS credited FROM k) SELECT pull_id, credited, success OR credited AS success FROM c""")
def credited_pulls(spark, d):
    p = _pulls(spark, d)
    return T.credited(p, p.where("segment_id % 2 = 0")).select("pull_id", "credited", "success")


_LINES = """WITH lines AS (SELECT user_id AS log, event_id AS line_no, (epoch_us(ts) // 1000) AS at_ms, event_type, value, month(ts) AS m, CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 5 = 0 THEN 12 ELSE 6 END AS month FROM events)"""


def _lines(spark, d):
    e = table(spark, d, "events")
    month = F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 5 == 0, 12).otherwise(6)
    return e.select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_type", "value", month.alias("month"))


@query(_LINES + """ SELECT log, line_no, (2020 + sum(coalesce((p = 12 AND month = 1)::INT, 0)) OVER (PARTITION BY log ORDER BY line_no ROWS UNBOUNDED PRECEDING))::BIGINT AS year
FROM (SELECT *, lag(month) OVER (PARTITION BY log ORDER BY line_no) AS p FROM lines)""")
def clock_rollover(spark, d):
    return T.with_years(_lines(spark, d), "log", 2020).select("log", "line_no", F.col("year").cast("long").alias("year"))


@query(_LINES + """ SELECT log, line_no, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY log ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS bounds FROM lines""")
def asof_marker(spark, d):
    lines = _lines(spark, d).withColumn("is_map", F.col("event_type") == "purchase")
    return T.latest_before(lines, "log", "is_map", "value", "bounds").select("log", "line_no", "bounds")


@query(_LINES + """, n AS (SELECT log, line_no, row_number() OVER (PARTITION BY log ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY log) AS n FROM lines)
SELECT log, line_no FROM n WHERE i % ceil(n / 12.0)::BIGINT = 0 OR i = n - 1""")
def thinned_ticks(spark, d):
    return T.thinned(_lines(spark, d), "log", "line_no").select("log", "line_no")


@query("""WITH RECURSIVE p AS (SELECT user_id AS log, (epoch_us(ts) // 1000) AS at_ms, event_id, event_type AS place, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
f(log, n, event_id, kept, last_at, last_place) AS (SELECT log, n, event_id, true, at_ms, place FROM p WHERE n = 1 UNION ALL
SELECT p.log, p.n, p.event_id, p.at_ms - last_at >= 86400000 OR p.place <> last_place,
CASE WHEN p.at_ms - last_at >= 86400000 OR p.place <> last_place THEN p.at_ms ELSE last_at END, CASE WHEN p.at_ms - last_at >= 86400000 OR p.place <> last_place THEN p.place ELSE last_place END
FROM f JOIN p ON p.log = f.log AND p.n = f.n + 1)
SELECT log, event_id FROM f WHERE kept""")
def sampled_positions(spark, d):
    p = _lines(spark, d).select("log", "at_ms", F.col("line_no").alias("event_id"), F.col("event_type").alias("place"))
    return T.sampled(p, every=86_400_000).select("log", "event_id")


@query("""WITH marks AS (SELECT user_id AS log, event_type AS kind, event_id % 3 AS encounter_id, event_id AS line_no, floor(epoch(ts))::BIGINT AS t, CASE WHEN value < 50 THEN 'START' ELSE 'END' END AS mark, value > 75 AS success FROM events),
-- a START rises to a level and the END that closes it falls from there, so they alternate within a level
l AS (SELECT *, sum(CASE mark WHEN 'START' THEN 1 ELSE -1 END) OVER (PARTITION BY log, kind, encounter_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) + (mark = 'END')::INT AS level FROM marks),
x AS (SELECT *, lead(mark) OVER w AS nm, lag(mark) OVER w AS pm, lead(t) OVER w AS nt, lead(success) OVER w AS ns FROM l WINDOW w AS (PARTITION BY log, kind, encounter_id, level ORDER BY line_no))
SELECT log, kind, encounter_id, line_no, t AS started_at, CASE WHEN nm = 'END' THEN nt END AS ended_at, CASE WHEN nm = 'END' THEN ns END AS success FROM x WHERE mark = 'START'
UNION ALL SELECT log, kind, encounter_id, line_no, NULL, t, success FROM x WHERE mark = 'END' AND pm IS DISTINCT FROM 'START'""")
def folded_fights(spark, d):
    e = table(spark, d, "events")
    marks = e.select(
        F.col("user_id").alias("log"), F.col("event_type").alias("kind"), (F.col("event_id") % 3).alias("encounter_id"), F.col("event_id").alias("line_no"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("value") < 50, "START").otherwise("END").alias("mark"), (F.col("value") > 75).alias("success"),
    )
    return T.folded_fights(marks)


_STREAM = "WITH s AS (SELECT user_id AS actor, event_id, event_type AS place, floor(epoch(ts))::BIGINT AS t, CASE WHEN value > 60 THEN 1 ELSE 0 END AS weight, floor(value)::BIGINT AS held FROM events)"


def _stream(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("actor"), "event_id", F.col("event_type").alias("place"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"),
        F.when(F.col("value") > 60, 1).otherwise(0).alias("weight"), F.floor("value").cast("long").alias("held"),
    )


@query(_STREAM + """, c AS (SELECT *, coalesce(lag(place) OVER w IS DISTINCT FROM place OR t - lag(t) OVER w > 86400, true)::INT AS c FROM s WINDOW w AS (PARTITION BY actor ORDER BY t, event_id)),
n AS (SELECT *, sum(c) OVER (PARTITION BY actor ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS visit_no FROM c)
SELECT actor, visit_no, min(place) AS place, min(t) AS started_at, max(t) AS ended_at, count(*) AS n_events, sum(weight)::BIGINT AS weight FROM n GROUP BY actor, visit_no HAVING sum(weight) > 0""")
def tracked_visits(spark, d):
    return T.tracked(_stream(spark, d), ["place"], gap=86_400)


@query(_STREAM + """, r AS (SELECT *, coalesce(greatest(held - lag(held) OVER (PARTITION BY actor, place ORDER BY t, event_id), 0), 0) AS r FROM s)
SELECT actor, place, sum(r)::BIGINT AS gained, arg_max(held, (t, event_id)) AS total FROM r GROUP BY actor, place""")
def counter_gains(spark, d):
    return T.counter_gains(_stream(spark, d), ["actor", "place"])
