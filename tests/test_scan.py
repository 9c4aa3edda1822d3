"""Prefix scans over spans: as one window over the whole group would have it."""

import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.operators import scan as S
from visitloom.operators import timeline as T


@pytest.fixture
def short_spans(monkeypatch):
    monkeypatch.setattr(S, "ROWS", 3)
    monkeypatch.setattr(S, "FAN", 6)


def _rows(n=400, seed=4):
    rng = random.Random(seed)
    log = lambda: rng.choice(["hot", "hot", "hot", "hot", "cold", None])
    return [(log(), i, rng.choice([None, rng.randint(-9, 9)]), rng.randint(0, 60) + (900 if i % 9 == 0 else 0)) for i in range(n)]


CARRIES = [(kind, upto) for kind in ("last", "sum", "min", "max") for upto in (True, False)]


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("spans", ["number", "density"])
def test_scan_equals_one_window(spark, short_spans, spans, backward):
    df = spark.createDataFrame(_rows(), "log string, line_no long, v long, at long").repartition(5)
    order = ["line_no"] if spans == "number" else ["at", "line_no"]
    cut = df.withColumn("_span", S.by_number("line_no")) if spans == "number" else S.by_density(df, ["log"], "at")
    told = S.scan(*S.numbered(cut), ["log"], order, [S.Carry(f"{k}_{u}", k, F.col("v"), u) for k, u in CARRIES], backward).drop("_span")
    w = W.partitionBy("log").orderBy(*[F.col(o).desc() if backward else F.col(o) for o in order])
    want = df
    for k, u in CARRIES:
        own = w.rowsBetween(W.unboundedPreceding, 0 if u else -1)
        value = F.last("v", ignorenulls=True).over(own) if k == "last" else {"sum": F.sum, "min": F.min, "max": F.max}[k]("v").over(own)
        want = want.withColumn(f"{k}_{u}", F.coalesce(value, F.lit(0)) if k == "sum" else value)
    key = lambda r: r["line_no"]
    assert sorted(told.collect(), key=key) == sorted(want.collect(), key=key)


def test_before_keeps_null_values(spark, short_spans):
    df = spark.createDataFrame([("a", i, None if i % 2 else i) for i in range(9)], "log string, line_no long, v long").withColumn("_span", S.by_number("line_no"))
    told = {r["line_no"]: r["b"] for r in S.scan(*S.numbered(df), ["log"], ["line_no"], [S.before("b", "v")]).collect()}
    assert told[0] is None and [told[i]["v"] for i in range(1, 9)] == [0, None, 2, None, 4, None, 6, None]


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "log string, line_no long, v long").withColumn("_span", S.by_number("line_no"))
    assert S.scan(*S.numbered(df), ["log"], ["line_no"], [S.Carry("s", "sum", F.col("v"))]).collect() == []


def test_dense_times_are_cut_again(spark, short_spans):
    df = spark.createDataFrame([("a", 0)] + [("a", 10**9 + i) for i in range(100)] + [("a", None)], "log string, at long")
    told = S.by_density(df, ["log"], "at").groupBy("_span").count().collect()
    assert max(r["count"] for r in told) <= 8


def test_hot_log_is_spread_and_no_window_has_the_log_alone(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 100)
    lines = spark.range(5000).select(F.lit("hot").alias("log"), F.col("id").alias("line_no"), F.col("id").cast("int").alias("month"), (F.col("id") % 7 == 0).alias("m"), F.col("id").alias("at"))
    marks = lines.select("log", F.lit("k").alias("kind"), F.lit(1).alias("encounter_id"), "line_no", "at", F.when(F.col("m"), "START").otherwise("END").alias("mark"), F.lit(True).alias("success"))
    pulls = lines.select(F.lit(1).alias("segment_id"), F.lit(2).alias("encounter_id"), F.col("at").alias("pull_id"), "at", F.lit(0).alias("difficulty"), F.lit(False).alias("success"))
    events = lines.select(F.col("log").alias("actor"), "at", F.col("at").alias("event_id"), F.col("month").alias("place"), F.lit(1).alias("weight"))
    told = [T.with_years(lines, "log", 2020), T.latest_before(lines, "log", "m", "at", "b"), T.thinned(lines, "log", "line_no"), T.folded_fights(marks), T.rearmed(pulls), T.tracked(events, ["place"])]
    for df in told:
        windows = re.findall(r"windowspecdefinition\((.*?) (?:ASC|DESC)", df._jdf.queryExecution().optimizedPlan().toString())
        assert windows and all("_span" in w or "_group" in w for w in windows)
    spans = T.latest_before(lines.withColumn("_s", S.by_number("line_no")), "log", "m", "at", "b").groupBy("_s").count().collect()
    assert len(spans) == 50 and max(r["count"] for r in spans) == 100


def _operators(spark):
    rng = random.Random(8)
    lines = spark.createDataFrame([(f"l{rng.randint(0, 2)}", i, rng.choice([1, 6, 12]), rng.random() < 0.2, rng.choice([None, i])) for i in range(300)], "log string, line_no long, month int, m boolean, v long")
    marks = spark.createDataFrame([(f"l{rng.randint(0, 1)}", "k", rng.randint(0, 1), i, 10 * i, rng.choice(["START", "END", "END", "START", "NOTE"]), rng.choice([True, None])) for i in range(300)], "log string, kind string, encounter_id int, line_no long, at long, mark string, success boolean")
    pulls = spark.createDataFrame([(i, rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 3000), rng.randint(0, 1), rng.random() < 0.3) for i in range(300)], "pull_id long, segment_id int, encounter_id int, at long, difficulty int, success boolean")
    events = spark.createDataFrame([(rng.choice(["a", "b", None]), i, rng.randint(0, 900), rng.choice(["x", "y", None]), rng.randint(0, 1), rng.randint(0, 40)) for i in range(300)], "actor string, event_id long, at long, place string, weight int, held long")
    return {
        "years": T.with_years(lines, "log", 2020), "latest": T.latest_before(lines, "log", "m", "v", "b"), "thinned": T.thinned(lines, "log", "line_no"), "fights": T.folded_fights(marks),
        "closed": T.close_open_fights(T.folded_fights(marks.where("line_no < 150")), marks.where("line_no >= 150")), "rearmed": T.rearmed(pulls), "tracked": T.tracked(events, ["place"], gap=20), "gains": T.counter_gains(events, ["actor", "place"]),
    }


def test_operators_do_not_depend_on_the_spans(spark, monkeypatch):
    told = []
    for rows, fan in ((20_000, 1024), (10, 4)):
        monkeypatch.setattr(S, "ROWS", rows)
        monkeypatch.setattr(S, "FAN", fan)
        told.append({k: sorted(map(str, v.collect())) for k, v in _operators(spark).items()})
    assert told[0] == told[1] and all(told[0].values())


def _plain_fights(marks):
    """One mark at a time: an END closes the newest open START."""
    open_, out = {}, []
    for log, kind, enc, line, at, mark, ok in sorted(marks, key=lambda m: m[3]):
        held = open_.setdefault((log, kind, enc), [])
        if mark == "START":
            held.append((line, at))
        elif held:
            line, began = held.pop()
            out.append((log, kind, enc, line, began, at, ok))
        else:
            out.append((log, kind, enc, line, None, at, ok))
    return out + [(*k, line, at, None, None) for k, held in open_.items() for line, at in held]


def test_fights_equal_a_stack_of_open_ones(spark, short_spans):
    rng = random.Random(2)
    marks = [("l", "k", i % 2, i, 10 * i, rng.choice(["START", "END"]), rng.random() < 0.5) for i in range(500)]
    df = spark.createDataFrame(marks, "log string, kind string, encounter_id int, line_no long, at long, mark string, success boolean")
    told = [tuple(r[c] for c in ("log", "kind", "encounter_id", "line_no", "started_at", "ended_at", "success")) for r in T.folded_fights(df).collect()]
    assert sorted(told, key=str) == sorted(_plain_fights(marks), key=str)
