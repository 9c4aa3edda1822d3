"""Interval joins without pairs: against a comparison of all, and with work that grows with the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.operators import cover as C
from visitloom.operators import ranges as R


def _intervals(rng, n, top, most):
    lo = [rng.randint(0, top) for _ in range(n)]
    return [(i, x, x + rng.randint(0, most), rng.choice(["a", "b", "c", None])) for i, x in enumerate(lo)]


@pytest.mark.parametrize("seed,top,most", [(1, 900, 300), (2, 40, 20), (3, 4000, 3000)])
def test_links_equal_a_comparison_of_all(spark, seed, top, most):
    rng = random.Random(seed)
    spans, fights = _intervals(rng, 80, top, most), _intervals(rng, 60, top, most)
    s = spark.createDataFrame([*spans, (99, None, 5, "a")], "span_id long, lo long, hi long, name string")
    told = R.link_overlaps(spark.createDataFrame([f[:3] for f in fights] + [(99, None, 3)], "fight_id long, a long, b long"), s, width=100)
    want = {i: max(((min(b, hi) - max(a, lo), lo, j) for j, lo, hi, _ in spans if a <= hi and b >= lo), default=(None, None, None)) for i, a, b, _ in fights} | {99: (None, None, None)}
    assert {r["fight_id"]: (r["overlap"], r["span_id"]) for r in told.collect()} == {i: (w[0], w[2]) for i, w in want.items()}
    points = [(i, lo, n) for i, lo, _, n in fights]
    told = R.link_points(spark.createDataFrame([*points, (99, None, "a")], "point_id long, at long, name string"), s, width=100)
    want = {i: max(((n is not None and n == m, lo, j) for j, lo, hi, m in spans if lo <= t <= hi), default=(0, 0, None))[2] for i, t, n in points} | {99: None}
    assert {r["point_id"]: r["span_id"] for r in told.collect()} == want


def test_spans_over_many_wide_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "WIDE", 3)
    rng = random.Random(5)
    spans = [(rng.choice("xy"), lo := rng.randint(0, 400), rng.choice([None, lo + rng.randint(0, 9), lo + rng.randint(0, 300)]), rng.random() < 0.5, i) for i in range(90)]
    points = [(rng.choice("xyz"), rng.randint(0, 420), i) for i in range(300)]
    told = R.best_enclosing(spark.createDataFrame(points, "g string, at int, p int"), spark.createDataFrame(spans, "g string, lo int, hi int, w boolean, s int"), ["g"], "at", "lo", "hi", F.struct("w", "s"), ["s"])
    want = {p: max(held)[1] for g, t, p in points if (held := [(w, s) for h, lo, hi, w, s in spans if g == h and lo <= t and (hi is None or t <= hi)])}
    assert {r["p"]: r["s"] for r in told.collect()} == want


def test_a_crowded_bucket_forms_no_pairs(spark):
    # 20,000 spans and points of one second: all pairs would be 400,000,000
    s = spark.range(20_000).selectExpr("id AS span_id", "5 AS lo", "5 + id % 7 AS hi", "id AS name")
    p = spark.range(20_000).selectExpr("id AS point_id", "6 AS at", "-id - 1 AS name")
    assert [tuple(r) for r in R.link_points(p, s).groupBy("span_id").count().collect()] == [(19_998, 20_000)]
    for told in (R.link_points(p, s), R.link_overlaps(p.selectExpr("point_id AS fight_id", "at AS a", "at + 2 AS b"), s)):
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan


def test_cover_of_nothing():
    none = np.array([], dtype=np.int64)
    assert C.painted(0, none, none).tolist() == [] and C.painted(3, none, none).tolist() == [-1, -1, -1]
    assert C.rightmost(np.array([4, 2, 9, 1]), np.array([4, 2, 0]), np.array([3, 5, 0])).tolist() == [2, -1, -1]
