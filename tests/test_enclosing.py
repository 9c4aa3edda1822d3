import random

import pytest
from pyspark.sql import functions as F

from visitloom.operators.ranges import TOP, best_enclosing, blocks_of


@pytest.mark.parametrize("lo,hi", [(0, 0), (0, 7), (1, 6), (5, 5), (3, 1000), (9, 8), (7, TOP), (0, TOP)])
def test_blocks_make_up_the_interval(spark, lo, hi):
    held = spark.range(1).select(blocks_of(F.lit(lo).cast("long"), F.lit(hi).cast("long")).alias("b")).first()["b"]
    runs = sorted((b["block"] << b["level"], ((b["block"] + 1) << b["level"]) - 1) for b in held)
    assert len(runs) <= 2 * 41 and (runs == [] if hi < lo else runs[0][0] == lo and runs[-1][1] == hi)
    assert all(a[1] + 1 == b[0] for a, b in zip(runs, runs[1:], strict=False))


def test_best_enclosing_equals_a_comparison_of_all(spark):
    rng = random.Random(3)
    logs = ["a", "b", None]
    points = [(rng.choice(logs), rng.randint(0, 300), i) for i in range(200)]
    spans = [(rng.choice(logs), s := rng.randint(0, 300), rng.choice([None, s + rng.randint(-2, 90)]), rng.randint(0, 2), i) for i in range(60)]
    told = best_enclosing(spark.createDataFrame(points, "log string, at long, p int"), spark.createDataFrame(spans, "log string, lo long, hi long, w int, s int"), ["log"], "at", "lo", "hi", F.struct("w", "lo", "s"), ["s", "lo"])
    want = []
    for log, at, p in points:
        held = [(w, lo, s) for g, lo, hi, w, s in spans if g == log and lo <= at and (hi is None or at <= hi)]
        if held:
            want.append((log, at, p, max(held)[2], max(held)[1]))
    assert sorted(map(tuple, told.collect()), key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], "log string, lo long, hi long, w int, s int")
    assert best_enclosing(spark.createDataFrame(points, "log string, at long, p int"), none, ["log"], "at", "lo", "hi", F.col("w"), ["s"]).collect() == []
