import random

from conftest import rows

from visitloom.operators import sessions as S
from visitloom.operators import timeline as T

SCHEMA = "visit_id long, actor long, place string, started_at long, ended_at long, seconds long, level long, day string"


def _visits(spark, spans):
    return spark.createDataFrame([(i, i % 3, "p", a, b, b - a, 1, "d") for i, (a, b) in enumerate(spans)], SCHEMA)


def _fold(spans, gap):
    """Ten lines of the frontier rule."""
    order = sorted(range(len(spans)), key=lambda i: (*spans[i], i))
    out, frontier, n = {}, None, 0
    for i in order:
        if frontier is None or spans[i][0] - frontier > gap:
            n, frontier = n + 1, spans[i][1]
        frontier = max(frontier, spans[i][1])
        out[i] = n
    return out


def test_sessions_equal_the_fold_on_random_visits(spark):
    for seed in range(3):
        rng = random.Random(seed)
        spans = [(a, a + rng.choice([0, 10, 400, 90_000])) for a in (rng.randrange(0, 400_000) for _ in range(120))]
        for span in (86_400, 5_000):
            got = dict(rows(S.sessionize(_visits(spark, spans), 300, span=span), "visit_id", "session_no"))
            assert got == _fold(spans, 300)


def test_gap_is_inclusive_and_nested_visits_do_not_end_a_session(spark):
    got = dict(rows(S.sessionize(_visits(spark, [(0, 1000), (10, 20), (1300, 1310), (1611, 1620)])), "visit_id", "session_no"))
    assert got == {0: 1, 1: 1, 2: 1, 3: 2}


def test_no_global_window_over_rows(spark):
    plan = S.sessionize(_visits(spark, [(0, 1)]), by=("actor",))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_empty_visits(spark):
    assert S.session_totals(S.sessionize(_visits(spark, []))).collect() == []


def test_sampling_depends_on_the_last_kept_row(spark):
    data = [("l", t, p) for t, p in [(0, "a"), (3000, "a"), (5000, "a"), (6000, "b"), (6100, "b"), (10_999, "b"), (11_000, "b")]]
    df = spark.createDataFrame(data, "log string, at_ms long, place string")
    assert [r[0] for r in rows(T.sampled(df), "at_ms")] == [0, 5000, 6000, 11_000]


def test_fights_pair_orphans_and_open_ends(spark):
    data = [("l", "encounter", 1, 1, 10, "START", None), ("l", "encounter", 1, 2, 20, "END", True), ("l", "encounter", 1, 3, 30, "END", False), ("l", "encounter", 1, 4, 40, "START", None)]
    df = spark.createDataFrame(data, "log string, kind string, encounter_id long, line_no long, at long, mark string, success boolean")
    got = {r["line_no"]: (r["started_at"], r["ended_at"], r["success"]) for r in T.folded_fights(df).collect()}
    assert got == {1: (10, 20, True), 3: (None, 30, False), 4: (40, None, None)}
