from conftest import rows

from visitloom import schema
from visitloom.operators import latest as L
from visitloom.operators import merge as M
from visitloom.operators import ranges as R


def test_every_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", None)], "k int, v string, n int")
    for rule in ("last", "coalesce", "fill", "known"):
        once = M.upsert(old, new, ["k"], {"v": rule, "n": "last"})
        assert rows(once) and sorted(map(str, once.collect())) == sorted(map(str, M.upsert(once, new, ["k"], {"v": rule, "n": "last"}).collect()))
    got = {r["k"]: (r["v"], r["n"]) for r in M.upsert(old, new, ["k"], {"v": "coalesce"}).collect()}
    assert got == {1: ("a", None), 2: ("b", 7), 3: ("c", None)}


def test_null_keys_meet(spark):
    old = spark.createDataFrame([(None, 1)], "k int, v int")
    new = spark.createDataFrame([(None, 2)], "k int, v int")
    assert M.upsert(old, new, ["k"]).collect()[0]["v"] == 2


def test_prune_only_complete_scopes(spark):
    held = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "a int, k string")
    walked = spark.createDataFrame([(1, "x")], "a int, k string")
    claims = spark.createDataFrame([(1, True), (2, False)], "a int, complete boolean")
    assert rows(M.prune_if_complete(held, walked, claims, ["a"], "k")) == [(1, "x"), (2, "x")]


def test_cascade_sets_null(spark):
    seg, cap = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(7, 1), (8, 2)], "c int, segment_id int")
    out = M.cascade({"segments": seg, "captures": cap}, seg.where("id = 1"), "segments", [("segments", "id", "captures", "segment_id", "null")])
    assert sorted(map(tuple, out["captures"].select("c", "segment_id").collect())) == [(7, None), (8, 2)]


def test_gold_is_null_when_nothing_was_read(spark):
    none = spark.createDataFrame([], "gold long, at long")
    assert L.account_gold(none, none).collect()[0]["gold"] is None


def test_nearest_ties_go_to_the_earlier_point(spark):
    m = spark.createDataFrame([(1, 100, "m"), (2, 500, "m")], "moment_id int, at long, place_key string")
    p = spark.createDataFrame([(10, 90, "m"), (11, 110, "m"), (12, 100, "other")], "point_id int, at long, place_key string")
    assert rows(R.place_nearest(m, p, 15).fillna(-1), "moment_id", "point_id", "gap") == [(1, 10, 10), (2, -1, -1)]


def test_range_joins_are_equi_joins(spark):
    m = spark.createDataFrame([(1, 100, "m")], "moment_id int, at long, place_key string")
    plan = R.place_nearest(m, m.selectExpr("moment_id as point_id", "at", "place_key"), 15)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_migrations_run_once_and_refuse_newer_stores(spark):
    steps = [("one", lambda t: {**t, "a": 1}), ("two", lambda t: {**t, "b": 2})]
    assert schema.migrate({}, ["one"], steps) == ({"b": 2}, ["one", "two"])
    try:
        schema.migrate({}, ["three"], steps)
        raise AssertionError
    except ValueError:
        pass


def test_key_violations(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert len(schema.violations(df, ("k",)).collect()) == 2
