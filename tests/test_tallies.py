"""Rules of a visit's tally against folds that take one event at a time."""

import random

from visitloom.operators import tally as T


def _events(rng, kinds, n=400):
    return [(rng.randint(0, 30), rng.randint(0, 60), i, rng.choice(kinds), rng.choice([None, rng.randint(1, 9)]), rng.choice([None, True, False])) for i in range(n)]


def _in_order(events):
    return sorted(events, key=lambda e: (e[0], e[1], e[2]))


def test_keystones_equal_a_fold(spark):
    events = _events(random.Random(1), ["start", "complete", "reset", "other"], 250)
    runs = {}
    for visit, at, seq, kind, x, ok in _in_order(events):
        run = runs.get(visit)
        if kind == "start" and x is not None:
            runs[visit] = {"level": x, "map": x, "at": at, "done": False, "end": None, "ok": None}
        elif kind == "complete":
            run = runs.setdefault(visit, {"level": None, "map": None, "at": at})
            run.update(level=x if x is not None else run["level"], map=x if x is not None else run["map"], done=True, end=at, ok=bool(ok))
        elif kind == "reset" and run:
            run.update(done=False, end=None, ok=None)
    fields = "visit_id int, at int, seq int, kind string, level int, map int, duration_ms int, on_time boolean, upgrades int"
    # a reset says nothing of level and map
    df = spark.createDataFrame([(v, at, q, k, None if k == "reset" else x, None if k == "reset" else x, at, ok, x) for v, at, q, k, x, ok in events], fields)
    told = {r["visit_id"]: (r["level"], r["map"], r["started_at"], r["completed"], r["completed_at"], r["duration_ms"], r["on_time"]) for r in T.keystone(df).collect()}
    assert told == {v: (r["level"], r["map"], r["at"], r["done"], r["end"], r["end"], r["ok"]) for v, r in runs.items()}


def test_delves_equal_a_fold(spark):
    events = _events(random.Random(2), ["start", "complete", "complete", "other"], 150)
    runs = {}
    for visit, at, _, kind, x, _ok in _in_order(events):
        run = runs.get(visit)
        if kind == "start":
            run = runs.setdefault(visit, {"tier": None, "at": at, "end": None})
        if run and kind in ("start", "complete"):
            run["tier"] = x if x is not None else run["tier"]
            run["end"] = at if kind == "complete" else run["end"]
    df = spark.createDataFrame([(v, at, q, k, x, None) for v, at, q, k, x, _ in events], "visit_id int, at int, seq int, kind string, tier int, scenario string")
    told = {r["visit_id"]: (r["tier"], r["started_at"], r["completed"], r["completed_at"]) for r in T.delve(df).collect()}
    assert told == {v: (r["tier"], r["at"], r["end"] is not None, r["end"]) for v, r in runs.items()}


def test_item_currencies_equal_a_fold(spark):
    rng = random.Random(3)
    readings = [(rng.randint(0, 9), rng.randint(0, 50), i, rng.choice([None, 1, 2]), rng.choice([None, 0, 1, 1, 2]), rng.choice([None, "", f"n{i}"])) for i in range(200)]
    opening = {(v, 1): 1 for v in range(5)}
    held, entries = dict(opening), {}
    for visit, _, _, item, total, name in _in_order(readings):
        if item is None or total is None:
            continue
        before = held.get((visit, item))
        held[visit, item] = total
        if before is None or total == before:
            continue
        entry = entries.setdefault((visit, item), [str(item), 0, None])
        entry[0], entry[1], entry[2] = name or entry[0], entry[1] + total - before, total
    df = spark.createDataFrame(readings, "visit_id int, at int, seq int, item int, total int, name string")
    opened = spark.createDataFrame([(v, i, n) for (v, i), n in opening.items()], "visit_id int, item int, held int")
    told = {(r["visit_id"], r["item"]): [r["name"], r["amount"], r["total"]] for r in T.item_currencies(df, opened).collect()}
    assert told == entries


def test_only_what_says_something_is_told(spark):
    sets = [(1, 5, 0, 7, "updated", []), (1, 6, 1, 7, "updated", [1]), (1, 7, 2, 8, "added", []), (2, 1, 3, None, "added", [1]), (2, 2, 4, 9, None, [1]), (3, 0, 5, 9, "updated", None)]
    told = T.equipset_changes(spark.createDataFrame(sets, "visit_id int, at int, seq int, set_id int, kind string, items array<int>"))
    assert [(r["visit_id"], r["seq"], r["position"]) for r in told.orderBy("seq").collect()] == [(1, 1, 0), (1, 2, 1)]
    gains = spark.createDataFrame([(1, 1, 0, "a", 5, "friendly"), (1, 2, 1, "a", 7, None), (1, 3, 2, None, 9, "x"), (2, 1, 3, "a", None, "x")], "visit_id int, at int, seq int, faction string, amount int, standing string")
    rep = T.reputation(gains)
    assert [tuple(r) for r in rep.collect()] == [(1, "a", 12, "friendly")]
    visits = spark.createDataFrame([(1,), (2,), (3,)], "visit_id int")
    assert [r[0] for r in T.has_events(visits, [rep, told.select("visit_id")]).collect()] == [1]


def test_collected_equal_a_fold(spark, monkeypatch):
    monkeypatch.setattr(T.S, "ROWS", 16)  # many spans a visit
    events = _events(random.Random(8), ["mount", "quest", "other"], 300)
    names = [None, "", "Ash"]
    told, lists = [], {}
    for visit, at, seq, kind, x, first in _in_order(events):
        name = names[seq % 3]
        told.append((visit % 3, at, seq, kind, x, name, first))
    for visit, at, _seq, kind, x, name, first in _in_order(told):
        if x is None or kind == "other":
            continue
        met = lists.setdefault((visit, kind), [])
        met.append((len(met), x, (str(x) if name is None else name) if kind == "mount" else name or None, first, at))
    df = spark.createDataFrame(told, "visit_id int, at int, seq int, kind string, id int, name string, first boolean")
    got = sorted(((r["visit_id"], r["kind"], r["position"]), r["id"], r["name"], r["first"], r["at"]) for r in T.collected(df, ("mount",), ("quest",)).collect())
    want = sorted((((*key, m[0]), *m[1:]) for key, met in lists.items() for m in met), key=lambda r: r[0])
    assert [tuple(r) for r in got] == want


def test_sums_and_empty_visits(spark):
    df = spark.createDataFrame([(1, "xp", 5), (1, "xp", None), (1, "note", 3), (2, "note", 1)], "visit_id int, kind string, n int")
    told = {r["visit_id"]: r["xp"] for r in T.added(df, {"xp": "xp"}, "n").collect()}
    assert told == {1: 5, 2: 0}
    assert T.collected(spark.createDataFrame([], "visit_id int, at int, seq int, kind string, id int, name string"), ("mount",)).count() == 0
