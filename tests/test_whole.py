"""Registered queries do the whole job: held against plain Python on small fixtures."""

import datetime as dt
import random
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
from conftest import rows

from visitloom.operators import catalogue as C
from visitloom.operators import sessions as S
from visitloom.operators import timeline as T
from visitloom.plans import registry


def _write(folder, name, columns):
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    return str(folder)


def _events(folder, events):
    """Events out of (event_id, user_id, event_type, second, value, level)."""
    start = dt.datetime(2024, 1, 1)
    return _write(folder, "events", {
        "event_id": pa.array([e[0] for e in events], pa.int64()), "user_id": pa.array([e[1] for e in events], pa.int64()),
        "event_type": [e[2] for e in events], "ts": pa.array([start + dt.timedelta(seconds=e[3]) for e in events], pa.timestamp("us")),
        "value": [float(e[4]) for e in events], "props": [f'{{"k": {e[5]}}}' for e in events],
    })


def test_summaries_merge_every_visit(spark, tmp_path):
    events = [(i * 7, i % 5 if i < 300 else 9, "view" if i % 2 else "click", i, i % 4, i) for i in range(600)]
    want = {}
    for i, actor, place, _, value, level in events:
        seconds, _, places = want.get(actor, (0, 0, []))
        want[actor] = (seconds + value * 10, level, [*places, place])
    got = registry.queries()["merged_summaries"](spark, _events(tmp_path, events))
    assert rows(got, "actor", "seconds", "level", "places") == sorted((a, s, v, ",".join(p)) for a, (s, v, p) in want.items())


def _loot(value):
    return int(value * 100)


def test_readings_points_and_gold_take_every_row(spark, tmp_path):
    kinds = ("view", "purchase", "error", "click")
    events = [(i, i % 6, kinds[i * 5 % 7 % 4], 1000 + i * 37 % 900, i * 13 % 97, i) for i in range(1, 400)]
    d = _events(tmp_path, events)
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    q = registry.queries()

    readings = defaultdict(list)
    for i, actor, place, s, value, _ in events:
        readings[actor, place].append((base + s + value * 10, 0, _loot(value)))
        readings[actor, place].append((base + s + 86400 * (i % 3 - 1), 1, value))
    fresh = {k: max(v) for k, v in readings.items()}
    assert rows(q["freshest_reading"](spark, d), "actor", "pot", "at", "depth", "total") == sorted((*k, *v) for k, v in fresh.items())
    pots = {}
    for (actor, pot), (at, _, total) in fresh.items():
        pots.setdefault(pot, []).append((at, -actor, total))
    want = [(p, max(v)[2] if p in ("purchase", "error") else sum(x[2] for x in v), min(x[0] for x in v), len(v)) for p, v in pots.items()]
    assert rows(q["one_pot_rollup"](spark, d), "pot", "total", "oldest", "n_readings") == sorted(want)

    bought = [e for e in events if e[2] == "purchase"]
    gold = sum(_loot(e[4]) for e in events) + sum(e[4] * 10 for e in bought)
    oldest = min([base + e[3] + e[4] * 10 for e in events] + [base + e[3] for e in bought])
    assert rows(q["account_gold"](spark, d), "gold", "oldest", "n_readings") == [(gold, oldest, len(events) + len(bought))]

    lo, hi = min(e[3] for e in bought), max(e[3] + e[4] * 10 for e in bought)
    assert rows(q["bounded_points"](spark, d)) == sorted((e[0],) for e in events if e[2] == "view" and lo <= e[3] <= hi)


def test_outer_join_reads_both_tables_whole(spark, tmp_path):
    _write(tmp_path, "customer", {"c_custkey": pa.array([1, 2, 3, 4], pa.int64())})
    d = _write(tmp_path, "orders", {"o_orderkey": pa.array([1, 2, 3, 4], pa.int64()), "o_custkey": pa.array([1, 1, 2, 9], pa.int64())})
    got = registry.queries()["outer_join"](spark, d).fillna(-1)
    want = [(1, 1, "both"), (1, 2, "both"), (2, 3, "both"), (3, -1, "customer"), (4, -1, "customer"), (-1, 4, "order")]
    assert rows(got, "c_custkey", "o_orderkey", "side") == sorted(want)


def test_ends_close_the_newest_open_start(spark):
    rng = random.Random(5)
    marks = [(0, k, e, i, 100 + i, "SSEE"[i], bool(i % 2)) for k, e in (("x", None), ("y", 1)) for i in range(4)]
    for log in range(1, 9):
        marks += [(log, "x", rng.randrange(2), i, 100 + i, rng.choice("SSE" if log % 2 else "SEE"), rng.random() < 0.5) for i in range(40)]
    opened, want = defaultdict(list), {}
    for log, kind, enc, line, at, mark, ok in sorted(marks, key=lambda m: m[3]):
        stack = opened[log, kind, enc]
        if mark == "S":
            want[log, kind, enc, line] = (at, None, None)
            stack.append(line)
        elif stack:
            line = stack.pop()
            want[log, kind, enc, line] = (want[log, kind, enc, line][0], at, ok)
        else:
            want[log, kind, enc, line] = (None, at, ok)
    data = [(*m[:5], {"S": "START", "E": "END"}[m[5]], m[6]) for m in marks]
    got = T.folded_fights(spark.createDataFrame(data, "log int, kind string, encounter_id int, line_no int, at long, mark string, success boolean"))
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got.select("log", "kind", "encounter_id", "line_no", "started_at", "ended_at", "success").collect()} == want
    assert got.count() == len(want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_few_are_ranked_in_two_levels(spark):
    data = [(i % 3 or None, i * 37 % 500, i) for i in range(1000)]
    got = C.first_few(spark.createDataFrame(data, "g int, k int, id int"), "g", ["k", "id"], "id", 4)
    want = {g: [i for _, i in sorted((k, i) for h, k, i in data if h == g)[:4]] for g in (None, 1, 2)}
    assert {r["_by"]: r["few"] for r in got.collect()} == want


def test_no_group_is_gathered_whole(spark, sf_dir):
    for name in ("points_by_category", "shape_siblings", "retention_piles"):
        plan = _plan(registry.queries()[name](spark, sf_dir))
        assert "collect_set" not in plan and plan.count("WindowGroupLimit") >= 2 and "_salt" in plan, name


def test_session_cast_gathers_places_and_not_visits(spark):
    data = [(1, 7, 100 + i, 101 + i, i, ("b", "a", None, "")[i % 4], 2, i % 9, 3) for i in range(40)] + [(1, 8, 5, 6, 99, None, 1, None, None)]
    s = spark.createDataFrame(data, "session_no int, actor int, started_at int, ended_at int, visit_id int, place string, seconds int, level int, loot int")
    got = S.session_cast(s, ("loot",))
    assert "min(struct(started_at" in _plan(got)
    assert [tuple(r) for r in got.select("actor", "seconds", "n_visits", "level", "places", "loot").orderBy("actor").collect()] == [(7, 80, 40, 8, "b,a", 120), (8, 1, 1, None, "", None)]


def test_roots_are_found_twelve_steps_up(spark, tmp_path):
    ids = [4**k for k in range(12)]
    d = _write(tmp_path, "part", {
        "p_partkey": pa.array(ids, pa.int64()), "p_brand": ["b"] * 12, "p_type": ["t"] * 12, "p_size": pa.array([1] * 12, pa.int64()),
    })
    assert rows(registry.queries()["unique_roots"](spark, d), "root", "subject", "leaf") == [(1, "t", 1)]


def test_sorts_place_every_row(spark, tmp_path):
    rng = random.Random(2)
    names = {i: rng.choice(["", "Ab", "ab c", "zed", "Ma"]) + rng.choice(["", "x", "Y"]) for i in range(700)}
    _write(tmp_path, "part", {"p_partkey": pa.array(list(names), pa.int64()), "p_name": list(names.values())})
    segment = {i: rng.choice(["A", "B", None]) for i in range(80)}
    d = _write(tmp_path, "customer", {"c_custkey": pa.array(list(segment), pa.int64()), "c_mktsegment": list(segment.values()), "c_acctbal": [1.0] * 80})
    q = registry.queries()
    want = sorted(names, key=lambda i: (names[i] == "", names[i].lower(), i))
    assert [tuple(r) for r in q["named_first"](spark, d).select("p_partkey", "place").collect()] == [(i, k + 1) for k, i in enumerate(want)]
    told = [r["c_custkey"] for r in q["column_sort"](spark, d).collect()]
    assert told == sorted(segment, key=lambda i: ({"B": 0, "A": 1, None: 2}[segment[i]], i))
