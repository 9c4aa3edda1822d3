import datetime as dt
import random

import numpy as np

from visitloom.operators.merge import upsert
from visitloom.operators.timeline import counter_gains, folded_fights, keep_samples, tracked
from visitloom.streaming import jobs
from visitloom.streaming.tail import TailReader, TailSource, same_file, whole_lines_end


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return df.sparkSession.table(name)


def test_tail_resumes_waits_for_whole_lines_and_restarts(spark, tmp_path):
    spark.dataSource.register(TailSource)
    log, ck, out = tmp_path / "logs" / "Combat.txt", str(tmp_path / "ck"), []
    log.parent.mkdir()

    def run():
        stream = spark.readStream.format("tail").option("path", str(log.parent)).option("prefix", "combat").load()
        q = stream.writeStream.foreachBatch(lambda df, i: out.extend(r["line"] for r in df.orderBy("line_no").collect())).option("checkpointLocation", ck).trigger(once=True).start()
        q.awaitTermination(60)

    log.write_text("a\nb\nhalf")
    run()
    assert out == ["a", "b"]
    with log.open("a") as f:
        f.write(" done\nc\n")
    run()
    assert out == ["a", "b", "half done", "c"]
    log.write_text("new\n")
    run()
    assert out[-1] == "new" and len(out) == 5


def test_streamed_sampling_keeps_state(spark, tmp_path):
    schema = "log string, at_ms long, place string"
    for i, data in enumerate(([("l", 0, "a"), ("l", 4000, "a")], [("l", 5000, "a"), ("l", 5001, "b")])):
        spark.createDataFrame(data, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    got = _drain(jobs.sampled(stream, 5000), "kept_points")
    assert sorted(r["at_ms"] for r in got.collect()) == [0, 5000, 5001]


def test_foreach_batch_merge_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "k int, v int").write.parquet(str(tmp_path / "in"))
    held = {"t": spark.createDataFrame([(1, 1), (5, 5)], "k int, v int")}

    def merge(batch, _):
        held["t"] = spark.createDataFrame(upsert(held["t"], batch, ["k"]).collect(), "k int, v int")

    jobs.merging(spark.readStream.schema("k int, v int").parquet(str(tmp_path / "in")), merge, str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(map(tuple, held["t"].collect())) == [(1, 2), (5, 5)]


def _feed(spark, folder, schema, batches):
    """A stream that reads one batch at a time."""
    for i, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.json(str(folder / "in" / f"{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder / "in"))


MARKS = "log string, kind string, encounter_id long, line_no long, at long, mark string, success boolean"


def test_streamed_fights_equal_the_batch_fold(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"l{rng.randrange(3)}", "encounter", rng.choice([1, 2, None]), i, 100 + i, rng.choice(["START", "END"]), rng.random() < 0.5) for i in range(60)]
    stream = _feed(spark, tmp_path, MARKS, [rows[:20], rows[20:21], rows[21:]])
    told: dict = {}
    for r in _drain(jobs.fights(stream), "streamed_fights").collect():
        key = (r["log"], r["line_no"])
        if key not in told or r["ended_at"] is not None:
            told[key] = tuple(r)
    want = folded_fights(spark.createDataFrame(rows, MARKS)).select("log", "kind", "encounter_id", "line_no", "started_at", "ended_at", "success")
    assert sorted(told.values(), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_streamed_visits_equal_the_batch_fold(spark, tmp_path):
    rng = random.Random(9)
    schema = "actor long, event_id long, at long, place string, mode string, weight long"
    rows = [(rng.randrange(3), i, 10 * i, rng.choice("ab"), rng.choice(["x", "x", None]), rng.randrange(2)) for i in range(80)]
    stream = _feed(spark, tmp_path, schema, [rows[:30], rows[30:50], rows[50:]])
    got = _drain(jobs.tracked(stream, ["place", "mode"]), "streamed_visits").collect()
    batch = tracked(spark.createDataFrame(rows, schema), ["place", "mode"], "actor").collect()
    last = {a: max(r["started_at"] for r in batch if r["actor"] == a) for a in range(3)}
    going_on = {a: max(r[2] for r in rows if r[0] == a) for a in range(3)}
    want = sorted(((r["actor"], r["place"], r["mode"], r["started_at"], r["ended_at"], r["n_events"], r["weight"]) for r in batch if not (r["started_at"] == last[r["actor"]] and r["ended_at"] == going_on[r["actor"]])), key=str)
    assert sorted(((r["actor"], r["place"], r["mode"], r["started_at"], r["ended_at"], r["n_events"], r["weight"]) for r in got), key=str) == want


def test_streamed_counters_equal_the_batch_fold(spark, tmp_path):
    rng = random.Random(2)
    schema = "actor long, event_id long, at long, held long"
    rows = [(i % 4, i, i, rng.randrange(50)) for i in range(90)]
    got = _drain(jobs.counter_gains(_feed(spark, tmp_path, schema, [rows[:10], rows[10:60], rows[60:]]), "actor"), "streamed_counters").groupBy("actor").sum("gained").collect()
    want = counter_gains(spark.createDataFrame(rows, schema), ["actor"]).collect()
    assert {tuple(r) for r in got} == {(r["actor"], r["gained"]) for r in want}


def test_streamed_sessions_and_dedupe(spark, tmp_path):
    schema = "actor long, id long, started_at timestamp, seconds long"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, 1, at(0), 100), (1, 2, at(390), 10), (1, 3, at(2000), 5), (1, 3, at(2000), 5), (2, 9, at(90_000), 1)]
    stream = _feed(spark, tmp_path, schema, [rows])
    deduped = _drain(jobs.deduplicated(stream, ["actor", "id"], "started_at"), "deduped").collect()
    assert sorted(r["id"] for r in deduped) == [1, 2, 3, 9]
    told = _drain(jobs.sessions(_feed(spark, tmp_path / "b", schema, [rows[:3], [(3, 7, at(95_000), 1)]])), "streamed_sessions").collect()
    assert [(r["n_visits"], r["played_seconds"], r["ended_at"]) for r in sorted(told, key=lambda r: r["started_at"]) if r["actor"] == 1] == [(2, 110, at(400)), (1, 5, at(2005))]


def test_a_replay_after_rotation_reads_no_other_bytes(tmp_path):
    log = tmp_path / "Combat.txt"
    log.write_text("one\ntwo\n")
    reader = TailReader({"path": str(tmp_path)})
    first = reader.latestOffset()
    pieces = reader.partitions({}, first)
    assert [r[2] for p in pieces for r in reader.read(p)] == ["one", "two"]
    log.write_text("another file\n")
    assert [r[2] for p in reader.partitions({}, first) for r in reader.read(p)] == []
    second = reader.latestOffset()
    assert not same_file(first["Combat.txt"], second["Combat.txt"])
    assert [r[2] for p in reader.partitions(first, second) for r in reader.read(p)] == ["another file"]


def test_the_last_whole_line_is_found_from_the_end(tmp_path):
    p = tmp_path / "x"
    p.write_bytes(b"a\n" + b"b" * 200_000 + b"\nhalf")
    assert whole_lines_end(str(p), 0, 10) == 2
    assert whole_lines_end(str(p), 2, 10) == 200_003
    assert whole_lines_end(str(p), 0, 1 << 30) == 200_003
    assert whole_lines_end(str(p), 200_003, 10) == 200_003


def test_kept_samples_equal_the_row_by_row_rule():
    rng = random.Random(1)
    for _ in range(200):
        at = np.sort([rng.randrange(60) for _ in range(rng.randrange(25))])
        place = np.array([rng.choice("abb") for _ in at], dtype=object)
        last = rng.choice([None, (-3, "a"), (-9, "b")])
        want, now = [], last
        for i, (t, p) in enumerate(zip(at, place, strict=True)):
            if now is None or t - now[0] >= 7 or p != now[1]:
                want.append(i)
                now = (t, p)
        assert keep_samples(at, place, last, 7) == (want, now)
