"""Order statistics without sorted groups, and pieces of files that several tasks read."""

import random

import pytest
from pyspark.sql import functions as F

from visitloom.operators import catalogue as C
from visitloom.operators import scan as S
from visitloom.streaming.tail import Piece, TailReader, TailSource, lines_between


@pytest.mark.parametrize("spans", [(20_000, 1024), (3, 4)])
def test_order_statistics_equal_sorted_lists(spark, monkeypatch, spans):
    monkeypatch.setattr(S, "ROWS", spans[0])
    monkeypatch.setattr(S, "FAN", spans[1])
    rng = random.Random(6)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.randint(-50, 50) / 4, 1e9])) for _ in range(300)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    told = C.order_statistics(df, ["k"], "v", {"low": F.lit(0), "mid": F.floor(F.col("_n") / 2), "top": F.col("_n") - 1, "past": F.col("_n")}).collect()
    want = {}
    for k, v in data:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert {r["k"]: (r["low"], r["mid"], r["top"], r["past"], r["_n"]) for r in told} == {k: (min(v), sorted(v)[len(v) // 2], max(v), None, len(v)) for k, v in want.items()}


def test_no_group_is_sorted_alone(spark):
    df = spark.range(1000).selectExpr("'hot' AS k", "id", "double(id % 97) AS v", "array(id) AS bits", "'s' AS slot")
    distance = lambda a, b: F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0]))
    for told in (C.bands(df, "k", "v"), C.stranger_cut(df, distance)):
        plan = told._jdf.queryExecution().optimizedPlan().toString()
        windows = [x.split(" ASC")[0].split(" DESC")[0] for x in plan.split("windowspecdefinition(")[1:]]
        assert windows and all("_span" in w or "_group" in w for w in windows)


TEXT = b"first\nsecond line\n\n" + b"long" * 40 + b"\nx\r\n\xc3\xb1\n" + b"end\n"


@pytest.mark.parametrize("size", [1, 2, 5, 17, 64, 1000])
def test_pieces_hold_each_line_once(tmp_path, size):
    path = tmp_path / "log"
    path.write_bytes(b"seen before\n" + TEXT + b"half a li")
    first, end = 12, 12 + len(TEXT)
    told = [line for at in range(first, end, size) for line in lines_between(str(path), at, min(at + size, end), first)]
    want, at = [], first
    for raw in TEXT.splitlines(keepends=True):
        want.append((at, raw))
        at += len(raw)
    assert told == want


def test_a_batch_of_one_log_runs_in_several_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(5000)]
    (tmp_path / "in" / "Combat.txt").write_text("\n".join(lines) + "\n")
    reader = TailReader({"path": str(tmp_path / "in"), "piece": "10000"})
    pieces = reader.partitions({}, reader.latestOffset())
    assert len(pieces) > 10 and all(isinstance(p, Piece) for p in pieces)
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format("tail").option("path", str(tmp_path / "in")).option("piece", "10000").load()
    told = stream.withColumn("task", F.spark_partition_id())
    q = told.writeStream.format("memory").queryName("pieces").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    got = spark.table("pieces").orderBy("line_no").collect()
    assert [r["line"] for r in got] == lines and len({r["task"] for r in got}) > 10


def test_a_replaced_file_gives_no_piece_of_other_bytes(tmp_path):
    path = tmp_path / "Combat.txt"
    path.write_text("aaaa\nbbbb\n" * 500)
    reader = TailReader({"path": str(tmp_path), "piece": "100"})
    pieces = reader.partitions({}, reader.latestOffset())
    path.write_text("other\n" * 5000)
    assert [list(reader.read(p)) for p in pieces] == [[]] * len(pieces)
