"""The store of synced tables, migrations, derived facts and log readers on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from visitloom import schema
from visitloom.functions import derive as D
from visitloom.operators import catalogue as C
from visitloom.operators.merge import upsert
from visitloom.operators.timeline import close_open_fights, folded_fights
from visitloom.sources import combat_logs as L
from visitloom.sources.store import Conflict, Store


def _merge(batch):
    def change(tables):
        old = tables.get("segments", batch.limit(0))
        return {"segments": upsert(old, batch, ["id"])}

    return change


def test_a_sync_is_whole_or_not_there(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([(1, 10), (2, 20)], "id long, seconds long")
    assert sorted(map(tuple, store.sync(_merge(one))["segments"].select("id", "seconds").collect())) == [(1, 10), (2, 20)]

    def broken(tables):
        return {"segments": upsert(tables["segments"], one, ["id"]).withColumn("seconds", F.expr("cast(raise_error('stop') as bigint)"))}

    with pytest.raises(Exception, match="stop"):
        store.sync(broken)
    assert store.state()["sync"] == 1 and store.tables()["segments"].count() == 2
    more = spark.createDataFrame([(2, 25), (3, 30)], "id long, seconds long")
    wide = more.select("id", "seconds", *[F.lit(None).cast(t).alias(c) for c, t in store.tables()["segments"].dtypes if c not in ("id", "seconds")])
    for _ in range(2):  # a sync that is run again changes nothing
        store.sync(_merge(wide))
        assert sorted(map(tuple, store.tables()["segments"].select("id", "seconds").collect())) == [(1, 10), (2, 25), (3, 30)]
    store.tidy()
    assert sorted(map(tuple, store.tables()["segments"].select("id").collect())) == [(1,), (2,), (3,)]
    assert len(list((tmp_path / "store" / "segments").iterdir())) == 1


def test_a_merge_rewrites_only_touched_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    key = {"notes": ["id"]}
    store.merge({"notes": spark.range(500).selectExpr("id", "0 AS v")}, key)
    before = store.state()["tables"]["notes"]["buckets"]
    batch = spark.createDataFrame([(3, 7), (3, 7), (900, 8)], "id long, v int").distinct()
    wrote = store.merge({"notes": batch}, key)
    after = store.state()["tables"]["notes"]["buckets"]
    assert 1 <= len(wrote) <= 2 and sum(a != b for a, b in zip(before, after, strict=True)) == len(wrote)
    held = {r["id"]: r["v"] for r in store.tables()["notes"].collect()}
    assert len(held) == 501 and held[3] == 7 and held[900] == 8 and held[4] == 0
    store.merge({"notes": batch}, key)  # again changes nothing
    assert {r["id"]: r["v"] for r in store.tables()["notes"].collect()} == held
    store.merge({"notes": spark.createDataFrame([(None, 1, "x")], "id long, v int, w string")}, key)
    told = store.tables()["notes"]
    assert told.columns == ["id", "v", "w"] and told.where("w IS NOT NULL").count() == 1 and told.count() == 502
    store.tidy()
    assert store.tables()["notes"].count() == 502 and len(list((tmp_path / "store" / "state").glob("[0-9]*"))) == 1


def test_of_two_writers_one_gets_an_error(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    one.sync(lambda t: {"segments": spark.createDataFrame([(1, 10)], "id long, seconds long")})

    def meanwhile(tables):
        two.sync(lambda t: {"segments": t["segments"].withColumn("seconds", F.lit(20).cast("long"))})
        return {"segments": tables["segments"].withColumn("seconds", F.lit(30).cast("long"))}

    with pytest.raises(Conflict):
        one.sync(meanwhile)
    assert one.tables()["segments"].first()["seconds"] == 20 and one.state()["sync"] == 2
    assert len(list((tmp_path / "store" / "segments").iterdir())) == 2  # what the loser wrote is gone
    one.sync(lambda t: {"segments": t["segments"].withColumn("seconds", F.lit(30).cast("long"))})
    assert two.tables()["segments"].first()["seconds"] == 30


def test_a_state_that_was_not_finished_is_passed_over(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.sync(lambda t: {"segments": spark.createDataFrame([(1,)], "id long")})
    (tmp_path / "store" / "state" / "2").write_text('{"sync": 2, "tab')
    assert store.state()["sync"] == 1 and store.tables()["segments"].count() == 1
    store.sync(lambda t: {"segments": spark.createDataFrame([(1,), (2,)], "id long")})
    assert store.state()["sync"] == 3 and store.tables()["segments"].count() == 2


def test_an_unchanged_file_is_not_read_again(spark, tmp_path):
    import os

    folder, read = tmp_path / "accounts", []
    folder.mkdir()
    for name in ("a", "b"):
        (folder / name).write_text(f"{name} 1")

    def notes(files):
        read.append(sorted(r["path"][-1] for r in files.select("path").collect()))
        text = F.split(F.col("content").cast("string"), " ")
        return {"notes": files.select(text[0].alias("id"), text[1].cast("int").alias("v"))}

    store = Store(spark, f"file://{tmp_path}/store")
    go = lambda: store.merge_files(f"file://{folder}", notes, {"notes": ["id"]})
    held = lambda: {r["id"]: r["v"] for r in store.tables()["notes"].collect()}
    assert len(go()) == 2 and held() == {"a": 1, "b": 1}
    seen = os.stat(folder / "a")
    (folder / "a").write_text("a 9")  # as long, and then as old: not opened
    os.utime(folder / "a", ns=(seen.st_atime_ns, seen.st_mtime_ns))
    assert go() == [] and held() == {"a": 1, "b": 1} and store.state()["sync"] == 1
    (folder / "b").write_text("b 22")
    assert [p[-1] for p in go()] == ["b"] and held() == {"a": 1, "b": 22} and read == [["a", "b"], ["b"]]

    def broken(files):
        return {"notes": files.select(F.expr("cast(raise_error('stop') as string)").alias("id"), F.lit(1).alias("v"))}

    (folder / "b").write_text("b 333")
    with pytest.raises(Exception, match="stop"):
        store.merge_files(f"file://{folder}", broken, {"notes": ["id"]})
    assert [p[-1] for p in go()] == ["b"] and held()["b"] == 333  # what was not committed is read again


def test_migrations_widen_what_is_stored_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    old = {"pets": spark.createDataFrame([(1,)], "id long"), "transmog_tags": spark.createDataFrame([(7, "k")], "id long, key string"), "segments": spark.createDataFrame([(1,)], "id long")}
    store.sync(lambda t: old)
    assert len(store.state()["applied"]) == len(schema.MIGRATIONS)
    tables, applied = schema.migrate(old, [])
    assert applied == [n for n, _ in schema.MIGRATIONS]
    assert tables["pets"].columns == ["id", "species_first"] and tables["pets"].first()["species_first"] is None
    assert [tuple(r) for r in tables["transmog_tags"].collect()] == [("set", 7, "k")]
    assert tables["segments"].first()["experience_gained"] == 0
    again, _ = schema.migrate(tables, [])
    assert again["transmog_tags"].columns == tables["transmog_tags"].columns
    with pytest.raises(ValueError, match="newer"):
        schema.migrate(old, ["of the future"])


def test_fields_equal_a_scan_by_characters():
    def scan(text):
        out, begin, depth, quoted = [], 0, 0, False
        for i, c in enumerate(text):
            if c == '"':
                quoted = not quoted
            elif not quoted and c in "([":
                depth += 1
            elif not quoted and c in ")]":
                depth -= 1
            elif c == "," and not quoted and depth <= 0:
                out.append(text[begin:i])
                begin = i + 1
        return [f[1:-1] if len(f) > 1 and f[0] == f[-1] == '"' else f for f in [*out, text[begin:]]]

    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice('ab,,"([)]') for _ in range(rng.randrange(20)))
        assert L.split_fields(text) == scan(text)


def test_positions_follow_their_shape(spark):
    guid = "Player-1"
    old = f'1/2/2024 10:00:00.000  SWING_DAMAGE,{guid},"A",0x511,0x0,Creature-1,nil,0xa48,0x0,{guid},00,1,2,3,4,5,6,7,8,9,10,-1.50,2.25,nil,0.10,80,1'
    new = f'1/2/2024 10:00:01.000  SPELL_HEAL,Creature-1,nil,0xa48,0x0,{guid},"A",0x511,0x0,1,"S",0x2,{guid},00,1,2,3,4,5,6,7,8,9,10,11,12,3.50,4.25,84,0.10,80,1'
    other = new.replace("0x511", "0x514")
    plain = f'1/2/2024 10:00:02.000  SWING_DAMAGE,{guid},"A",0x511,0x0,Creature-1,nil,0xa48,0x0,120,1,2'
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate([old, new, other, plain])], "log string, line_no long, line string")
    got = [tuple(r) for r in L.positions(L.parse(df, 2024)).orderBy("line_no").select("line_no", "actor", "x", "y", "map_id").collect()]
    assert got == [(0, "A", -1.5, 2.25, None), (1, "A", 3.5, 4.25, 84)]


def test_combatants_by_arrangement(spark):
    line = "1/2/2024 10:00:00.000  COMBATANT_INFO,Player-1,1,5,6,253,[(1,2,1),(3,4,1)],(0,0,0,0),[(10,400,(),(7,8),()),(11,0,(),(),()),(12,410,(),(),())],[]"
    df = spark.createDataFrame([("l", 1, line), ("l", 2, "1/2/2024 10:00:00.000  COMBATANT_INFO,Player-2,0")], "log string, line_no long, line string")
    a, b = L.combatants(L.parse(df, 2024)).orderBy("line_no").collect()
    assert (a["guid"], a["faction"], a["spec_id"], a["n_talents"], len(a["worn"]), a["item_level"]) == ("Player-1", 1, 253, 2, 3, 405.0)
    assert a["worn"][0]["bonus"] == [7, 8]
    assert (b["spec_id"], b["n_talents"], b["worn"], b["item_level"]) == (None, 0, [], None)


def test_open_fights_are_closed_by_a_later_read(spark):
    fields = "log string, kind string, encounter_id long, line_no long, at long, mark string, success boolean"
    rng = random.Random(8)
    rows = [("l", "encounter", rng.randrange(2), i, i, rng.choice(["START", "END"]), True) for i in range(40)]
    whole = folded_fights(spark.createDataFrame(rows, fields))
    stored = folded_fights(spark.createDataFrame(rows[:17], fields))
    both = close_open_fights(stored, spark.createDataFrame(rows[17:], fields))
    cols = ("line_no", "started_at", "ended_at", "success")
    assert sorted(map(str, both.select(*cols).collect())) == sorted(map(str, whole.select(*cols).collect()))


def test_second_hash_of_a_set_is_no_continuation(spark):
    plan = C.fold_equal_sets(spark.createDataFrame([(1, 1)], "set_id long, ord long"), spark.createDataFrame([(1, 5)], "set_id long, member long"), ["ord"])
    text = plan._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(1, m" in text and "xxhash64(m#" in text


def test_game_texts(spark):
    row = spark.range(1).select(
        D.plain(F.lit("|cFFFFD200Vendor: |rUnger|n|cFFFFD200Zone: |rWetlands. |n|n")).alias("a"), D.without_escapes(F.lit("|Hitem:1|h[Sword]|h |Tx|t|cff|n")).alias("b"),
        D.parse_message(F.lit("You lose 3 (x)."), ["%d%% of %s", "You lose %d (%s)."]).alias("c"), D.parse_message(F.lit("no"), ["%s!"]).alias("d"),
        D.day_label(F.lit("not a day"), "2024-01-01").alias("e"), D.day_label(F.lit("2023-12-31"), "2024-01-01").alias("f"),
    ).first()
    assert row["a"] == "Vendor: Unger. Zone: Wetlands" and row["b"] == "[Sword] cffn"
    assert tuple(row["c"]) == ("x", 3) and row["d"] is None
    assert row["e"] == "not a day" and row["f"] == "Yesterday"
