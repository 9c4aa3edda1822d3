import datetime as dt
import json

from pyspark.sql import functions as F

from visitloom.operators import activity as A
from visitloom.operators import search as Q
from visitloom.sources import combat_logs as C
from visitloom.sources import folders
from visitloom.sources import saved_records as S
from visitloom.sources.tables import relations


def test_fields_nest_and_quote():
    assert C.split_fields('1,"a, b",(x,[y,z]),nil,') == ["1", "a, b", "(x,[y,z])", "nil", ""]


def test_stamps(spark):
    lines = ["3/4 12:00:01.250  MAP_CHANGE,7,\"Old, Town\",1,2,3,4", "3/4/2024 12:00:01.5-4  ENCOUNTER_START,12,x", "3/4/24 12:00:00  ENCOUNTER_END,12,x,8,20,1", "half a li", "2/30/2024 1:00:00.000  X"]
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate(lines)], "log string, line_no long, line string")
    got = {r["line_no"]: r for r in C.parse(df, 2023).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0]["at_ms"] == 1_677_931_201_250 and got[0]["fields"][1] == "Old, Town"
    assert got[1]["at_ms"] == 1_709_553_601_500 + 4 * 3_600_000
    marks = {r["mark"]: (r["encounter_id"], r["success"]) for r in C.marks(C.parse(df, 2023)).collect()}
    assert marks["END"] == (12, True)
    assert C.maps(C.parse(df, 2023)).collect()[0]["x1"] == 2.0


def test_saved_tables():
    text = 'Other = 1\nDB = { -- note\n ["a"] = { 1, 2, { x = "q\\"uote", y = nil, z = true } },\n b = [[long\ntext]], [7] = 0x10, e = {}, f = -1.5 }\n'
    assert S.to_value(text, "DB") == {"a": [1, 2, {"x": 'q"uote', "y": None, "z": True}], "b": "long\ntext", "7": 16, "e": {}, "f": -1.5}
    assert S.to_value("DB = { 1, ", "DB") is None and S.to_value("x", "DB") is None


def test_saved_file_to_visits(spark, tmp_path):
    (tmp_path / "a.lua").write_text('DB = { segments = { { id = "1", character = "A-B", endedAt = 10, unknown = 3 }, { id = "2" } } }')
    schema = f"segments array<{S.SEGMENT}>"
    told = S.normalise(S.entries(S.read(spark, str(tmp_path), "DB", schema), "segments", ("id",)))
    assert [(r["id"], r["instance"], r["startedAt"], r["seconds"]) for r in told.collect()] == [("1", "Unknown", 10, 0)]


def test_folders(spark, tmp_path):
    for n in ("CombatLog-1.txt", "combatlog.txt", "Shot_010224_030405.jpg"):
        (tmp_path / n).write_text("x")
    files = folders.listing(spark, str(tmp_path))
    assert folders.logs(files).count() == 2 and folders.shots(files).collect()[0]["at"] == 1_704_164_645
    texts = spark.createDataFrame([('SET adv "1"\n', 1), ("nothing", 9), ('SET adv "0"', 5)], "text string, modified_at long")
    assert folders.setting(texts, "adv").collect()[0][0] is False
    assert folders.setting(texts.where("modified_at = 9"), "adv").collect()[0][0] is False
    assert folders.setting(texts.limit(0), "adv").collect()[0][0] is None


def test_search_language():
    assert Q.parse('Plate colour:"dark red" :x cl:ma') == (["plate", ":x"], [("colour", "dark red"), ("cl", "ma")])


def test_growing_and_verdicts(spark):
    df = spark.range(1).select(A.gap_verdict(F.lit(None).cast("long"), F.lit(1), 0).alias("a"), A.gap_verdict(F.lit(1000), F.lit(700), 100_000).alias("b"), A.gap_verdict(F.lit(1001), F.lit(700), 100_000).alias("c"))
    assert tuple(df.collect()[0]) == ("unknown", "complete", "missing")


def test_activity_metadata_has_no_nulls(spark):
    row = [("v", 60, "Hall", "Mythic", "party", 8, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(row, "visit_id string, seconds long, instance string, difficulty string, instance_type string, difficulty_id long, keystone struct<level:long,on_time:boolean,duration_ms:long>, tier long, latest_tier long, experience struct<percent:double>, levels int, quests array<string>, delve struct<tier:long,started_at:long,completed_at:long>")
    got = A.infer(df).collect()
    assert [(r["kind"], r["confidence"]) for r in got] == [("mythic_plus", 0.5)]
    assert json.loads(got[0]["metadata"]) == {"durationSeconds": 60}


def test_tail_stamps_come_from_the_end_alone(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    line = "5/1/2024 22:%02d:05.000  SPELL_DAMAGE,Player-1,x\n"
    (folder / "long.txt").write_text("no log line\n" + "".join(line % (i % 50) for i in range(6000)) + line % 59 + "5/1/2024 23:10:06.000  SWING_D")
    (folder / "yearless name.txt").write_text("1/1 00:31:40.000  ZONE_CHANGE,1\nnot a line\n")
    (folder / "empty.txt").write_text("")
    (folder / "junk.txt").write_text("not a log line at all\n")
    files = folders.listing(spark, f"file://{folder}")
    told = {r["path"].rpartition("/")[2]: r["at_ms"] for r in folders.tail_stamps(files, 2019).collect()}
    stamp = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000)
    assert {k.replace("%20", " "): v for k, v in told.items()} == {"long.txt": stamp(2024, 5, 1, 23, 10, 6), "yearless name.txt": stamp(2019, 1, 1, 0, 31, 40)}
    gone = spark.createDataFrame([(f"file://{folder}/nothing.txt",)], "path string")
    assert folders.tail_stamps(gone, 2019).collect() == []


def test_views_are_listed_and_not_counted(spark):
    from pyspark.sql import SparkSession

    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.range(3).selectExpr("id", "assert_true(id < 0) AS fails").createOrReplaceTempView("failing")
    told = [r for r in relations(own, {"failing": ("id",)}).collect() if r["table_name"] == "failing"]
    assert [(r["column_name"], r["is_view"], r["primary_key"], r["row_count"]) for r in told] == [("id", True, True, None), ("fails", True, False, None)]
