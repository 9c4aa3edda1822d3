import threading
import time

import pytest

from visitloom import workbench as WB
from visitloom.plans.recipes import RECIPES, register_history


@pytest.fixture(scope="module")
def view(spark):
    spark.range(100).selectExpr("id", "id * 0.5 as half", "if(id = 1, null, cast(id as string)) as note").createOrReplaceTempView("t")
    return spark


@pytest.mark.parametrize("sql", ["SELECT * FROM t", "/* a; b */ WITH q AS (SELECT 1 AS x) SELECT ';' AS s, x FROM q;", "VALUES (1), (2)", "EXPLAIN SELECT 1"])
def test_questions_pass(view, sql):
    WB.ask(view, sql)


@pytest.mark.parametrize("sql", ["DROP TABLE t", "SELECT 1; SELECT 2", "", "CREATE VIEW v AS SELECT 1", "INSERT INTO t VALUES (1)", "SET a=b", "WITH q AS (SELECT 1 AS id) INSERT INTO t SELECT * FROM q", "CACHE TABLE t", "SELECT :x", "SELECT nope FROM t"])
def test_others_are_refused(view, sql):
    with pytest.raises(WB.Refused):
        WB.ask(view, sql)


OUTSIDE = [
    "SELECT reflect('java.util.UUID', 'randomUUID')", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`",
    "SELECT try_reflect('java.lang.System', 'exit', 0)", "SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "SELECT id FROM t WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)", "SELECT id FROM t WHERE id IN (SELECT length(value) FROM text.`/etc/hostname`)",
    "WITH q AS (SELECT reflect('java.util.UUID', 'randomUUID') AS x) SELECT x FROM q", "EXPLAIN SELECT * FROM text.`/etc/hostname`", "EXPLAIN DROP TABLE t", "SELECT transform(array(1), x -> java_method('java.lang.Math', 'abs', x))",
    "SELECT id FROM t ORDER BY reflect('java.util.UUID', 'randomUUID')", "SELECT * FROM t LATERAL VIEW explode(array(reflect('a', 'b'))) AS x", "SELECT TRANSFORM (id) USING 'cat' AS (x) FROM t", "SELECT * FROM other.t", "SELECT spark_catalog.default.f(1)",
    "SELECT count(*) FILTER (WHERE reflect('a', 'b') = 'x') FROM t", "SELECT id, sum(id) OVER (ORDER BY java_method('a', 'b')) FROM t", "SELECT input_file_name() FROM t", "SELECT my_own(id) FROM t", "SELECT * FROM t JOIN text.`/etc/hostname` ON true", "VALUES (reflect('a', 'b'))",
]


@pytest.mark.parametrize("sql", OUTSIDE)
def test_nothing_outside_the_history_is_reached(view, sql):
    view.udf.register("my_own", lambda x: x)
    with pytest.raises(WB.Refused):
        WB.ask(view, sql)


INSIDE = [
    "SELECT upper(note), row_number() OVER (ORDER BY id) FROM t WHERE id IN (SELECT id + 1 FROM t) AND EXISTS (SELECT 1 FROM t b WHERE b.id = t.id) LIMIT 3", "SELECT * FROM t LATERAL VIEW explode(array(1, 2)) e AS x LIMIT 2",
    "SELECT a.id, count(*) FROM t a LEFT JOIN t b ON a.id = b.id - 1 GROUP BY ROLLUP (a.id) HAVING count(*) > 0", "SELECT id FROM t UNION ALL SELECT id FROM t INTERSECT SELECT 1", "SELECT * FROM (SELECT id % 3 AS k, half FROM t) PIVOT (sum(half) FOR k IN (0, 1))",
    "SELECT DISTINCT id FROM range(5) ORDER BY 1 OFFSET 1", "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 9) SELECT max(i) FROM n", "SELECT transform(array(1, 2), x -> x + 1), CASE WHEN true THEN 1 END, CAST('1' AS INT), current_date()",
    "SELECT T.id FROM T TABLESAMPLE (50 PERCENT) LIMIT 1", "SELECT percentile_approx(half, 0.5) FILTER (WHERE id > 3) FROM t", "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS v(x, y)", "SELECT k, v FROM t UNPIVOT (v FOR k IN (half)) LIMIT 1",
]


@pytest.mark.parametrize("sql", INSIDE)
def test_the_language_of_questions_stays_whole(view, sql):
    assert WB.ask(view, sql, seconds=60).rows


def test_relations_can_be_named_one_by_one(view):
    assert WB.ask(view, "SELECT max(id) FROM t", relations={"T"}).rows == [[99]]
    with pytest.raises(WB.Refused, match="no relation t"):
        WB.ask(view, "SELECT max(id) FROM t", relations={"u"})


def test_equal_keys_are_still_broadcast(view):
    plan = view.sql("SELECT * FROM t a JOIN t b ON a.id = b.id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert len(WB.ask(view, "SELECT * FROM t a JOIN t b ON a.id = b.id", seconds=60).rows) == 100


def test_truncation_is_observed(view):
    a = WB.ask(view, "SELECT * FROM t ORDER BY id", 10)
    assert len(a.rows) == 10 and a.truncated and WB.kinds(a) == ["number", "number", "text"]
    assert not WB.ask(view, "SELECT * FROM t", 100).truncated


def test_cells():
    assert WB.cell(float("nan")) is None and WB.cell(b"abc") == "⟨3 bytes⟩" and len(WB.cell("x" * 5000)) == 2001


ENDLESS = "SELECT count(*) FROM range(10000000) a, range(10000000) b WHERE (a.id * b.id) % 7 = 1"


def _active(spark):
    tracker = spark.sparkContext.statusTracker()
    return len(tracker.getActiveJobsIds())


def test_timeout(view):
    began = time.monotonic()
    with pytest.raises(WB.Refused, match="Stopped after 1 seconds"):
        WB.ask(view, ENDLESS, seconds=1.0)
    assert time.monotonic() - began < 5
    until = time.monotonic() + 60
    while _active(view) and time.monotonic() < until:
        time.sleep(0.2)
    assert not _active(view)  # the job is gone, not only its caller
    assert WB.ask(view, "SELECT 1 AS one").rows == [[1]]


def test_a_stop_from_outside_is_not_a_deadline(view):
    def stop():
        for _ in range(200):
            time.sleep(0.1)
            if _active(view):
                view.sparkContext.cancelAllJobs()
                return

    threading.Thread(target=stop, daemon=True).start()
    with pytest.raises(Exception) as e:
        WB.ask(view, ENDLESS, seconds=50.0)
    assert "Stopped after" not in str(e.value)


def test_scale():
    assert WB.nice_scale(0, 97) == [0, 20, 40, 60, 80, 100]
    assert WB.nice_scale(4, 4) == [2, 3, 4, 5, 6] and WB.nice_scale(0, 0)[0] == -1
    assert WB.nice_scale(float("inf"), 0) == [0, 1]


def test_axes_and_charts():
    a = WB.Answer(["day", "n"], [["mon", 3], ["tue", None], ["a very long name indeed", 5]], False, 1)
    axes = WB.default_axes(a)
    assert axes == WB.Axes(0, 1, "bar")
    told = WB.chart(a, axes)
    assert told.skipped == 1 and told.y_ticks[0] == 0 and told.x_ticks[-1][1] == "a very long nam…"
    pair = WB.Answer(["level", "minutes"], [[3, 20.5], [1, 30.0]], False, 1)
    assert WB.default_axes(pair) == WB.Axes(0, 1, "scatter")
    assert [p[1] for p in WB.chart(pair, WB.default_axes(pair)).points] == [1, 3]
    assert WB.default_axes(WB.Answer(["a"], [["x"]], False, 1)) is None
    assert WB.recipe_axes(pair, WB.Recipe("r", "", "", "minutes", "gone")) is None
    many = WB.Answer(["d", "n"], [[f"d{i}", i] for i in range(100)], False, 1)
    ticks = WB.chart(many, WB.default_axes(many)).x_ticks
    assert len(ticks) <= 13 and ticks[-1][1] == "d99"


@pytest.mark.parametrize("recipe", RECIPES, ids=lambda r: r.name)
def test_recipes_are_questions(spark, sf_dir, recipe):
    register_history(spark, sf_dir)
    answer = WB.ask(spark, recipe.sql, seconds=60)
    assert answer.columns and answer.rows
    if recipe.x:
        assert WB.recipe_axes(answer, recipe)


def test_everything_quotes(spark):
    spark.range(60).createOrReplaceTempView("order")
    answer = WB.ask(spark, WB.everything("order").sql, seconds=60)
    assert len(answer.rows) == 50
