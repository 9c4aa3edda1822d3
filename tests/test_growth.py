"""What held on small tables only: growth of plans, and values that small tables do not reach."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from visitloom.functions import scalars as X
from visitloom.operators import catalogue as C
from visitloom.operators import recursion as R
from visitloom.plans import registry
from visitloom.plans.records import _saved
from visitloom.scratch import Rounds
from visitloom.sources import saved_records as S


def test_rounds_of_a_recursion_broadcast_nothing(spark, monkeypatch):
    plans, save = [], Rounds.save

    def told(self, df, name=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name)

    monkeypatch.setattr(Rounds, "save", told)
    links = spark.range(1, 40).selectExpr("id AS src", "id div 3 AS dst")
    assert R.reached(links, spark.range(40).selectExpr("id AS seed")).where("seed = 27").count() == 5
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_sizes_stop_at_the_last_unit(spark, tmp_path):
    spark.createDataFrame([(k, "b", "t", 1) for k in (0, 1100, 1076384, 5000000)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    told = registry.queries()["size_texts"](spark, str(tmp_path))
    assert rows(told, "p_partkey", "size") == [(0, "1.0 KB"), (1100, "1.1 MB"), (1076384, "1026.5 MB"), (5000000, "4768.4 MB")]
    sizes = spark.createDataFrame([(n,) for n in (1023, 1024, 1 << 20, 1 << 30, 1 << 41)], "n long")
    assert [r[0] for r in sizes.select(X.file_size(F.col("n"))).collect()] == ["1023 B", "1.0 KB", "1.0 MB", "1.0 GB", "2048.0 GB"]


def test_each_saved_text_is_parsed_once(spark, monkeypatch):
    monkeypatch.setattr(Rounds, "save", (lambda save: lambda self, df, name=None: told.append(self.root) or save(self, df, name))(Rounds.save))
    told = []
    count = spark.sparkContext.accumulator(0)
    text = F.udf(lambda t: count.add(1) or t, "string").asNondeterministic()
    texts = spark.createDataFrame([(k, f'S = {{ characters = {{ a = {{ gold = {{ total = {k} }}, currencies = {{ ["7"] = {{ total = 2 }} }} }} }} }}') for k in range(9)], "k long, t string")
    read = S.parsed(texts.select("k", text("t").alias("t")), "t", "S", S.HOLDINGS)
    assert rows(S.wallets(read, "k").unionByName(S.held_currencies(read, "k"), allowMissingColumns=True).groupBy().count()) == [(18,)]
    assert count.value == 9 and len(told) == 1


def test_customers_are_dealt_to_all_cores(spark, sf_dir):
    assert _saved(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_odd_tables_of_a_saved_text():
    assert S.to_value('S = { [1] = "a", [2] = "b", x = { 1, nil, }, ["["] = 3, y = [[z]] --c\n} @', "S") == {"1": "a", "2": "b", "x": [1, None], "[": 3, "y": "z"}
    assert S.to_value("S = { 1, @ }", "S") is None and S.to_value("S = 5", "S") == 5 and S.to_value('S = { "open }', "S") is None


@pytest.mark.parametrize("name", ["log_positions", "log_combatants"])
def test_lines_of_a_log_are_split_once(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    steps = [line for line in plan.splitlines() if "ArrowEvalPython [" in line]
    assert sum("fields(" in line.split("], [")[0] for line in steps) == 1


def test_walks_that_ended_are_not_joined_by_their_root(spark):
    nodes = spark.range(50).selectExpr("id", "id div 3 AS parent", "string(id) AS name")
    told = C.paths(nodes, 4)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    on = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(on) == 4 and all("_key#" in line and "next#" not in line for line in on)
    assert told.where("root = 0").count() == 50 and told.where("id = 27").first()["path"] == "0/1/3/9/27"
