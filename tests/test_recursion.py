import random

import pytest
from conftest import rows

from visitloom.operators import recursion as R


def _plain(links, seeds):
    out = set()
    for s in {s for s in seeds if s is not None}:
        hops, edge = {s: 0}, [s]
        while edge:
            edge = [b for a in edge for x, b in links if x == a and b is not None and b not in hops and not hops.update({b: hops[a] + 1})]
        out |= {(s, n, h) for n, h in hops.items()}
    return sorted(out)


@pytest.mark.parametrize("merge_every", [1, 8])
def test_reached_equals_a_walk(spark, monkeypatch, merge_every):
    monkeypatch.setattr(R, "MERGE_EVERY", merge_every)
    rng = random.Random(merge_every)
    links = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(35)] + [(1, 1), (2, 3), (2, 3), (3, 2), (None, 4), (5, None)]
    seeds = [0, 1, 2, 3, 3, 17, 99, None]
    told = R.reached(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(s,) for s in seeds], "seed long"))
    assert rows(told, "seed", "node", "hops") == _plain(links, seeds)


def test_a_chain_longer_than_any_fixed_depth(spark):
    links = spark.range(30).selectExpr("id AS src", "id + 1 AS dst")
    told = R.reached(links, spark.createDataFrame([(0,)], "seed long"))
    assert rows(told, "node", "hops") == [(i, i) for i in range(31)]


def test_no_links_or_seeds(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert rows(R.reached(none, spark.createDataFrame([(7,)], "seed long")), "seed", "node", "hops") == [(7, 7, 0)]
    assert R.reached(none, spark.createDataFrame([], "seed long")).collect() == []
