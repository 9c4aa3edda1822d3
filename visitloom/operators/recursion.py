"""Reachability over a table of links, to any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.scratch import Rounds

#: Rounds after which those found so far are written as one table again.
MERGE_EVERY = 8


def reached(links: DataFrame, seeds: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(seed, node, hops): all nodes that each seed reaches over (src, dst) links, itself at 0 hops.

    Semi-naive: each round joins only the pairs found in the round before with the links, takes off
    those known already, and writes what is new; the first round that finds nothing is the last. So
    cycles end, no depth has to be known, and ``hops`` is the fewest. A round's pairs are a table in
    the shared folder: lineage does not grow, and a lost executor repeats its part of one round. Its
    joins are told to shuffle and merge: files of few bytes may hold many pairs, and a plan that
    broadcast every known table would hold them all in the driver at once.
    Seeds and links with a null end reach nothing by it; repeated seeds and links count once.
    """
    spark = links.sparkSession
    rounds = rounds or Rounds(spark, "reached")
    kind = links.schema["dst"].dataType
    edges = rounds.save(links.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "links")
    start = seeds.select("seed").where("seed IS NOT NULL").distinct()
    fresh = rounds.save(start.select("seed", F.col("seed").cast(kind).alias("node"), F.lit(0).cast("long").alias("hops")), "round_0")
    found, merged, k = [fresh], 0, 0
    while not fresh.isEmpty():
        k += 1
        step = fresh.join(edges.hint("merge"), F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        step = step.join(_union(found).select("seed", "node").hint("merge"), ["seed", "node"], "left_anti")
        fresh = rounds.save(step.withColumn("hops", F.lit(k).cast("long")), f"round_{k}")
        found.append(fresh)
        if len(found) > MERGE_EVERY:
            found = [rounds.save(_union(found), f"merged_{merged}")]
            merged += 1
    return _union(found)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
