"""Connected components of an undirected graph, by alternating large and small stars.

Each round is two aggregations and a join on the edges and is written to the shared folder;
the number of rounds grows with the logarithm of the longest chain. Hubs are pre-aggregated
before the shuffle. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node that has an edge; the label is the smallest node reachable.

    ``edges`` has columns a and b, in any direction, repeats and loops allowed.
    """
    now = scratch.save(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), f"{name}-0")
    mark, k = _mark(now), 0
    while mark[0]:
        k += 1
        turned = _small_star(_large_star(now)).where(F.col("a") != F.col("b")).distinct()
        new = scratch.save(turned, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        before, mark = mark, _mark(new)
        now = new
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
