"""Latest reading wins, and what is summed over the latest readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def freshest(readings: list[DataFrame], keys: list[str], at: str = "at") -> DataFrame:
    """One row a key out of several sources: the newest reading, on a tie the deeper source.

    Sources are given shallow first; readings without a time count as time 0.
    """
    every = None
    for depth, df in enumerate(readings):
        one = df.withColumn("depth", F.lit(depth))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in keys]
    rank = F.struct(F.coalesce(F.col(at), F.lit(0)).alias("t"), F.col("depth").alias("d"), *[F.col(c).alias(f"v_{c}") for c in rest])
    best = every.groupBy(*keys).agg(F.max(rank).alias("best"))
    return best.select(*keys, *[F.col(f"best.v_{c}").alias(c) for c in rest])


def one_pot(readings: DataFrame, pot: str = "pot") -> DataFrame:
    """Account rollup of a pot's readings by actor.

    total sums the actors, or is the freshest reading alone (ties to the smaller actor) when
    any reading says the pot is shared; oldest is the oldest time.
    """
    fresh = F.struct(F.coalesce(F.col("at"), F.lit(-1)).alias("t"), (-F.col("actor")).alias("a"))
    return readings.groupBy(pot).agg(
        F.when(F.bool_or("shared"), F.max_by("total", fresh)).otherwise(F.sum("total")).alias("total"),
        F.min("at").alias("oldest"),
        F.coalesce(F.bool_or("shared"), F.lit(False)).alias("shared"),
        F.count("*").alias("n_readings"),
    )


def modal_best(standings: DataFrame, subject: str = "subject") -> DataFrame:
    """Best standing on the ladder most actors use (ties to the smaller name).

    Rows without a rank take no part; the best has the largest rank, then the largest current,
    then the smallest actor.
    """
    usable = standings.where(F.col("rank").isNotNull())
    ladders = usable.groupBy(subject, "ladder").agg(F.count("*").alias("n"))
    by_use = W.partitionBy(subject).orderBy(F.col("n").desc(), F.col("ladder").asc_nulls_first())
    modal = ladders.withColumn("_r", F.row_number().over(by_use)).where("_r = 1").select(F.col(subject).alias("_s"), F.col("ladder").alias("_l"))
    on_it = usable.join(modal, F.col(subject).eqNullSafe(F.col("_s")) & F.col("ladder").eqNullSafe(F.col("_l"))).drop("_s", "_l")
    best = W.partitionBy(subject).orderBy(F.col("rank").desc(), F.col("current").desc_nulls_last(), F.col("actor").asc())
    return on_it.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def account_gold(wallets: DataFrame, warband: DataFrame) -> DataFrame:
    """All wallets and the shared purse as one sum; null, not zero, if nothing was ever read."""
    every = wallets.select("gold", "at").unionByName(warband.select("gold", "at")).where(F.col("gold").isNotNull())
    return every.agg(F.sum("gold").alias("gold"), F.min("at").alias("oldest"), F.count("*").alias("n_readings"))


def latest_lockouts(saves: DataFrame, now: int) -> DataFrame:
    """For each (actor, activity) the binding lockout: latest expiry, then most kills, then difficulty.

    state is ``available`` once expired, ``locked`` if all encounters are down, else ``partial``.
    """
    binding = F.struct("expires_at", "killed", (-F.col("difficulty")).alias("d"))
    best = saves.groupBy("actor", "activity").agg(
        F.max("expires_at").alias("expires_at"), F.max_by("killed", binding).alias("killed"), F.max_by("total", binding).alias("total"),
        F.max_by("difficulty", binding).alias("difficulty"),
    )
    state = F.when(F.col("expires_at") <= now, "available").when(F.col("killed") >= F.col("total"), "locked").otherwise("partial")
    return best.withColumn("state", state)


def _field(name: str):
    return lambda s: s[name]


def merge_summaries(parts: DataFrame, key: str, order: str, sums: list[str], lasts: list[str], lists: list[str]) -> DataFrame:
    """Partial summaries of one visit to one row: sums, last non-null values, lists in order."""
    aggs = [F.sum(c).alias(c) for c in sums]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in lasts]
    aggs += [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), _field(c))).alias(c) for c in lists]
    return parts.groupBy(key).agg(*aggs)
