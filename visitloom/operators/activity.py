"""What somebody was doing in a visit, inferred from what the visit recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.functions.scalars import hunt
from visitloom.operators.catalogue import first_few

# Difficulties by which runs are recognised, and how much of a level counts as levelling.
KEYSTONE_DIFFICULTY = 8
DELVE_DIFFICULTY = 208
LEVELLING_SHARE = 0.05


def _one(kind: str, confidence, when: Column, **facts) -> Column:
    """An activity if ``when`` holds; facts that are null stay out of its metadata."""
    details = F.to_json(F.struct(*[v.alias(k) for k, v in facts.items()])) if facts else F.lit("{}")
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.when(when, F.struct(F.lit(kind).alias("kind"), sure.cast("double").alias("confidence"), details.alias("metadata")))


def infer(visits: DataFrame, key: str = "visit_id") -> DataFrame:
    """(key, kind, confidence, metadata) of each visit: none, one or several activities.

    Five rules, each an expression that yields a struct or null; no rule sees another's answer.
    """
    ran = F.col("keystone").isNotNull()
    keyed = ran | ((F.col("instance_type") == "party") & (F.col("difficulty_id") == KEYSTONE_DIFFICULTY))
    keystone = _one(
        "mythic_plus", F.when(ran, 1.0).otherwise(0.5), F.coalesce(keyed, F.lit(False)), keystoneLevel=F.col("keystone.level"), timed=F.col("keystone.on_time"),
        durationSeconds=F.coalesce(F.expr("keystone.duration_ms div 1000"), F.col("seconds")),
    )
    tiers = F.col("tier").isNotNull() & F.col("latest_tier").isNotNull()
    current = tiers & (F.col("tier") >= F.col("latest_tier"))
    raid = F.when(
        F.col("instance_type") == "raid",
        F.struct(
            F.when(current, "progress_raid").otherwise("legacy_raid").alias("kind"), F.when(tiers, 0.9).otherwise(0.4).cast("double").alias("confidence"),
            F.to_json(F.struct(F.col("instance").alias("raid"), F.col("difficulty").alias("difficulty"))).alias("metadata"),
        ),
    )
    gained = F.coalesce(F.col("experience.percent"), F.lit(0.0))
    levels = F.coalesce(F.col("levels"), F.lit(0))
    levelling = _one("levelling", 1.0, (levels > 0) | (gained >= LEVELLING_SHARE), percentOfLevel=F.round(gained * 100, 1), levelsGained=levels)
    hunts = F.filter(F.transform(F.coalesce("quests", F.array().cast("array<string>")), lambda q: F.struct(hunt(q)[0].alias("title"), hunt(q)[1].alias("difficulty"))), lambda h: h["title"].isNotNull())
    last = F.element_at(hunts, -1)
    prey = F.when(F.size(hunts) > 0, F.struct(
        F.lit("prey").alias("kind"), F.when(last["difficulty"].isNotNull(), 0.9).otherwise(0.6).cast("double").alias("confidence"),
        F.to_json(F.struct(last["title"].alias("title"), last["difficulty"].alias("difficulty"), F.size(hunts).alias("huntsCompleted"))).alias("metadata"),
    ))
    delved = (F.col("instance_type") == "scenario") & (F.col("difficulty_id") == DELVE_DIFFICULTY)
    delve = _one(
        "delve", F.when(F.col("delve.tier").isNotNull(), 1.0).otherwise(0.5), F.coalesce(delved, F.lit(False)), delve=F.col("instance"), tier=F.col("delve.tier"),
        durationSeconds=F.coalesce(F.when(F.col("delve.completed_at") >= F.col("delve.started_at"), F.col("delve.completed_at") - F.col("delve.started_at")), F.col("seconds")),
    )
    told = visits.select(key, F.explode(F.array_compact(F.array(keystone, raid, levelling, prey, delve))).alias("a"))
    return told.select(key, "a.kind", "a.confidence", "a.metadata")


def growing(observations: DataFrame, now: int, fresh: int = 3600) -> DataFrame:
    """Whether each log is being written: renamed, grown, or touched within ``fresh`` of now."""
    from pyspark.sql import Window as W

    w = W.partitionBy("folder").orderBy("seen_at")
    moved = ~F.lag("name").over(w).eqNullSafe(F.col("name")) & F.lag("seen_at").over(w).isNotNull()
    grown = F.col("bytes") > F.lag("bytes").over(w)
    near = F.abs(F.lit(now) - F.col("modified_at")) <= fresh
    return observations.withColumn("growing", F.coalesce(moved, F.lit(False)) | F.coalesce(grown, F.lit(False)) | F.coalesce(near, F.lit(False)))


def gap_verdict(played_to: Column, recorded_to: Column, now: int, quiet: int = 3600, slack: int = 300) -> Column:
    """unknown, live, complete or missing: whether play went on after the last recorded visit."""
    return (
        F.when(played_to.isNull() | recorded_to.isNull(), "unknown")
        .when(F.abs(F.lit(now) - played_to) <= quiet, "live")
        .when(played_to - recorded_to <= slack, "complete")
        .otherwise("missing")
    )


def retention_plan(logs: DataFrame, cursors: DataFrame, days: int, now: int) -> DataFrame:
    """Verdict of each log: the newest is active, unread and half-read ones stay, old read ones go."""
    newest = logs.agg(F.max(F.struct("modified_at", "name"))["name"].alias("_newest"))
    told = logs.join(cursors.select("name", F.col("offset").alias("_o")), "name", "left").crossJoin(newest)
    old = F.col("modified_at") < now - days * 86_400
    verdict = (
        F.when(F.col("name") == F.col("_newest"), "active").when(F.col("_o").isNull(), "unread").when(F.col("_o") < F.col("bytes"), "partial").when(old, "doomed").otherwise("kept")
    )
    return told.withColumn("verdict", verdict).drop("_o", "_newest")


def piles(plan: DataFrame, most: int = 10) -> DataFrame:
    """Count, bytes and first names of each verdict."""
    counts = plan.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    few = first_few(plan, "verdict", ["modified_at", "name"], "name", most)
    return counts.join(few, F.col("verdict").eqNullSafe(F.col("_by"))).select("verdict", "n", "bytes", F.col("few").alias("first_names"))


def census_verdict(complete: Column, counted: Column, held: Column) -> tuple[Column, Column]:
    """Verdict of a claim, and by how much the client counts more than is held."""
    word = F.when(complete.isNull(), "unwalked").when(complete, "whole").otherwise("partial")
    return word, F.when(counted > held, counted - held)
