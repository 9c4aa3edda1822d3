"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the budget by its weight. Sources whose share exceeds
``max_epochs`` times their size are clamped there and the excess is shared again by weight
among the rest, until none is above. A source then repeats ``whole`` times in full, and the
fraction left is sampled: its documents in a seeded hash order, up to the fraction.

The order is never built as a whole. Documents fall into hash bins of about BIN_ROWS rows, the
bins of a source are summed where the rows lie, and only the one bin in which the fraction ends
is ranked. Then ``settle`` rounds flip the one document of each source whose size comes nearest
to what is still missing or too much, so small sources come near their targets too.

Defined results: null text has size 0; the null source is a source of its own and comes last;
an empty table gives an empty mix; rows of one doc_id and source, whatever their texts, are one
document, whose size is their sum and which is taken whole or not at all; documents that share
a place in the hash order (a null doc_id of several sources) are in different sources, and ties
of the settling flip go to the smaller hash; a very long text is a document like others, and a
target may be missed by half its size; clashing columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.llm.common import Scratch, aside, word_count

WEIGHTS = (3, 1, 2)
BIN_ROWS = 100_000


def source_targets(sizes: DataFrame, budget: float, scratch: Scratch, weights=WEIGHTS, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) of each source, from (source, size) rows.

    One row for each source, saved once; the loop takes only sums of that small table to the driver.
    """
    totals = scratch.save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).coalesce(1), "totals")
    order = W.orderBy(F.col("source").asc_nulls_last())
    ordinal = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (ordinal % len(weights) + 1).cast("int"))
    table = totals.withColumn("weight", weight)
    total = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    amount = total * budget
    cap = F.col("source_size") * max_epochs
    clamped = F.lit(False)
    while True:
        # what is clamped leaves the budget and the weights of the others
        told = table.select("*", clamped.alias("held")).agg(
            F.coalesce(F.sum(F.when(F.col("held"), cap)), F.lit(0)).alias("held"),
            F.sum(F.when(~F.col("held"), F.col("weight"))).alias("free"),
        ).first()
        if told["free"] is None:
            share = cap.cast("double")
            break
        share = (F.col("weight") * F.lit(float(amount - told["held"]))) / F.lit(float(told["free"]))
        more = clamped | (share > cap)
        grown = table.where(more & ~clamped).limit(1).count()
        if not grown:
            break
        clamped = more
    target = F.when(clamped, cap.cast("double")).otherwise(share)
    return table.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def hash_order(seed: int) -> Column:
    """Seeded 128-bit order of documents, the same in any engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _units(documents: DataFrame, seed: int, scratch: Scratch, budget: float, weights, max_epochs: int, settle: int) -> DataFrame:
    """(doc_id, source, size, rows, h, source_size, target, repeats) of each document."""
    sizes = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    units = sizes.groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    units = scratch.save(units.select("*", hash_order(seed).alias("h")), "units")
    targets = scratch.save(source_targets(units, budget, scratch, weights, max_epochs).coalesce(1), "targets")
    digits = min(6, max(2, math.ceil(math.log(max(1, units.count()) / BIN_ROWS + 1, 16)) + 1))

    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("whole", F.floor(epochs).cast("int"))
    plan = plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).select(
        F.col("source").alias("src"), "source_size", "target", "whole", "need"
    )
    bin_of = F.conv(F.substring("h", 1, digits), 16, 10).cast("int")
    keyed = units.withColumn("bin", bin_of)
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))  # 16**digits rows a source at most
    run = W.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("below", F.sum("bin_size").over(run) - F.col("bin_size"))
    ends = bins.join(plan, F.col("source").eqNullSafe(F.col("src")))
    ends = ends.groupBy("source").agg(
        # the last bin that begins below what is needed; bins before it are taken whole
        F.max(F.when(F.col("below") < F.col("need"), F.col("bin"))).alias("end_bin"),
        F.max(F.when(F.col("below") < F.col("need"), F.col("below"))).alias("end_below"),
    ).select(F.col("source").alias("end_source"), "end_bin", "end_below")
    plan = scratch.save(
        plan.join(ends, F.col("src").eqNullSafe(F.col("end_source")), "left").drop("end_source").coalesce(1), "plan"
    )

    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("src")))
    in_end = rows.where(F.col("bin") == F.col("end_bin"))
    upto = W.partitionBy("source").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    in_end = in_end.withColumn("upto", F.col("end_below") + F.sum("size").over(upto))
    # the document that crosses the end is taken if that comes nearer
    in_end = in_end.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("need")).cast("int")).drop("upto")
    others = rows.where(~F.col("bin").eqNullSafe(F.col("end_bin")))
    others = others.withColumn("extra", F.coalesce(F.col("bin") < F.col("end_bin"), F.lit(False)).cast("int"))
    kept = ("doc_id", "source", "size", "rows", "h", "source_size", "target", "whole", "need", "extra")
    chosen = scratch.save(in_end.unionByName(others).select(*kept), "chosen0")
    for k in range(1, settle + 1):
        chosen = scratch.save(_settled(chosen), f"chosen{k}")
        scratch.drop(f"chosen{k - 1}")
    scratch.drop("units", "targets", "totals", "plan")
    return chosen.withColumn("repeats", F.col("whole") + F.col("extra"))


def mix(documents: DataFrame, budget: float = 1.5, weights=WEIGHTS, max_epochs: int = 2, seed: int = 17, settle: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Every document row with size, source_size, target and the repeats it gets."""
    units = _units(documents, seed, scratch or Scratch(documents.sparkSession, "mix"), budget, weights, max_epochs, settle)
    out = ("doc_id", "source", "size", "source_size", "target", "repeats")
    if units.where("rows > 1").limit(1).count() == 0:
        return units.select(*out)
    # a row for each row of the documents, each with its own size
    fate = units.select(F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_source"), "source_size", "target", "repeats")
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    same = rows["doc_id"].eqNullSafe(fate["mix_doc"]) & rows["source"].eqNullSafe(fate["mix_source"])
    return rows.join(fate, same).select(*out)


def _settled(chosen: DataFrame) -> DataFrame:
    """One flip a source, of the document that brings the sum nearest to the need, if any does."""
    gap = chosen.groupBy("source").agg(
        (F.max("need") - F.sum(F.col("extra") * F.col("size"))).alias("gap")
    ).select(F.col("source").alias("src"), "gap")
    rows = chosen.join(gap, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    free = (F.col("extra") == F.when(F.col("gap") > 0, 0).otherwise(1)) & (F.col("size") > 0)
    left = F.abs(F.abs(F.col("gap")) - F.col("size"))
    best = rows.where(free & (left < F.abs(F.col("gap")))).groupBy("source").agg(
        F.min(F.struct(left.alias("left"), "h", "doc_id")).alias("best")
    ).select(F.col("source").alias("src"), F.col("best.h").alias("flip"), F.col("best.doc_id").alias("flip_doc"))
    out = chosen.join(best, chosen["source"].eqNullSafe(best["src"]), "left")
    flip = F.coalesce((F.col("h") == F.col("flip")) & F.col("doc_id").eqNullSafe(F.col("flip_doc")), F.lit(False))
    return out.withColumn("extra", F.when(flip, 1 - F.col("extra")).otherwise(F.col("extra"))).select(*chosen.columns)


def mixed_documents(documents: DataFrame, budget: float = 1.5, weights=WEIGHTS, max_epochs: int = 2, seed: int = 17, settle: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """The mix itself: each document row as often as it is taken, with the columns of documents."""
    told = _units(documents, seed, scratch or Scratch(documents.sparkSession, "mix"), budget, weights, max_epochs, settle)
    told = told.select(F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_source"), "repeats")
    docs, own = aside(documents, "mix_doc", "mix_source", "repeats", "copy")
    same = docs["doc_id"].eqNullSafe(told["mix_doc"]) & docs["source"].eqNullSafe(told["mix_source"])
    out = docs.join(told.where(F.col("repeats") > 0), same)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*own)
