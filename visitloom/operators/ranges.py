"""Joins on time ranges as equi-joins on time buckets.

A plain inequality join would compare all pairs. Here intervals are entered in every bucket
they touch, points in their own, and the exact condition is checked within a bucket. Bucket
width is a parameter: near the usual interval length, an interval enters one or two buckets.
Where one answer is wanted of many, a bucket's rows are sorted within a task (operators.cover) and no
pairs are formed, so that a fuller bucket costs about as much more as it holds more rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.operators import cover
from visitloom.operators.scan import joined
from visitloom.session import ship


def _touched(lo: Column, hi: Column, width: int) -> Column:
    first, last = F.floor(lo / width), F.floor(hi / width)
    return F.explode(F.when(last >= first, F.sequence(first, last)))


def _numpy(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


def _codes(left: pa.Table, right: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values of columns that both tables have; null is a value."""
    told = np.zeros(len(left) + len(right), dtype=np.int64)
    for name in names:
        both = pa.chunked_array([*left[name].chunks, *right[name].cast(left[name].type).chunks], type=left[name].type).combine_chunks()
        code = pc.dictionary_encode(both, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        told = np.unique(told * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
    return told[: len(left)], told[len(left) :]


def link_points(points: DataFrame, spans: DataFrame, width: int = 600, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each point (point_id, at, name) with the best span (span_id, lo, hi, name) that holds it, or null.

    Spans of the point's own name come first, then later starts, then larger ids.
    """
    ship(points.sparkSession)
    kept = [F.col(k).alias(f"_{k}") for k in keys]
    p = points.where("at IS NOT NULL").select("point_id", "at", F.col("name").alias("_name"), F.floor(F.col("at") / width).alias("_b"), *kept)
    s = spans.where("span_id IS NOT NULL").select("span_id", "lo", "hi", F.col("name").cast(points.schema["name"].dataType).alias("_name"), _touched(F.col("lo"), F.col("hi"), width).alias("_b"), *kept)
    by = ["_b", *[f"_{k}" for k in keys]]

    def linked(ps: pa.Table, ss: pa.Table) -> pa.Table:
        ss = ss.sort_by([("lo", "ascending"), ("span_id", "ascending")])
        at, lo, hi = _numpy(ps, "at"), _numpy(ss, "lo"), _numpy(ss, "hi")
        found = []
        for mine, theirs in (_codes(ps, ss, ["_name"]), (np.zeros(len(ps), np.int64), np.zeros(len(ss), np.int64))):
            order, first, last = cover.covered(mine, at, theirs, lo, hi)
            best = np.empty(len(ps), dtype=np.int64)
            best[order] = cover.painted(len(ps), first, last)
            found.append(best)
        own = (found[0] >= 0) & pc.is_valid(ps["_name"]).to_numpy()
        best = np.where(own, found[0], found[1])
        held = np.flatnonzero(best >= 0)
        span = ss.take(pa.array(best[held]))
        return pa.table({"point_id": ps["point_id"].take(pa.array(held)), "own": pa.array(own[held].astype(np.int32)), "lo": span["lo"], "span_id": span["span_id"]})

    told = T.StructType([p.schema["point_id"], T.StructField("own", T.IntegerType()), s.schema["lo"], s.schema["span_id"]])
    best = p.groupBy(*by).cogroup(s.groupBy(*by)).applyInArrow(linked, told)
    best = best.groupBy("point_id").agg(F.max_by("span_id", F.struct("own", "lo", "span_id")).alias("span_id"))
    return points.join(best, "point_id", "left")


def link_overlaps(fights: DataFrame, spans: DataFrame, width: int = 600) -> DataFrame:
    """Each fight (fight_id, a, b) with the span of longest overlap, then latest start; null if none.

    Spans and fights that end before they begin overlap nothing.
    """
    ship(fights.sparkSession)
    f = fights.where("a <= b").select("fight_id", "a", "b", _touched(F.col("a"), F.col("b"), width).alias("_b"))
    s = spans.where("lo <= hi AND span_id IS NOT NULL").select("span_id", "lo", "hi", _touched(F.col("lo"), F.col("hi"), width).alias("_b"))

    def linked(fs: pa.Table, ss: pa.Table) -> pa.Table:
        ss = ss.sort_by([("lo", "ascending"), ("span_id", "ascending")])
        best = np.full(len(fs), -1)
        if len(fs) and len(ss):
            best = cover.longest_overlap(_numpy(fs, "a"), _numpy(fs, "b"), _numpy(ss, "lo"), _numpy(ss, "hi"))
        met = np.flatnonzero(best >= 0)
        span = ss.take(pa.array(best[met]))
        return pa.table({**{c: fs[c].take(pa.array(met)) for c in ("fight_id", "a", "b")}, **{c: span[c] for c in ("span_id", "lo", "hi")}})

    told = T.StructType([f.schema[c] for c in ("fight_id", "a", "b")] + [s.schema[c] for c in ("span_id", "lo", "hi")])
    overlap = F.least("b", "hi") - F.greatest("a", "lo")
    best = f.groupBy("_b").cogroup(s.groupBy("_b")).applyInArrow(linked, told).groupBy("fight_id").agg(
        F.max(F.struct(overlap.alias("overlap"), "lo", "span_id")).alias("best")
    )
    best = best.select("fight_id", F.col("best.span_id").alias("span_id"), F.col("best.overlap").alias("overlap"))
    return fights.join(best, "fight_id", "left")


def place_nearest(moments: DataFrame, points: DataFrame, reach: int, key: str = "place_key") -> DataFrame:
    """Each moment (moment_id, at, key) with the nearest point (point_id, at, key) within ``reach``.

    Ties go to the earlier point, then to the smaller id. Moments without one keep nulls.
    """
    m = moments.withColumn("_b", F.explode(F.sequence(F.floor((F.col("at") - reach) / reach), F.floor((F.col("at") + reach) / reach))))
    p = points.select("point_id", F.col("at").alias("point_at"), F.col(key).alias("_key")).withColumn("_pb", F.floor(F.col("point_at") / reach))
    gap = F.abs(F.col("at") - F.col("point_at"))
    met = m.join(p, (F.col("_b") == F.col("_pb")) & (F.col(key) == F.col("_key")) & (gap <= reach))
    best = met.groupBy("moment_id").agg(F.min(F.struct(gap.alias("gap"), "point_at", "point_id")).alias("best"))
    best = best.select("moment_id", F.col("best.point_id").alias("point_id"), F.col("best.gap").alias("gap"))
    return moments.join(best, "moment_id", "left")


def drop_unanchored(points: DataFrame, anchors: DataFrame, halo: int, cutoff: int | None = None) -> DataFrame:
    """Points without those older than ``cutoff`` that have no anchor within ``halo`` of them."""
    a = anchors.select(F.col("at").alias("anchor_at")).distinct()
    a = a.withColumn("_ab", F.explode(F.sequence(F.floor((F.col("anchor_at") - halo) / halo), F.floor((F.col("anchor_at") + halo) / halo))))
    old = points if cutoff is None else points.where(F.col("at") < cutoff)
    near = (F.floor(F.col("at") / halo) == F.col("_ab")) & (F.abs(F.col("at") - F.col("anchor_at")) <= halo)
    doomed = old.join(a, near, "left_anti").select("point_id")
    return points.join(doomed, "point_id", "left_anti")


def pair_stamps(wanted: DataFrame, files: DataFrame, slips: tuple[int, ...] = (0, 1, -1)) -> DataFrame:
    """One-to-one pairing of moments (moment_id, at) with files (file_id, at).

    Passes in order of ``slips``: exact, then a second late, then a second early. Within a
    pass the moments of a second, by id, take its free files, by id; no file is taken twice.
    """
    left, free, out = wanted, files, None
    for slip in slips:
        turn = W.partitionBy("_s").orderBy("_id")
        m = left.select(F.col("moment_id").alias("_id"), (F.col("at") + slip).alias("_s")).withColumn("_n", F.row_number().over(turn))
        f = free.select(F.col("file_id").alias("_id"), F.col("at").alias("_s")).withColumn("_n", F.row_number().over(turn))
        got = m.withColumnRenamed("_id", "moment_id").join(f.withColumnRenamed("_id", "file_id"), ["_s", "_n"])
        got = got.select("moment_id", "file_id", F.lit(slip).alias("slip"))
        out = got if out is None else out.unionByName(got)
        left, free = left.join(got, "moment_id", "left_anti"), free.join(got, "file_id", "left_anti")
    return out


def bounded(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points between the first start and the last end of all spans; two scalars decide."""
    edge = spans.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if edge["lo"] is None:
        return points.limit(0)
    return points.where(F.col("at").between(edge["lo"], edge["hi"]))


#: Points of the order that intervals may have, from 0; open intervals reach to the last.
TOP = (1 << 40) - 1


def blocks_of(lo: Column, hi: Column) -> Column:
    """The few blocks (level, block), 2^level long and aligned to it, that make up lo to hi exactly."""
    start = F.struct(lo.alias("l"), (hi + 1).alias("r"), F.array().cast("array<struct<level:int,block:bigint>>").alias("held"))

    def step(acc, level):
        node = lambda b: F.array(F.struct(level.cast("int").alias("level"), b.alias("block")))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        open_ = acc["l"] < acc["r"]
        odd_l = open_ & (acc["l"] % 2 == 1)
        l2 = acc["l"] + odd_l.cast("long")
        odd_r = (l2 < acc["r"]) & (acc["r"] % 2 == 1)
        held = F.concat(acc["held"], F.when(odd_l, node(acc["l"])).otherwise(none), F.when(odd_r, node(acc["r"] - 1)).otherwise(none))
        return F.struct(F.shiftright(l2, 1).alias("l"), F.shiftright(acc["r"] - odd_r.cast("long"), 1).alias("r"), held.alias("held"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(40)), start, step, lambda acc: acc["held"])


#: Bits of the places of a wide block: 16,384 of them.
WIDE = 14
#: Bins that wide blocks are dealt to; a task holds one at a time.
BINS = 4096


def best_enclosing(points: DataFrame, spans: DataFrame, by: list[str], at: str, lo: str, hi: str, rank: Column, values: list[str]) -> DataFrame:
    """Points with the values of the highest-ranked span (lo to hi, null while open) that holds them; others go.

    The order is cut in wide blocks. A span meets points in its first and its last one, where a task sorts
    both sides (operators.cover); the blocks between are a segment tree's: a span enters the few nodes that
    make them up, each keeps its best span, and a block, not a point, looks into one node of each level in
    use. So long and open spans cost no more than short ones, a point moves once, and no pair of point
    and span is formed. Both are whole numbers from 0 to ``TOP``.
    """
    ship(points.sparkSession)
    block = lambda c: F.shiftright(c, WIDE)
    end = F.least(F.coalesce(F.col(hi), F.lit(TOP)), F.lit(TOP)).cast("long")
    s = spans.select(*by, F.struct(rank.alias("_rank"), F.struct(*values).alias("_value")).alias("_best"), F.col(lo).cast("long").alias("_lo"), end.alias("_hi")).where("_lo <= _hi")
    held = points.where(F.col(at).isNotNull()).withColumn("_wide", block(F.col(at).cast("long")))

    long = s.where(block("_hi") - block("_lo") > 1)
    cut = long.select(*by, "_best", F.explode(blocks_of(block("_lo") + 1, block("_hi") - 1)).alias("_node"))
    nodes = cut.groupBy(*by, "_node").agg(F.max("_best").alias("_through"))
    levels = sorted(r[0] for r in nodes.select("_node.level").distinct().collect())  # 41 at most
    looks = F.explode(F.transform(F.array(*[F.lit(x) for x in levels]), lambda k: F.struct(k.cast("int").alias("level"), F.call_function("shiftright", F.col("_wide"), k).alias("block"))))
    through = None
    if levels:
        asked = joined(held.select(*by, "_wide").distinct().withColumn("_node", looks), nodes, [*by, "_node"])
        through = asked.groupBy(*by, "_wide").agg(F.max("_through").alias("_through"))

    ends = s.withColumn("_wide", F.explode(F.array_distinct(F.array(block("_lo"), block("_hi")))))
    ranked = ends.schema["_best"].dataType["_rank"].dataType
    parts = [F.col(f"_best._rank.{f.name}") for f in ranked.fields] if isinstance(ranked, T.StructType) else [F.col("_best._rank")]
    kinds = [f.dataType for f in ranked.fields] if isinstance(ranked, T.StructType) else [ranked]
    ends = ends.withColumns({f"_r{i}": c.cast("int") if k == T.BooleanType() else c for i, (c, k) in enumerate(zip(parts, kinds, strict=True))})
    group, ranks, keep = [f"_by{i}" for i in range(len(by))], [f"_r{i}" for i in range(len(parts))], points.columns
    bin_ = F.pmod(F.xxhash64(*by, "_wide"), F.lit(BINS)).alias("_bin")
    text = [F.col(b).cast("string").alias(g) for b, g in zip(by, group, strict=True)]
    left = held.select(*points.columns, *text, "_wide", F.col(at).cast("long").alias("_at"), bin_)
    right = ends.select("_best", *text, "_wide", "_lo", "_hi", *ranks, bin_)

    def enclosed(ps: pa.Table, ss: pa.Table) -> pa.Table:
        order = pc.sort_indices(ss, sort_keys=[(r, "ascending") for r in ranks], null_placement="at_start")
        ss = ss.take(order)
        mine, theirs = _codes(ps, ss, [*group, "_wide"])
        order, first, last = cover.covered(mine, _numpy(ps, "_at"), theirs, _numpy(ss, "_lo"), _numpy(ss, "_hi"))
        best = np.empty(len(ps), dtype=np.int64)
        best[order] = cover.painted(len(ps), first, last)
        told = ps.select([*keep, "_wide"])
        return told.append_column("_best", ss["_best"].take(pa.array(best, mask=best < 0)))

    schema = T.StructType([*points.schema.fields, left.schema["_wide"], T.StructField("_best", ends.schema["_best"].dataType)])
    told = left.groupBy("_bin").cogroup(right.groupBy("_bin")).applyInArrow(enclosed, schema)
    best = F.col("_best")
    if through is not None:
        told = joined(told, through, [*by, "_wide"], "left")
        best = F.greatest("_best", "_through")
    told = told.withColumn("_best", best).where("_best IS NOT NULL")
    return told.select(*points.columns, *[F.col(f"_best._value.{v}").alias(v) for v in values])
