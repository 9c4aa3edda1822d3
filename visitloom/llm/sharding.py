"""Sharding by histogram sort: byte-balanced key ranges, one exchange [native].

Documents are ordered by (key, doc_id), the key being the first 60 bits of the text's MD5, so
equal texts lie together. Splitters are found by counting, not by sorting: a round counts the
exact bytes below each of 2**BITS candidate boundaries inside every interval that still holds
an unplaced splitter; a splitter is placed when the bytes below a candidate come within the
tolerance of its target, and the rest descend into the candidate's interval. When one key
alone holds more than the tolerance (a hot group of copies), probing goes on within that key
by doc_id, so no group can overfill a shard. Only then do rows move, once.

A shard is numbered in cells, ranges of the key of about CELL rows, and a cell that a hot group
fills in parts dealt by doc_id. Cells and parts are counted first, so a row's slot is its number
within its part plus the rows of the parts before, and no shard needs to fit in one task.

The driver sees at most (shards - 1) * 2**BITS sums a round, whatever the input; what is
broadcast are the counts of at most 2**MAX_CELL_BITS + shards cells.

Defined results: null text counts no bytes; an empty table gives no shards; equal texts (ties of
the key) are ordered by doc_id, nulls first, and repeated rows stay together; a text larger than
a shard's share fills its shard beyond the share, since rows are never cut; clashing columns are
replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.llm.common import Scratch, drop_clashing

KEY_BITS = 60
BITS = 10
#: A splitter may miss its target by this part of a shard.
TOLERANCE = 0.005
OVERHEAD = 16
#: Rows of a shard are numbered in cells of about so many.
CELL = 100_000
MAX_CELL_BITS = 16


def text_key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def _place(sizes: DataFrame, col: str, lo: int, bits: int, targets: dict[int, float], slack: float) -> dict[int, tuple[int, float, float]]:
    """Splitter -> (boundary, bytes below it, bytes at the boundary value if it must be split).

    A boundary b puts rows with col < b below. Rows of ``sizes`` have lo <= col < lo + 2**bits.
    Bytes at the value are 0 for a placed splitter, else those of the single value b that
    holds the target inside.
    """
    open_at: dict[int, dict[int, float]] = {lo: dict(targets)}  # interval start -> splitter -> bytes wanted in it
    base: dict[int, float] = {lo: 0.0}
    placed: dict[int, tuple[int, float, float]] = {}
    while open_at:
        step = max(0, bits - BITS)
        # 2**bits at a time: the interval of a row, then the probe within it
        start = F.shiftright(F.col(col) - lo, bits)
        live = sorted({(k - lo) >> bits for k in open_at})
        probe = F.shiftright(F.col(col) - lo, step)
        rows = sizes.where(start.isin(live)) if len(live) < 4096 else sizes
        counted = rows.groupBy(probe.alias("probe")).agg(F.sum("size").alias("bytes")).collect()
        by_interval: dict[int, list[tuple[int, int]]] = {}
        for r in counted:
            by_interval.setdefault(lo + ((r["probe"] << step) >> bits << bits), []).append((lo + (r["probe"] << step), r["bytes"]))
        deeper: dict[int, dict[int, float]] = {}
        deeper_base: dict[int, float] = {}
        for k, wanted in open_at.items():
            cells = sorted(by_interval.get(k, []))
            upto = [0, *accumulate(b for _, b in cells)]
            for splitter, want in wanted.items():
                i = min(max(bisect_right(upto, want) - 1, 0), max(len(cells) - 1, 0))
                if not cells:
                    placed[splitter] = (k, base[k], 0.0)
                    continue
                cell, nbytes = cells[i]
                before, after = upto[i], upto[i] + nbytes
                near_after = after - want < want - before
                miss = min(want - before, abs(after - want))
                if miss <= slack:
                    at = cell + (1 << step) if near_after else cell
                    placed[splitter] = (at, base[k] + (after if near_after else before), 0.0)
                elif step == 0:
                    placed[splitter] = (cell, base[k] + before, float(nbytes))
                else:
                    deeper.setdefault(cell, {})[splitter] = want - before
                    deeper_base[cell] = base[k] + before
        open_at, base, bits = deeper, deeper_base, step
    return placed


def splitters(sizes: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int | None]]:
    """shards - 1 boundaries (key, doc_id or None): rows from there on belong to the next shard.

    ``sizes`` has key, doc_id and size and should be a stored table: every round reads it.
    """
    total = sizes.agg(F.sum("size")).first()[0]
    if not total:
        return []
    slack = tolerance * total / shards
    targets = {i: total * i / shards for i in range(1, shards)}
    found = _place(sizes, "key", 0, KEY_BITS, targets, slack)
    out: dict[int, tuple[int, int | None]] = {i: (b, None) for i, (b, _, inside) in found.items() if not inside}
    hot: dict[int, dict[int, float]] = {}
    below: dict[int, tuple[float, float]] = {}
    for i, (b, under, inside) in found.items():
        if inside:
            hot.setdefault(b, {})[i] = targets[i] - under
            below[b] = (under, inside)
    for key, wanted in hot.items():  # at most shards - 1 keys
        group = sizes.where((F.col("key") == key) & F.col("doc_id").isNotNull())
        ends = group.agg(F.min("doc_id"), F.max("doc_id"), F.sum("size")).first()
        if ends[0] is None or ends[0] == ends[1]:
            placed = {}
        else:
            lo, bits = ends[0], max(1, (ends[1] - ends[0]).bit_length())
            nulls = below[key][1] - ends[2]  # rows without doc_id come first
            placed = _place(group, "doc_id", lo, bits, {i: max(0.0, w - nulls) for i, w in wanted.items()}, slack)
        for i, want in wanted.items():
            if i in placed:
                at, under, inside = placed[i]
                out[i] = (key, at + 1 if inside and want - under > inside / 2 else at)
            else:  # one row, or equal rows: the nearer side
                out[i] = (key + 1 if want > below[key][1] / 2 else key, None)
    marks = [out[i] for i in range(1, shards)]
    return [max(marks[: k + 1], key=lambda m: (m[0], m[1] is not None, m[1] or 0)) for k in range(len(marks))]


def shard_column(marks: list[tuple[int, int | None]]) -> Column:
    """Number of splitters at or below the row: its shard."""
    at = F.lit(0)
    for key, doc in marks:
        past = F.col("key") > key
        here = F.col("key") == key
        at = at + (past | here if doc is None else past | (here & F.coalesce(F.col("doc_id") >= doc, F.lit(False)))).cast("int")
    return at


def _offsets(placed: DataFrame, scratch: Scratch, cell_rows: int) -> DataFrame:
    """(shard, cell, parts, part, before): the cells' parts and the rows of the shard before each."""
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("rows"))
    cells = scratch.save(cells.select("shard", "cell", F.ceil(F.col("rows") / cell_rows).cast("int").alias("parts")), "cells")
    # left joins: every row has its cell, and an inner join would test the keys where the texts are read
    known = placed.join(F.broadcast(cells), ["shard", "cell"], "left")  # at most 2**MAX_CELL_BITS + shards rows
    parts = known.groupBy("shard", "cell", "parts", _part().alias("part")).agg(F.count("*").alias("rows"))
    before = W.partitionBy("shard").orderBy("cell", "part").rowsBetween(W.unboundedPreceding, -1)
    # a row for about cell_rows rows
    return scratch.save(parts.select("shard", "cell", "parts", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")), "offsets")


def _part() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.col("parts")).cast("int")


def shard(documents: DataFrame, shards: int = 40, tolerance: float = TOLERANCE, cell_rows: int = CELL, scratch: Scratch | None = None) -> DataFrame:
    """Documents with size, text_crc32, shard and slot; the rows move once, into their cells."""
    scratch = scratch or Scratch(documents.sparkSession, "shard")
    docs = drop_clashing(documents, "size", "text_crc32", "shard", "slot", "key", "cell", "part", "parts", "before")
    keyed = docs.select("*", byte_size(F.col("text")).alias("size"), text_key(F.col("text")).alias("key"))
    sizes = scratch.save(keyed.select("key", F.col("doc_id").cast("long").alias("doc_id"), "size"), "sizes")
    marks = splitters(sizes, shards, tolerance)
    bits = min(MAX_CELL_BITS, max(1, math.ceil(sizes.count() / cell_rows)).bit_length())
    where = {"shard": shard_column(marks), "cell": F.shiftright("key", KEY_BITS - bits).cast("int")}
    offsets = _offsets(sizes.withColumns(where), scratch, cell_rows)
    scratch.drop("sizes", "cells")
    cells = offsets.select("shard", "cell", "parts").distinct()  # at most 2**MAX_CELL_BITS + shards rows
    placed = keyed.withColumns(where).withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    placed = placed.join(F.broadcast(cells), ["shard", "cell"], "left").withColumn("part", _part())
    inside = W.partitionBy("shard", "cell", "part").orderBy("key", F.col("doc_id").asc_nulls_first())
    numbered = placed.withColumn("number", F.row_number().over(inside) - 1).join(offsets.drop("parts"), ["shard", "cell", "part"], "left")
    return numbered.select(*docs.columns, "size", "text_crc32", "shard", (F.col("number") + F.col("before")).cast("long").alias("slot"))
