"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights. Queries and candidates are dealt in blocks,
and each pair of blocks is one task's work: the candidate block becomes postings, one list of
(row, weight) a term; every query scatters its weighted postings into a dense score array,
partition selection keeps the k best and the block results are merged by Spark. A task holds
one block of postings and one score array, whatever the input.

Defined results: rows with a null id, a null vector or a null or non-finite component take no
part; a query never meets rows of its own id; ties go to the smaller id; vectors may differ in
length, missing terms weigh nothing; repeated candidate rows each count; a repeated query row
is asked once; no queries or no candidates give no rows; columns but id and vector are not read,
so names cannot clash; a very long vector needs memory for its block's postings. Scores are
exact: blocks whose scores might leave a signed 64-bit integer are computed in unbounded
integers, and a score among the k best that a long can't hold raises an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.llm.common import Scratch
from visitloom.session import ship

ROWS = 8192
QUERIES = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vec): finite vectors as doubles."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").alias("id"), vec.alias("vec")
    )


def _weights(vecs, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, exact since a double holds every integer that floor gives."""
    width = max((len(v) for v in vecs), default=0)
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        out[i, : len(v)] = np.floor(scale * np.asarray(v, dtype=np.float64))
    if not np.isfinite(out).all():
        raise OverflowError("a scaled component is beyond a double")
    return out


def _integers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as integers: of 64 bits if no inner product can leave them, else unbounded ones."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, min(a.shape[1], b.shape[1]))
    if most < 2.0**62 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 2.0**62:
        return a.astype(np.int64), b.astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    return exact(a), exact(b)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, rows: int = ROWS, queries: int = QUERIES, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates."""
    ship(vectors.sparkSession)
    scratch = scratch or Scratch(vectors.sparkSession, "topk")
    usable_rows = scratch.save(usable(vectors), "vectors")
    asked = usable_rows.where(is_query).dropDuplicates(["id"])
    n, q = usable_rows.count(), asked.count()
    blocks, sets = max(1, math.ceil(n / rows)), max(1, math.ceil(q / queries))
    deal = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    # rows of one id are spread by their number, so a hot id does not fill one block
    spread = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    right = usable_rows.withColumn("b", spread).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    left = asked.withColumn("s", deal(sets, 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def block(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        cs = cs.sort_values("id", kind="stable")
        ids = cs["id"].to_numpy(np.int64)
        asked, weights = _integers(_weights(qs["vec"].tolist(), scale), _weights(cs["vec"].tolist(), scale))
        postings = []
        for t in range(weights.shape[1]):
            at = np.flatnonzero(weights[:, t])
            postings.append((at if len(at) < len(ids) else slice(None), weights[at, t]))
        out = []
        for qid, terms in zip(qs["id"].to_numpy(np.int64), asked, strict=True):
            score = np.zeros(len(ids), dtype=weights.dtype)
            for t in np.flatnonzero(terms[: len(postings)]):
                at, w = postings[t]
                score[at] += terms[t] * w
            mine = np.flatnonzero(ids != qid)
            if len(mine) > k:
                least = np.partition(score[mine], len(mine) - k)[len(mine) - k]
                above, equal = mine[score[mine] > least], mine[score[mine] == least]
                mine = np.concatenate([above, equal[: k - len(above)]])  # ids ascend within the block
            # unbounded integers beyond a long raise here
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[mine], "score": score[mine].astype(np.int64)}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(
        lambda a, b: block(a, b), "query_id long, vec_id long, score long"
    )
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
