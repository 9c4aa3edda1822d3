"""Ranked lexical search over document-sharded postings with precomputed integer impacts.

Every run of about ``SHARD_BYTES`` of text becomes one shard: a compressed sparse row matrix with
a row a term, its documents and their impacts, saved in the shared folder. An impact is the part
of a score that needs no question, (10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L. A
question adds each of its terms' impacts, times the term's weight and its repeats, into a dense
array of scores of the shard's documents, term at a time; argpartition finds the k-th score, all
above it and the smallest ids of its equals are kept. A task merges its shards' best as it goes,
Spark merges the tasks'. Questions are asked in blocks of about ``PAIRS`` (item, term) pairs, so
that what is broadcast has a bound; each block passes over the whole index.

Terms are runs of digits, ASCII letters and characters beyond ASCII, with A-Z lower-cased. N counts
documents with a term, L their terms, n a document's terms, df the documents with a term; a term's
weight is floor(1000 ln((2N + 2) / (2 df + 1))).

Defined results: texts that are null, empty or without terms are found by nothing and not counted;
equal scores go to the smaller id, null ids last; repeated documents each count and are each
returned; of several rows of one item_id the smallest text is asked; items without terms, or without
a document, give no rows; columns but ids and texts are not read, so names cannot clash; a document
longer than a shard is a shard of its own, with memory in proportion. No documents or no items give
no rows. A score beyond a signed 64-bit integer raises an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from visitloom.llm.common import Scratch, fold_az
from visitloom.llm.words import classes, split, steps
from visitloom.session import ship

SHARD_BYTES = 4 << 20
PAIRS = 500_000

#: Everything below 0x80 that is neither a digit nor a letter.
BETWEEN = classes(bytes(b for b in range(0x80) if not chr(b).isalnum()))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_INDEX = "ids binary, no_id binary, words binary, word_ends binary, starts binary, docs binary, impacts binary"


@dataclass
class Index:
    shards: DataFrame
    documents: int  # N
    terms: int  # L
    id_name: str


def _sizes(batches):
    """Per batch: documents with a term, and their terms."""
    for batch in batches:
        documents = terms = 0
        for step in steps(batch):
            n = np.bincount(split(step.column("text"), BETWEEN).row, minlength=step.num_rows)
            documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
        yield pa.record_batch([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], names=["documents", "terms"])


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The impact of each (term, document), from tf and the document's terms n."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 62:
        m = 75 + 25 * n * documents // terms
    else:
        m = np.array([75 + 25 * int(x) * documents // terms for x in n], dtype=np.int64)
    return (10**9 * tf) // (1000 * tf + 12 * m)


def _sharder(documents: int, terms: int, shard_bytes: int):
    """Shards of a task's texts, one row each."""

    def shard(batches):
        for batch in batches:
            for step in steps(batch, most=shard_bytes):
                told = split(step.column("text"), BETWEEN)
                if not len(told.row):
                    continue
                at, words = told.coded()
                n = np.bincount(told.row, minlength=told.rows)
                pairs, tf = np.unique(at * told.rows + told.row, return_counts=True)  # by term, then document
                term, doc = pairs // told.rows, pairs % told.rows
                ids = step.column("id")
                blob = words.cast(pa.large_binary()).buffers()
                arrays = (
                    ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                    pc.is_null(ids).to_numpy(zero_copy_only=False),
                    np.frombuffer(blob[2], dtype=np.uint8),
                    np.frombuffer(blob[1], dtype=np.int64)[: len(words) + 1],
                    np.searchsorted(term, np.arange(len(words) + 1)).astype(np.int32),
                    doc.astype(np.int32),
                    impacts(tf, n[doc], documents, terms).astype(np.int32),  # an impact is below 10^6
                )
                names = ("ids", "no_id", "words", "word_ends", "starts", "docs", "impacts")
                yield pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=list(names))

    return shard


def build(docs: DataFrame, id_name: str = "doc_id", shard_bytes: int = SHARD_BYTES, scratch: Scratch | None = None) -> Index:
    """The index of all documents."""
    ship(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "impacts")
    texts = docs.select(F.col(id_name).cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    sums = texts.select("text").mapInArrow(_sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = int(sums[0] or 0), int(sums[1] or 0)
    shards = texts.mapInArrow(_sharder(documents, max(1, terms), shard_bytes), _INDEX)
    return Index(scratch.save(shards, "shards"), documents, terms, id_name)


def _words(row: dict) -> pa.Array:
    ends = np.frombuffer(row["word_ends"], dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(row["word_ends"]), pa.py_buffer(row["words"])])


def _counter(asked):
    """(term, df): in how many documents of a task's shards the asked terms stand."""

    def count(batches):
        terms = pa.array(asked.value, pa.large_binary())
        df = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_buffer() for c in ("words", "word_ends", "starts")}
                at = pc.index_in(terms, value_set=_words(row)).fill_null(-1).to_numpy(zero_copy_only=False)
                starts = np.frombuffer(row["starts"], dtype=np.int32)
                df += np.where(at >= 0, starts[at + 1] - starts[at], 0)
        held = np.flatnonzero(df)
        yield pa.record_batch([terms.take(held).cast(pa.binary()), pa.array(df[held])], names=["term", "df"])

    return count


def best(score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equals the smaller ids, missing ids last."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        least = score[at[np.argpartition(score[at], len(at) - k)[len(at) - k]]]
        above, equal = at[score[at] > least], at[score[at] == least]
        equal = equal[np.lexsort((ids[equal], no_id[equal]))]
        at = np.concatenate([above, equal[: k - len(above)]])
    return at


def _searcher(question, k: int, item_type: pa.DataType):
    """Each item's k best of a task's shards."""

    def search(batches):
        items, terms, weights, of_item = question.value
        asked = pa.array(terms, pa.large_binary())
        empty = np.zeros(0, dtype=np.int64)
        held = [(empty, empty, empty.astype(bool)) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_buffer() for c in batch.schema.names}
                at = pc.index_in(asked, value_set=_words(row)).fill_null(-1).to_numpy(zero_copy_only=False)
                starts, docs, value = (np.frombuffer(row[c], dtype=np.int32) for c in ("starts", "docs", "impacts"))
                ids, no_id = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["no_id"], dtype=bool)
                score = np.zeros(len(ids), dtype=np.int64)
                for j, (places, repeats) in enumerate(of_item):
                    score[:] = 0
                    for p, r in zip(places, repeats, strict=True):
                        if at[p] >= 0:
                            run = slice(starts[at[p]], starts[at[p] + 1])
                            score[docs[run]] += int(weights[p]) * int(r) * value[run].astype(np.int64)
                    told = best(score, ids, no_id, k)
                    if len(told):
                        merged = [np.concatenate(x) for x in zip(held[j], (score[told], ids[told], no_id[told]), strict=True)]
                        kept = best(*merged, k)
                        held[j] = tuple(x[kept] for x in merged)
        item = np.repeat(np.arange(len(items)), [len(x[0]) for x in held])
        score, ids, no_id = (np.concatenate(x) if held else empty for x in (zip(*held, strict=True) if held else ([], [], [])))
        yield pa.record_batch(
            [pa.array([items[x] for x in item], item_type), pa.array(ids, pa.int64(), mask=no_id.astype(bool)), pa.array(score, pa.int64())], names=["item", "id", "score"]
        )

    return search


def _question(rows: list, df: dict, documents: int):
    """(items, terms, weights, per item the places and repeats of its terms) of collected rows."""
    items, terms = {}, {}
    pairs: list[tuple[list, list]] = []
    for r in rows:
        j = items.setdefault(r["item"], len(items))
        if j == len(pairs):
            pairs.append(([], []))
        pairs[j][0].append(terms.setdefault(bytes(r["term"]), len(terms)))
        pairs[j][1].append(r["repeats"])
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in terms]
    for places, repeats in pairs:  # an impact is below 10^6
        if sum(weights[p] * r for p, r in zip(places, repeats, strict=True)) >= 2**63 // 10**6:
            raise OverflowError("a score is beyond a signed 64-bit integer")
    return list(items), list(terms), np.array(weights, dtype=np.int64), pairs


def search(index: Index, items: DataFrame, k: int = 20, item_name: str = "item_id", pairs: int = PAIRS, scratch: Scratch | None = None) -> DataFrame:
    """(item, rank, id, score) of each item's k highest-scoring documents."""
    spark = items.sparkSession
    scratch = scratch or Scratch(spark, "search")
    texts = items.groupBy(F.col(item_name).alias("item")).agg(F.min("text").alias("text"))
    words = F.explode(F.regexp_extract_all(fold_az(F.col("text")), F.lit(TERM), F.lit(0)))
    asked = scratch.save(texts.select("item", words.alias("term")).groupBy("item", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("repeats")), "asked")
    blocks = max(1, math.ceil(asked.count() / pairs))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    kind = asked.schema["item"].dataType
    schema = T.StructType([T.StructField("item", kind), *T.StructType.fromDDL("id long, score long")])
    found = []
    for b in range(blocks):
        rows = asked.where(block == b).collect()  # about ``pairs`` rows
        terms = spark.sparkContext.broadcast(list({bytes(r["term"]) for r in rows}))
        df = index.shards.select("words", "word_ends", "starts").mapInArrow(_counter(terms), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        question = spark.sparkContext.broadcast(_question(rows, {bytes(r["term"]): r["df"] for r in df.collect()}, index.documents))
        terms.unpersist()
        found.append(scratch.save(index.shards.mapInArrow(_searcher(question, k, to_arrow_type(kind)), schema), f"found_{b}"))
    told = found[0]
    for more in found[1:]:
        told = told.union(more)
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_name), "rank", F.col("id").alias(index.id_name), "score")
