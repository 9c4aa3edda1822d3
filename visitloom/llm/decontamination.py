"""Benchmark decontamination with a broadcast set of test n-grams [native].

The windows of all benchmark items, ``n`` words each (an item with fewer words is one
window), form a hash set that is broadcast after a check of its size. One scan slides windows
of every length that occurs over the words of each document, probes the set with a 64-bit hash
of the window and verifies each probe hit word by word inside the join. A set over
BROADCAST_BYTES is not broadcast: then only positions and window hashes are shuffled to the
set, and what hits is verified on the texts afterwards. Everything is DataFrame functions.

Defined results: null text has no words; empty benchmark means no hits; a window may occur
in several items and counts for each; repeated rows get the same result each; ties cannot
arise; a very long text is split and its windows are exploded whole within its task; input
columns that clash with result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import aside, drop_clashing, fold_az, split_words

#: Everything in ASCII but digits and lower-case letters separates words (after folding A-Z).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before folding, for cutting spans out of the text as it was.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Windows are broadcast only below this many estimated bytes; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
ADDED = ("n_words", "hit_words", "items", "contaminated", "hit_doc", "hit_key", "text_key")


def normalised_words(text: Column) -> Column:
    return split_words(fold_az(text), SEPARATORS)


def test_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows: (len, key, window, items), items being the ids that hold the window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), normalised_words(F.col("text")).alias("w"))
    words = words.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
    starts = words.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s"))
    grams = starts.select("item", "len", F.slice("w", F.col("s"), F.col("len")).alias("window"))
    grouped = grams.groupBy("len", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grouped.withColumn("key", F.xxhash64("window"))


def find_hits(documents: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verified occurrences: (doc_id, text_key, start, len, items), start counted from 1."""
    windows = test_windows(benchmark, n)
    facts = windows.groupBy("len").agg(
        F.count("*").alias("rows"),
        F.sum(F.length(F.array_join("window", "  ")) * 2 + F.length(F.array_join("items", "  ")) * 2 + 200).alias("bytes"),
    ).collect()  # at most n rows
    lengths = sorted(r["len"] for r in facts) or [n]
    docs = documents.select(
        "doc_id", F.xxhash64("text").alias("text_key"), normalised_words(F.col("text")).alias("words")
    )
    at = _positions(docs, lengths)
    gram = F.slice("words", F.col("start"), F.col("size"))
    if sum(r["bytes"] for r in facts) <= broadcast_bytes:
        hit = at.join(F.broadcast(windows), (F.xxhash64(gram) == F.col("key")) & (gram == F.col("window")))
        return hit.select("doc_id", "text_key", "start", "len", "items")
    hit = _probes(at).join(windows, "key").select(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key"), "start", "size", "len", "window", "items")
    same = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key"))
    return docs.join(hit.where("size = len"), same).where(gram == F.col("window")).select("doc_id", "text_key", "start", "len", "items")


def _probes(at: DataFrame) -> DataFrame:
    """Where each window stands and its hash; what is shuffled where the set is not broadcast."""
    gram = F.slice("words", F.col("start"), F.col("size"))
    return at.select("doc_id", "text_key", "start", "size", F.xxhash64(gram).alias("key"))


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Documents with a row for each window, of each of these lengths, that their words hold."""
    sizes = [F.lit(x) for x in lengths]
    sized = docs.withColumn("size", sizes[0] if len(sizes) == 1 else F.explode(F.array(*sizes)))
    last = F.size("words") - F.col("size") + 1
    # outer: an inner explode makes Spark infer a filter that splits every text twice
    return sized.withColumn("start", F.explode_outer(F.when(last >= 1, F.sequence(F.lit(1), last))))


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each document row with n_words, hit_words (array of word positions), items, contaminated."""
    hits = find_hits(documents, benchmark, n, broadcast_bytes)
    # Per document only; sets, so repeated rows of one document change nothing.
    per_doc = hits.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "len")).alias("spans"), F.collect_set("items").alias("items")
    )
    per_doc = per_doc.select(
        F.col("doc_id").alias("hit_doc"),
        F.col("text_key").alias("hit_key"),
        F.array_distinct(
            F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
        ).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )
    docs = drop_clashing(documents, *ADDED)
    docs = docs.withColumn("n_words", F.when(F.col("text").isNull(), 0).otherwise(F.size(normalised_words(F.col("text")))).cast("long"))
    # hashed before the join, so that a text nobody asks for does not move
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    same = docs["doc_id"].eqNullSafe(per_doc["hit_doc"]) & (docs["text_key"] == per_doc["hit_key"])
    out = docs.join(per_doc, same, "left").drop("hit_doc", "hit_key", "text_key")
    return (
        out.withColumn("hit_words", F.coalesce("hit_words", F.array().cast("array<int>")))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumn("contaminated", F.size("hit_words") > 0)
    )


def remove_documents(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_share: float = 0.0) -> DataFrame:
    """Documents whose share of hit words is at most ``max_share``, with their own columns."""
    docs, own = aside(documents, *ADDED)
    told = contamination(docs, benchmark, n)
    share = F.size("hit_words") / F.greatest(F.col("n_words"), F.lit(1))
    return told.where(share <= max_share).select(*own)


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All documents, hit words cut out of their texts together with the separators after them."""
    docs, own = aside(documents, *ADDED)
    told = contamination(docs, benchmark, n)
    pieces = F.regexp_extract_all(
        F.col("text"), F.lit(f"(?:^{RAW_SEPARATOR}+)?{RAW_WORD}+{RAW_SEPARATOR}*"), F.lit(0)
    )
    kept = F.array_except(F.sequence(F.lit(1), F.col("n_words").cast("int")), F.col("hit_words"))
    cut = F.array_join(F.transform(kept, lambda p: F.element_at(pieces, p)), "")
    text = F.when(F.col("contaminated"), cut).otherwise(F.col("text"))
    return told.withColumn("text", text).select(*own)
