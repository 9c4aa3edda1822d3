"""Line deduplication by an exact set-similarity join [native].

A line is the set of its words. Tokens of a line are ordered by rarity, the counts coming
from a sketch over all words of all texts (SKETCH counters, so rarity costs no join). Two lines
of similarity T or more share a token within their prefixes, the |x| - ceil(T|x|) + 1 rarest
tokens each; candidates meet there, if lengths, the positions of the shared token and the
Hamming distance of 64-bit set signatures (parities, so that long lines do not fill them) allow the
similarity, all within the join. Survivors
are verified on their words. Lines with equal tokens that are written alike, but for case, are one
class, known by two independent 64-bit hashes of tokens and of the line, and enter the join once;
equal sets written otherwise are found by the join as any similar line is. Lines of fewer than NUM /
(DEN - NUM) words can only equal each other and do not enter the join, so for them the second hash
is of their sorted words. A line goes if an earlier line (by
doc_id, then line number) is similar to it.

A prefix token that HOT lines or more may share is not a key by itself: prefixes that are one
token longer share at least two tokens, so such a token is joined in pairs with each other
token of the longer prefix. Hot tokens are found by a sketch of counters, which both sides of a
pair read alike. Texts are read again by a side that is broadcast within a checked size, and else
by a shuffled hash join.

Tokens of equal rarity stand in the order of their hashes, so every line orders them alike; which
order it is decides on candidates only, never on what is removed.

Defined results: null texts have no lines; lines without words never match; of equal lines the
first stays; equal rows of one doc_id count once, different rows of one doc_id share their line
numbers; rows without doc_id are left as they are; an empty table gives an empty result;
clashing columns are replaced; a very long text is split and exploded whole within its task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import Scratch, drop_clashing, small_side

SKETCH = 1 << 16
#: Similarity as a fraction.
NUM, DEN = 9, 10
#: Shorter lines are similar to no line but their equals.
LEAST_WORDS = NUM // (DEN - NUM)
HASH_BITS = 50
#: Other white space that separates words of a line.
BLANKS = "\x09\x0b\x0c\r"
#: A token of so many lines' prefixes is joined in pairs with other tokens.
HOT = 50_000


def _folded(text: Column) -> Column:
    """Lower case, and one space for other white space: split by a single character needs no pattern."""
    lower = F.lower(text)
    other = reduce(Column.__or__, [text.contains(c) for c in BLANKS])
    return F.when(other, F.translate(lower, BLANKS, " " * len(BLANKS))).otherwise(lower)


def _words(line: Column) -> Column:
    """Words of a folded line."""
    return F.array_remove(F.split(line, " "), "")


def _rarity(documents: DataFrame) -> Column:
    """Array literal: rank of each sketch counter, small for rare words, above the bits of a hash."""
    words = documents.select(F.explode_outer(F.split(F.replace(_folded(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(SKETCH - 1).alias("at")).count().collect()  # SKETCH rows at most
    ranks = ["0"] * SKETCH
    for r in counts:
        ranks[r["at"]] = str(min(1023, int(16 * math.log2(r["count"]))) << HASH_BITS)
    # one foldable literal; an array of literals would be SKETCH expressions
    return F.split(F.lit(",".join(ranks)), ",").cast("array<bigint>")


def _ordered(hashes: Column, ranks: Column) -> Column:
    """Tokens as longs, rarest first: rank above, hash below."""

    def token(h: Column) -> Column:
        return F.get(ranks, h.bitwiseAND(SKETCH - 1)).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))

    return F.sort_array(F.transform(hashes, token))


def _lines(documents: DataFrame) -> DataFrame:
    """Lines, folded as whole texts."""
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split(_folded(F.col("text")), "\n")).alias("line_no", "line"))


def _tokens(lines: DataFrame, ranks: Column) -> DataFrame:
    """Words are told apart by their 64-bit hashes here, by themselves when pairs are verified."""
    told = lines.select("doc_id", "line_no", "line", F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))).alias("hashes"))
    return told.select("doc_id", "line_no", "line", F.size("hashes").alias("n"), _ordered(F.col("hashes"), ranks).alias("tokens"))


def _second_hash(joins: Column) -> Column:
    """Of the line as it is written, or of its sorted words if it does not enter the join."""
    return F.when(joins, F.xxhash64(F.lit(1), "line")).otherwise(F.xxhash64(F.lit(1), F.sort_array(F.array_distinct(_words(F.col("line"))))))


def _earlier(a: str, b: str) -> Column:
    """Line a stands before line b."""
    return (F.col(f"{a}.doc_id") < F.col(f"{b}.doc_id")) | (
        (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.line_no") < F.col(f"{b}.line_no"))
    )


def _signature() -> Column:
    """Parities of a line's tokens by 64 classes: two of them differ in no more bits than the sets in tokens."""

    def flip(acc: Column, t: Column) -> Column:
        return acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int")))

    return F.aggregate("tokens", F.lit(0).cast("long"), flip)


def _near(x: str, y: str) -> Column:
    """Lengths, the shared token's positions and the signatures allow the similarity of x and y."""
    xn, yn = F.col(f"{x}.n"), F.col(f"{y}.n")
    total = xn + yn
    rest = F.least(xn - F.col(f"{x}.i"), yn - F.col(f"{y}.i"))
    apart = F.bit_count(F.col(f"{x}.signature").bitwiseXOR(F.col(f"{y}.signature")))
    return (
        (apart * (NUM + DEN) <= total * (DEN - NUM))
        & (F.least(xn, yn) * DEN >= F.greatest(xn, yn) * NUM)
        & (rest * (NUM + DEN) >= total * NUM)
    )


def _place(of: str) -> Column:
    return F.struct(F.col(f"{of}.doc_id").alias("doc_id"), F.col(f"{of}.line_no").alias("line_no"))


def _hot_counters(classes: DataFrame) -> list[int]:
    """Counters, by the low bits of a token, that HOT lines' prefixes reach."""
    counts = classes.select(F.explode("prefix").alias("t")).groupBy(F.col("t").bitwiseAND(SKETCH - 1).cast("int").alias("at")).count()
    return [r["at"] for r in counts.where(F.col("count") >= HOT).collect()]  # SKETCH rows at most


def _keys(classes: DataFrame) -> DataFrame:
    """Lines by their keys: a prefix token, or a pair of a hot one and another of the longer prefix.

    ``i`` is the token's position, of a pair that of its later token less one, so that in both
    cases n - i bounds what a line shares if nothing rarer is shared.
    """
    line = ["doc_id", "line_no", "n", "signature"]
    hot = _hot_counters(classes)
    if not hot:
        return classes.select(*line, F.posexplode("prefix").alias("i", "key"))
    flags = ["0"] * SKETCH
    for at in hot:
        flags[at] = "1"
    table = F.split(F.lit(",".join(flags)), ",").cast("array<int>")  # one foldable literal
    is_hot = lambda t: F.get(table, t.bitwiseAND(SKETCH - 1).cast("int")) == 1
    told = classes.select(*line, "longer", F.posexplode("prefix").alias("i", "token"))
    others = F.when(is_hot(F.col("token")), F.sequence(F.lit(0), F.size("longer") - 1)).otherwise(F.array(F.lit(-1)))
    told = told.select("*", F.explode(others).alias("k")).withColumn("other", F.get("longer", F.col("k")))
    # a pair of two hot prefix tokens comes up from both; its earlier token speaks for it
    twice = (F.col("k") >= 0) & ((F.col("k") == F.col("i")) | ((F.col("k") < F.col("i")) & is_hot(F.col("other"))))
    pair = F.xxhash64(F.least("token", "other"), F.greatest("token", "other"))
    alone = F.col("k") < 0
    return told.where(~twice).select(
        *line, F.when(alone, F.col("i")).otherwise(F.greatest("i", "k") - 1).alias("i"), F.when(alone, F.col("token")).otherwise(pair).alias("key")
    )


def _word_sets(docs: DataFrame, places: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(at, words, n) of the lines at these places, read from the texts again."""
    wanted = places.distinct().groupBy("at.doc_id").agg(F.collect_list("at.line_no").alias("wanted"))
    texts = docs.join(small_side(scratch.save(wanted, name), 48), "doc_id")
    # only the wanted lines of a text become rows
    lines = texts.select("doc_id", F.split("text", "\n").alias("all"), F.explode("wanted").alias("line_no"))
    lines = lines.select("doc_id", "line_no", F.get("all", F.col("line_no")).alias("line")).where("line is not null")
    told = lines.select(F.struct("doc_id", "line_no").alias("at"), F.array_distinct(_words(_folded(F.col("line")))).alias("words"))
    return told.withColumn("n", F.size("words"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Places of lines that their words show similar to the earlier line of a pair."""
    both = F.size(F.array_intersect("a.words", "b.words"))
    told = pairs.join(sets.alias("a"), F.col("later") == F.col("a.at")).join(sets.alias("b"), F.col("earlier") == F.col("b.at"))
    return told.where(both * (NUM + DEN) >= (F.col("a.n") + F.col("b.n")) * NUM).select(F.col("later").alias("at")).distinct()


def removed_lines(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_lines, removed) of each document with lines; removed lists line numbers from 0.

    Only whether an earlier similar line exists matters. So each token's first line is tried
    against the others first, which settles groups of copies without their pairs; lines that this
    leaves open, and that have further candidates, then meet all of them.
    """
    scratch = scratch or Scratch(documents.sparkSession, "lines")
    docs = documents.select("doc_id", "text")
    ranks = _rarity(docs)
    told = _tokens(_lines(docs), ranks)
    prefix = F.col("n") - F.expr(f"(n * {NUM} + {DEN - 1}) div {DEN}").cast("int") + 1
    joins = F.col("n") >= LEAST_WORDS
    lines = scratch.save(
        told.select(
            "doc_id", "line_no", "n", F.xxhash64("tokens").alias("c1"), _second_hash(joins).alias("c2"),
            F.when(joins, F.slice("tokens", F.lit(1), prefix + 1)).alias("longer"), F.when(joins, _signature()).alias("signature"),
        ),
        "lines",
    )
    # a class of equal lines stands for all of them by its first line
    classes = lines.where("n > 0").groupBy("c1", "c2").agg(
        F.min(F.struct("doc_id", "line_no")).alias("at"), F.first("n").alias("n"), F.first("longer").alias("longer"), F.first("signature").alias("signature")
    )
    classes = scratch.save(classes.select("at.doc_id", "at.line_no", "n", "signature", "longer"), "classes")

    rows = _keys(classes.where(joins).withColumn("prefix", F.slice("longer", F.lit(1), prefix)))
    # none is null; said here, so that all that follows has the same filters and shares one exchange
    known = [F.col(c).isNotNull() for c in ("key", "doc_id", "line_no", "n", "i", "signature")]
    by_key = rows.where(reduce(Column.__and__, known)).repartition("key")
    # a window keeps the order of the keys for the join that follows; keys of one line end here
    same = Window.partitionBy("key")
    head = F.min(F.struct("doc_id", "line_no", "n", "signature", "i")).over(same)
    x = by_key.select("*", head.alias("h"), F.count("*").over(same).alias("many")).where("many > 1").alias("x")
    first = x.where(_earlier("h", "x") & _near("x", "h")).select(
        F.lit("first").alias("kind"), _place("x").alias("later"), _place("h").alias("earlier"), "key", "n", "signature", "i"
    )
    further = x.where("many > 2").join(
        by_key.alias("y"),
        (F.col("x.key") == F.col("y.key")) & _earlier("y", "x") & _near("x", "y") & (_place("y") != _place("h")),
        "left_semi",
    ).select(F.lit("further").alias("kind"), _place("x").alias("later"), F.lit(None).cast("struct<doc_id: bigint, line_no: int>").alias("earlier"), "key", "n", "signature", "i")
    met = scratch.save(first.unionByName(further), "met")

    pairs = met.where("kind = 'first'").select("later", "earlier").distinct()
    sets = scratch.save(_word_sets(docs, pairs.select(F.explode(F.array("later", "earlier")).alias("at")), scratch, "wanted-1"), "sets")
    gone = scratch.save(_similar(pairs, sets), "gone")

    left = met.where("kind = 'further'").join(gone.withColumnRenamed("at", "later"), "later", "left_anti")
    left = scratch.save(left.select("later.doc_id", "later.line_no", "key", "n", "signature", "i"), "left")
    y = rows.alias("y")
    rest = small_side(left, 80).alias("x").join(y, (F.col("x.key") == F.col("y.key")) & _earlier("y", "x") & _near("x", "y"))
    rest = rest.select(_place("x").alias("later"), _place("y").alias("earlier")).distinct()
    rest = scratch.save(rest.join(pairs, ["later", "earlier"], "left_anti"), "rest")
    more = _word_sets(docs, rest.select(F.explode(F.array("later", "earlier")).alias("at")), scratch, "wanted-2")
    goes = scratch.save(gone.unionByName(_similar(rest, scratch.save(more, "more"))).select("at.doc_id", "at.line_no").distinct(), "goes")
    scratch.drop("met", "sets", "gone", "left", "rest", "more", "wanted-1", "wanted-2")

    # of a class only the first line stays, unless an earlier line is similar to it
    stays = classes.select("doc_id", "line_no").join(goes, ["doc_id", "line_no"], "left_anti")
    # lines of a document lie together, so all that is known of it meets in one small row before it moves
    told = lines.select("doc_id", "line_no", (F.col("n") > 0).alias("some"), F.lit(False).alias("stays"))
    told = told.unionByName(stays.select("doc_id", "line_no", F.lit(False).alias("some"), F.lit(True).alias("stays")))
    per_doc = told.groupBy("doc_id").agg(
        F.size(F.collect_set(F.when(~F.col("stays"), F.col("line_no")))).cast("long").alias("n_lines"),
        F.collect_set(F.when(F.col("some"), F.col("line_no"))).alias("some"), F.collect_set(F.when(F.col("stays"), F.col("line_no"))).alias("stays"),
    )
    return per_doc.select("doc_id", "n_lines", F.array_sort(F.array_except("some", "stays")).alias("removed"))


def deduplicate_lines(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Documents with n_lines and n_removed, and the removed lines cut out of their texts."""
    told = removed_lines(documents, scratch).withColumnRenamed("doc_id", "told_doc")
    docs = drop_clashing(documents, "n_lines", "n_removed", "removed", "told_doc")
    out = docs.join(told, docs["doc_id"] == told["told_doc"], "left").drop("told_doc")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    text = F.when(F.size("removed") > 0, F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(
        *docs.columns, F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed")
    )
