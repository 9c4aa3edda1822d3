"""URL filter by a Bloom filter cascade: exact membership without joins [native].

Rules are keys ``host + path prefix``. A url asks for its candidate keys: host suffixes and
path prefixes in the shapes (labels of the host, length of the path) that rules have, a
handful whatever the url. Over the corpus's complete universe of such keys a cascade is
built for the listed keys: level 0 holds the listed keys, level 1 the unlisted keys that
level 0 lets pass, level 2 the listed keys that level 1 lets pass, and so on until no key
passes wrongly. Walking the levels then answers exactly for every key of the universe, with
column expressions over bit arrays alone; no join touches the pages.

Size bound: level 0 uses a false-positive rate of sqrt(1/2) * listed / unlisted and later
levels 1/2, so each level holds at most about the number of listed keys, with
log2(universe / listed) bits each at level 0. A level's bits are one literal of the plan, at
most ``MAX_BITS``; longer lists, and keys that hashing can't part within MAX_LEVELS, are looked
up by a shuffled join of the universe instead, exact too.

Defined results: null urls and urls without ``://`` have empty host and path and fit no rule;
no fitting rule means allow; an empty rule list allows all; of rules that are the same key the
last one counts, and of two fitting keys of one length (a tie) the greater by code point; a very
long url asks for no more keys than a short one; an empty table gives an empty result; repeated
rows are answered alike; clashing columns are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import LOWER, UPPER, Scratch, drop_clashing

#: verdict, host, path prefix
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_BITS = 1 << 23
MAX_LEVELS = 64
WORD = 62  # bits used of each long


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Level:
    words: list[int]
    bits: int
    hashes: int
    salt: int


def _bit(key: Column, salt: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt), F.lit(j)), F.lit(bits))


def passes(key: Column, level: Level) -> Column:
    """Whether a level lets a key pass."""
    # one foldable literal; an array of literals would be an expression for each word
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    out = F.lit(True)
    for j in range(level.hashes):
        at = _bit(key, level.salt, j, level.bits)
        word = F.get(words, ((at - at % WORD) / WORD).cast("int"))
        out = out & (F.getbit(word, (at % WORD).cast("int")) == 1)
    return out


class TooLong(ValueError):
    """The listed keys do not fit a cascade of the bound asked for."""


class Cascade:
    """Exact membership of ``listed`` keys among the keys of ``universe``."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS, scratch: Scratch | None = None, name: str = "cascade") -> Cascade:
        """Both have one column ``key``, of distinct keys; what a level lets pass is saved for the next."""
        scratch = scratch or Scratch(universe.sparkSession, "urls")
        inside = scratch.save(listed.select("key").distinct(), f"{name}-in")
        outside = scratch.save(universe.join(inside, "key", "left_anti"), f"{name}-out")  # at build time; asking needs no join
        n_in, n_out = inside.count(), outside.count()
        made = [f"{name}-in", f"{name}-out"]
        levels: list[Level] = []
        encode, against, size, rate = inside, outside, n_in, min(0.5, math.sqrt(0.5) * n_in / max(n_out, 1))
        try:
            while size:
                bits = max(WORD, math.ceil(size * math.log2(1 / max(rate, 1e-12)) / math.log(2)))
                if bits > max_bits or len(levels) >= MAX_LEVELS:
                    raise TooLong(f"{size} keys at level {len(levels)} need {bits} bits, over the bound of {max_bits}")
                levels.append(cls._level(encode, bits, max(1, round(math.log2(1 / max(rate, 1e-12)))), len(levels)))
                # what passes wrongly is encoded next, and asked against what this level encoded
                wrong = scratch.save(against.where(passes(F.col("key"), levels[-1])), f"{name}-{len(levels)}")
                made.append(f"{name}-{len(levels)}")
                encode, against = wrong, encode
                size, rate = encode.count(), 0.5
        finally:
            scratch.drop(*made)
        return cls(levels)

    @staticmethod
    def _level(keys: DataFrame, bits: int, hashes: int, salt: int) -> Level:
        at = keys.select(F.explode(F.array(*[_bit(F.col("key"), salt, j, bits) for j in range(hashes)])).alias("at"))
        word = F.expr(f"cast(at div {WORD} as int)")
        set_bits = at.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(at % {WORD} as int))")).alias("value"))
        words = [0] * (bits // WORD + 1)
        for r in set_bits.collect():  # at most bits / WORD rows, bounded by max_bits
            words[r["word"]] = r["value"]
        return Level(words, bits, hashes, salt)

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe: the first level that refuses decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(passes(key, self.levels[k]), out).otherwise(F.lit(k % 2 == 1))
        return out


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of the keys a url asks for; shapes are (host labels, path length), longest first."""
    labels = F.size(F.split(host, r"\."))
    one = [
        F.when(
            (labels >= n) & (F.char_length(path) >= size) & (host != ""),
            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)),
        )
        for n, size in shapes
    ]
    return F.array_compact(F.array(*one))


def _rule_table(pages: DataFrame, rules) -> DataFrame:
    """(key, verdict) of each distinct rule."""
    last = {h + p: v for v, h, p in rules}
    return pages.sparkSession.createDataFrame(list(last.items()), "key string, verdict string")


def _longest(keys: Column) -> Column:
    return F.array_max(F.transform(keys, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("k"))))["k"]


def judge(pages: DataFrame, rules=RULES, default: str = "allow", max_bits: int = MAX_BITS, scratch: Scratch | None = None) -> DataFrame:
    """Pages with host, path, rule and verdict. The longest fitting rule wins; its text is the key."""
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    docs = drop_clashing(pages, "host", "path", "rule", "verdict")
    docs = docs.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not rules:
        return docs.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules}, key=lambda s: (-s[0], -s[1]))
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    universe = scratch.save(docs.select(F.explode(keys).alias("key")).distinct(), "universe")
    table = _rule_table(pages, rules)
    try:
        listed = Cascade.build(table, universe, max_bits, scratch, "listed")
        # only listed keys are asked for their verdict
        present = scratch.save(universe.join(table, "key"), "present")
        blocked = Cascade.build(table.where("verdict = 'block'"), present.select("key"), max_bits, scratch, "blocked")
    except TooLong:
        return _joined(docs, keys, universe, table, default, scratch)
    scratch.drop("universe", "present")
    docs = docs.withColumn("rule", _longest(F.filter(keys, lambda k: listed.contains(k))))
    verdict = F.when(F.col("rule").isNull(), default).otherwise(F.when(blocked.contains(F.col("rule")), "block").otherwise("allow"))
    return docs.withColumn("verdict", verdict)


def _joined(docs: DataFrame, keys: Column, universe: DataFrame, table: DataFrame, default: str, scratch: Scratch) -> DataFrame:
    """The same answer for lists beyond a cascade: distinct (host, path) ask the list by a join."""
    places = docs.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))
    found = scratch.save(universe.join(table, "key"), "found")
    best = places.join(found, "key").groupBy("host", "path").agg(
        F.max(F.struct(F.char_length("key").alias("n"), "key", "verdict")).alias("best")
    )
    best = scratch.save(best.select("host", "path", F.col("best.key").alias("rule"), F.col("best.verdict").alias("verdict")), "best")
    out = docs.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return out.select(*docs.columns, "rule", "verdict")
