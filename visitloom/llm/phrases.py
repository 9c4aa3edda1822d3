"""Phrase collocations: exact counts of candidate phrases, read by slots of minimal perfect hashes.

Words are known by a 64-bit hash of language and word. Counting all words is one shuffle of each
task's distinct words; that no words share a hash is checked on the whole vocabulary, else all starts
again with another salt. Then come two passes over the texts, however many candidates there are:

* pairs are screened: each task sends the keys of its pairs of frequent words with counts, packed by
  ranges of keys; what sums to less than ``least`` goes. This keeps every frequent pair, for its true
  count is at most the sum, and some that share a key;
* the pairs that passed, and triples of which both pairs did (a bit for each key, set in a bitmap of
  bounded size: too small a bitmap lets more pass, never fewer), are counted by their words' hashes.
  Words in the candidates are frequent, so that these sums are exact.

Parts of a candidate are phrases that are candidates or frequent words themselves. Ranges of keys make
up slices of about ``SLICE`` candidates. A slice's words and pairs get slots of a minimal perfect hash,
which arrays of counts go by; the other slices ask it for the parts that they hold, each part once a
range, and are answered. A pair learns in the same way the highest count of a triple that holds it.
Each slice then keeps its best phrases of a language and those that tie with the last, and only
these are spelled and ranked.

Defined results: a null text is empty, a null language is ``und`` (one language with rows that say
so); languages differ if their texts do; repeated documents count each time; equal scores go to the
higher count, then to the phrase whose UTF-8 bytes come first; columns but lang and text are not read,
so names cannot clash; no texts or no candidates give no rows. Steps take about 8 MiB of text, one
longer text is a step of its own with memory in proportion. Scores are exact: where 64 bits
might not do, they are computed in integers of any size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.llm.common import Scratch
from visitloom.llm.perfect_hash import PerfectHash, scrambled
from visitloom.llm.words import classes, listed, split, steps
from visitloom.session import ship

SLICE = 500_000
STEP = 8 << 20
#: Tuples that a task of a screen holds before it sends them.
HELD = 4_000_000
#: Bits of a bitmap: SPARE for each key it holds, between these bounds (16 MB at most).
SPARE, FEWEST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27
#: Slices, and ranges, that there are at least.
FEWEST_SLICES = 64
#: Counts of a phrase, and thousands of its parts, up to which scores are computed in 64 bits.
NARROW = 3_000_000

PIECES = classes(b" \t", b".,;:!?\n\x0b\x0c\r")


def _joined(hashes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of each phrase from its words' hashes; the number of words matters."""
    key = scrambled(hashes[0], len(hashes))
    for h in hashes[1:]:
        key = scrambled(key * np.uint64(0x9E3779B97F4A7C15) + h, 7)
    return key


class _Step:
    """Hashed words of a run of texts of one language."""

    def __init__(self, texts: pa.Array, lang: str, salt: int):
        told = split(texts, PIECES)
        self.words = told
        self.at, self.distinct = told.coded()
        seed = xxhash.xxh64_intdigest(lang.encode(), seed=salt)
        self.known = np.array([xxhash.xxh64_intdigest(w, seed=seed) for w in listed(self.distinct)], dtype=np.uint64)
        self.hashes = self.known[self.at] if len(self.at) else np.zeros(0, dtype=np.uint64)

    def phrases(self, n: int, allowed: np.ndarray | None = None) -> list[np.ndarray]:
        """Hashes of the words of each phrase of n words, where ``allowed`` holds at all of them."""
        start = self.words.linked(n)
        for i in range(n) if allowed is not None else ():
            start = start[allowed[start + i]]
        return [self.hashes[start + i] for i in range(n)]


def _by_language(batches, salt: int):
    """(lang, step) of each language's texts, batch by batch."""
    for batch in batches:
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            of_lang = batch.filter(pc.equal(langs, lang))
            for step in steps(of_lang, most=STEP):
                yield lang, _Step(step.column("text"), lang, salt)


class Bitmap:
    """A set of 64-bit keys by one bit each: it may say yes wrongly, never no."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(64 * len(words) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def bitmap_of(keys: DataFrame, column: str) -> Bitmap:
    """The bitmap of a saved column of keys; its size is bounded whatever their number."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (SPARE * keys.count()).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    held = keys.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    told = held.toArrow()
    words = np.zeros(bits // 64, dtype=np.int64)
    words[told.column("word").to_numpy()] = told.column("bits").to_numpy()
    return Bitmap(words.view(np.uint64))


# --- words


_WORDS = "lang string, word binary, h long, n long"


def _code(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "lang").alias("code")


def _word_counter(salt: int, held: int = 2_000_000):
    def emit(counts):
        for lang, of_lang in counts.items():
            words = list(of_lang)
            seed = xxhash.xxh64_intdigest(lang.encode(), seed=salt)
            h = np.array([xxhash.xxh64_intdigest(w, seed=seed) for w in words], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(h), pa.array(list(of_lang.values()), pa.int64())], names=["lang", "word", "h", "n"])

    def count(batches):
        counts: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                of_lang = counts.setdefault(lang, {})
                for step in steps(batch.filter(pc.equal(langs, lang)), most=STEP):
                    at, distinct = split(step.column("text"), PIECES).coded()
                    for w, n in zip(listed(distinct), np.bincount(at, minlength=len(distinct)).tolist(), strict=True):
                        of_lang[w] = of_lang.get(w, 0) + n
                if sum(map(len, counts.values())) > held:
                    yield from emit(counts)
                    counts = {}
                    of_lang = counts.setdefault(lang, {})
        yield from emit(counts)

    return count


def _vocabulary(texts: DataFrame, scratch: Scratch, salts: int = 8) -> tuple[DataFrame, int]:
    """All words with hashes and counts, and the salt under which no words share a hash, nor languages a code."""
    for salt in range(salts):
        told = texts.mapInArrow(_word_counter(salt), _WORDS).groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
        words = scratch.save(told, f"words_{salt}")
        shared = words.groupBy("h").agg(F.count("*").alias("m")).where((F.col("m") > 1) | (F.col("h") == 0))  # 0 stands for no word
        langs = words.select("lang").distinct().groupBy(_code(salt)).count().where("count > 1")
        if shared.isEmpty() and langs.isEmpty():
            return words, salt
        scratch.drop(f"words_{salt}")
    raise RuntimeError("words or languages share hashes under every salt")


# --- sums of counts by key, packed by ranges of keys


def _range(columns: list[np.ndarray], parts: int) -> np.ndarray:
    """The range of keys of each tuple."""
    key = _joined(columns) if len(columns) > 1 else columns[0]
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _dealt(ranges: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[list[bytes]]]:
    """The ranges that have values, ascending, and each column's values of each of them."""
    order = np.argsort(ranges, kind="stable")
    full, first = np.unique(ranges[order], return_index=True)
    ends = np.append(first, len(order))
    columns = [c[order] for c in columns]
    return full, [[c[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)] for c in columns]


def _read(rows: pa.Table, column: str, kind=np.uint64) -> np.ndarray:
    """The packed values of all rows, one after the other."""
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), dtype=kind)


def _of_kind(rows: pa.Table, kind: int) -> pa.Table:
    return rows.filter(pc.equal(rows.column("kind"), kind))


def _packed(kind: int, parts: int, columns: list[np.ndarray], counts: np.ndarray, width: int):
    """A row for each range of keys: the columns' values one after the other, counts in a byte, and those that need more."""
    ranges, large = _range(columns, parts), counts >= 255
    full, blobs = _dealt(ranges, [*columns, np.minimum(counts, 255).astype(np.uint8)])
    of_large, (more,) = _dealt(ranges[large], [counts[large]])
    more = dict(zip(of_large.tolist(), more, strict=True))
    blobs = [*blobs[:-1], *[[b""] * len(full)] * (width - len(columns)), blobs[-1], [more.get(p, b"") for p in full.tolist()]]
    names = [*(f"c{i}" for i in range(width)), "counts", "more"]
    return pa.record_batch([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, dtype=np.int32)), *(pa.array(b, pa.binary()) for b in blobs)], names=["part", "kind", *names])


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct tuple, group of each tuple)."""
    key = _joined(columns) if len(columns) > 1 else columns[0]
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    if any((c[first][group] != c).any() for c in columns):  # two tuples share a key
        _, first, group = np.unique(np.stack(columns, axis=1), axis=0, return_index=True, return_inverse=True)
    return first, group.reshape(-1)


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples with their counts."""
    if not len(counts):
        return columns, counts
    if len(columns) == 1 and (counts == 1).all():  # bare keys need a sort only
        key, n = np.unique(columns[0], return_counts=True)
        return [key], n
    first, group = _grouped(columns)
    return [c[first] for c in columns], np.bincount(group, weights=counts).astype(np.int64)


class _Gathered:
    """Tuples of a task with counts, merged as they grow."""

    def __init__(self, width: int):
        self.runs, self.width, self.held, self.merged = [], width, 0, 0

    def add(self, columns: list[np.ndarray]) -> None:
        self.runs.append(_summed(columns, np.ones(len(columns[0]), dtype=np.int64)))
        self.held += len(self.runs[-1][1])
        if self.held > 2 * self.merged + (1 << 21):
            self.runs = [self.all()]
            self.held = self.merged = len(self.runs[0][1])

    def all(self) -> tuple[list[np.ndarray], np.ndarray]:
        if not self.runs:
            return [np.zeros(0, dtype=np.uint64)] * self.width, np.zeros(0, dtype=np.int64)
        columns = [np.concatenate([r[0][i] for r in self.runs]) for i in range(self.width)]
        return _summed(columns, np.concatenate([r[1] for r in self.runs]))


def _pair_screen(salt: int, frequent, parts: int, most: int):
    def screen(batches):
        held = _Gathered(1)
        for _, step in _by_language(batches, salt):
            ok = frequent.value.has(step.known)[step.at] if len(step.at) else None
            held.add([_joined(step.phrases(2, ok))])
            if held.held > most:
                yield _packed(2, parts, *held.all(), 1)
                held = _Gathered(1)
        yield _packed(2, parts, *held.all(), 1)

    return screen


def _phrase_counter(salt: int, frequent, passed, parts: int, most: int):
    """Pairs that passed, and triples of such pairs, with counts."""

    def count(batches):
        pairs, triples = _Gathered(2), _Gathered(3)
        for _, step in _by_language(batches, salt):
            ok = frequent.value.has(step.known)[step.at] if len(step.at) else None
            two = step.phrases(2, ok)
            good = passed.value.has(_joined(two))
            pairs.add([h[good] for h in two])
            three = step.phrases(3, ok)
            good = passed.value.has(_joined(three[:2])) & passed.value.has(_joined(three[1:]))
            triples.add([h[good] for h in three])
            if max(pairs.held, triples.held) > most:
                yield _packed(2, parts, *pairs.all(), 3)
                yield _packed(3, parts, *triples.all(), 3)
                pairs, triples = _Gathered(2), _Gathered(3)
        yield _packed(2, parts, *pairs.all(), 3)
        yield _packed(3, parts, *triples.all(), 3)

    return count


def _often(rows: pa.Table, width: int, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Tuples of the rows of a range whose summed counts reach ``least``, and the sums."""
    columns = [_read(rows, f"c{i}") for i in range(width)]
    counts = _read(rows, "counts", np.uint8).astype(np.int64)
    counts[counts == 255] = _read(rows, "more", np.int64)
    columns, counts = _summed(columns, counts)
    enough = counts >= least
    return [c[enough] for c in columns], counts[enough]


def _keys_of_range(least: int):
    def add_up(rows: pa.Table) -> pa.Table:
        columns, _ = _often(rows, 1, least)
        return pa.table([columns[0].view(np.int64)], names=["c0"])

    return add_up


_HELD = "part int, kind int, c0 binary, c1 binary, c2 binary, n binary"


def _held_of_range(least: int):
    """A row of packed candidates of a range for each length."""

    def add_up(rows: pa.Table) -> pa.Table:
        out = []
        for kind in (2, 3):
            columns, counts = _often(_of_kind(rows, kind), kind, least)
            if len(counts):
                out.append([rows.column("part")[0].as_py(), kind, *(c.tobytes() for c in columns), *[b""] * (3 - kind), counts.tobytes()])
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["part", "kind", "c0", "c1", "c2", "n"])

    return add_up


def _sent(texts: DataFrame, counter, width: int):
    return texts.mapInArrow(counter, ", ".join(["part int, kind int", *(f"c{i} binary" for i in range(width)), "counts binary, more binary"])).groupBy("part")


# --- parts of candidates


class Table:
    """Distinct phrases: a minimal perfect hash and the key stored in each slot."""

    def __init__(self, columns: list[np.ndarray]):
        key = _joined(columns)
        self.hash = PerfectHash(key)
        slot = self.hash.slots(key)
        self.stored = [np.zeros(len(key), dtype=np.uint64) for _ in columns]
        for held, c in zip(self.stored, columns, strict=True):
            held[slot] = c

    def slots(self, columns: list[np.ndarray]) -> np.ndarray:
        """The slot of each phrase, -1 for those that it does not hold."""
        slot = self.hash.slots(_joined(columns))
        for held, c in zip(self.stored, columns, strict=True) if self.hash.size else ():
            slot[(slot >= 0) & (held[slot] != c)] = -1
        return slot

    def by_slot(self, columns: list[np.ndarray], values: np.ndarray) -> np.ndarray:
        """The values of its phrases, in the order of slots."""
        out = np.zeros(self.hash.size, dtype=values.dtype)
        out[self.slots(columns)] = values
        return out


_PARTS = "slice int, asker int, kind int, c0 binary, c1 binary, n binary, code binary"
#: Words, pairs, and pairs that a triple drops.
_WORD, _PAIR, _DROPPED = 1, 2, 3


def _parts_of(kind: int, slices: np.ndarray, columns: list[np.ndarray], asker: np.ndarray | int) -> pa.RecordBatch:
    """Rows of packed parts: hashes of their words (zeros where there is no second), counts, codes of languages."""
    full, blobs = _dealt(slices, columns)
    blobs += [[b""] * len(full)] * (4 - len(blobs))
    askers = asker if isinstance(asker, np.ndarray) else np.full(len(full), asker)
    return pa.record_batch([pa.array(x.astype(np.int32)) for x in (full, askers, np.full(len(full), kind))] + [pa.array(b, pa.binary()) for b in blobs], names=["slice", "asker", "kind", "c0", "c1", "n", "code"])


def _words_held(slices: int):
    """Frequent words, dealt to slices."""

    def deal(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            n, code = (batch.column(c).to_numpy() for c in ("n", "code"))
            yield _parts_of(_WORD, _range([h], slices), [h, np.zeros_like(h), n, code], -1)

    return deal


def _ask(parts: int, wide: int, slices: int):
    """What a range of candidates asks of the slices: each of its words and pairs once, pairs with the highest count of a triple."""

    def ask(batches):
        for batch in batches:
            for part, kind, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h0, h1, h2 = (np.frombuffer(b, dtype=np.uint64) for b in blobs[:3])
                n = np.frombuffer(blobs[3], dtype=np.int64)
                words = np.unique(np.concatenate([h0, h1] if kind == 2 else [h0, h2]))
                yield _parts_of(_WORD, _range([words], slices), [words, np.zeros_like(words)], part // wide)
                if kind == 3:
                    pairs = [np.concatenate([h0, h1]), np.concatenate([h1, h2])]
                    first, group = _grouped(pairs)
                    longest = np.zeros(len(first), dtype=np.int64)
                    np.maximum.at(longest, group, np.concatenate([n, n]))
                    pairs = [c[first] for c in pairs]
                    yield _parts_of(_PAIR, _range(pairs, parts) // wide, [*pairs, longest], part // wide)

    return ask


def _answer(share: int):
    """Counts of the parts that were asked for, and the pairs of the slice that a triple drops."""

    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        columns, n = [_read(held, "c0"), _read(held, "c1")], _read(held, "n", np.int64)
        code = np.frombuffer(b"".join(c or bytes(len(h)) for c, h in zip(*(held.column(x).to_pylist() for x in ("code", "c0")), strict=True)), dtype=np.int64)  # pairs have none
        table = Table(columns)
        n, code = table.by_slot(columns, n), table.by_slot(columns, code)
        longest = np.zeros(len(n), dtype=np.int64)
        out = []
        for row in asked.to_batches():
            for asker, kind, c0, c1, highest in zip(*(row.column(c).to_pylist() for c in ("asker", "kind", "c0", "c1", "n")), strict=True):
                slot = table.slots([np.frombuffer(c, dtype=np.uint64) for c in (c0, c1)])
                if (slot < 0).any():
                    raise RuntimeError("a part of a candidate has no count")
                if kind == _PAIR:
                    np.maximum.at(longest, slot, np.frombuffer(highest, dtype=np.int64))
                out.append([asker, kind, c0, c1, n[slot].tobytes(), code[slot].tobytes()])
        gone = np.flatnonzero((longest > 0) & (100 * longest >= share * n))
        if len(gone):
            out.append([held.column("slice")[0].as_py(), _DROPPED, *(c[gone].tobytes() for c in table.stored), b"", b""])
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["slice", "kind", "c0", "c1", "n", "code"])

    return answer


def _scores(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """floor(1000000 a a / (l r)), exact; l and r are a at least, so no score is above 1000000."""
    wide = (a > NARROW) | (np.maximum(left, right) > 1000 * NARROW)
    out = 1_000_000 * a * a // np.where(wide, 1, left * right)
    for i in np.flatnonzero(wide).tolist():
        out[i] = 1_000_000 * int(a[i]) ** 2 // (int(left[i]) * int(right[i]))
    return out


def _best(code: np.ndarray, score: np.ndarray, a: np.ndarray, most: int) -> np.ndarray:
    """Places of each language's ``most`` best and of those that tie with the last."""
    order = np.lexsort((-a, -score, code))
    out = [order[:0]]
    for x in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        last = x[:most][-1:]
        out.append(x[(score[x] > score[last]) | (score[x] == score[last]) & (a[x] >= a[last])])
    return np.concatenate(out)


_SCORED = "h0 long, h1 long, h2 long, a long, l long, r long, score long"


def _score(most: int):
    """The best phrases of a slice, by the answers that it got."""

    def score(held: pa.Table, told: pa.Table) -> pa.Table:
        asked = told.filter(pc.less(told.column("kind"), _DROPPED))
        columns, n, code = [_read(asked, "c0"), _read(asked, "c1")], _read(asked, "n", np.int64), _read(asked, "code", np.int64)
        first, _ = _grouped(columns)
        columns = [c[first] for c in columns]
        table, dropped = Table(columns), Table([_read(_of_kind(told, _DROPPED), c) for c in ("c0", "c1")])
        n, code = table.by_slot(columns, n[first]), table.by_slot(columns, code[first])
        at = lambda *h: table.slots([h[0], h[1] if len(h) > 1 else np.zeros_like(h[0])])
        found = []
        for kind in (2, 3):
            own = _of_kind(held, kind)
            h = [_read(own, f"c{i}") for i in range(kind)]
            a = _read(own, "n", np.int64)
            if kind == 2:
                kept = dropped.slots(h) < 0
                h, a = [c[kept] for c in h], a[kept]
            word = at(h[0])
            cuts = [(n[word], n[at(*h[1:])])] + ([(n[at(*h[:2])], n[at(h[2])])] if kind == 3 else [])
            scores = np.stack([_scores(a, *x) for x in cuts])
            low = np.argmin(scores, axis=0)  # the first of equal ones
            pick = lambda x, low=low: x[low, np.arange(len(low))]
            h += [np.zeros_like(h[0])] * (3 - kind)
            found.append([*h, a, pick(np.stack([x[0] for x in cuts])), pick(np.stack([x[1] for x in cuts])), pick(scores), code[word]])
        found = [np.concatenate(x) for x in zip(*found, strict=True)]
        best = _best(found[7], found[6], found[3], most)
        return pa.table([x[best].astype(np.int64, copy=False) if x.dtype != np.uint64 else x[best].view(np.int64) for x in found[:7]], names=["h0", "h1", "h2", "a", "l", "r", "score"])

    return score


def _scored(held: DataFrame, common: DataFrame, parts: int, slice_size: int, most: int, share: int, scratch: Scratch) -> DataFrame:
    """(h0, h1, h2, a, l, r, score) of all phrases that may be among the best ``most`` of their language."""
    candidates = int(held.agg(F.sum(F.octet_length("n")) / 8).first()[0] or 0)
    wide = parts // min(parts, max(FEWEST_SLICES, math.ceil(candidates / slice_size)))  # ranges of a slice
    slices = math.ceil(parts / wide)
    held = held.withColumn("slice", F.floor(F.col("part") / wide).cast("int"))
    none = F.lit(b"")
    pairs = held.where(F.col("kind") == 2).select("slice", F.lit(-1).alias("asker"), F.lit(_PAIR).alias("kind"), "c0", "c1", "n", none.alias("code"))
    own = pairs.union(common.select("h", "n", "code").mapInArrow(_words_held(slices), _PARTS))
    asked = held.drop("slice").mapInArrow(_ask(parts, wide, slices), _PARTS)
    answers = own.groupBy("slice").cogroup(asked.groupBy("slice")).applyInArrow(_answer(share), "slice int, kind int, c0 binary, c1 binary, n binary, code binary")
    told = held.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_score(most), _SCORED)
    return scratch.save(told, "scored")


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, share: int = 50, slice_size: int = SLICE, scratch: Scratch | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of two and three words.

    A phrase goes if a longer candidate that holds it has ``share`` percent of its count or more.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255")
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "phrases")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    words, salt = _vocabulary(texts, scratch)
    of_lang = words.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    common = scratch.save(words.where(F.col("n") >= least).select("lang", "word", "h", "n", _code(salt)), "common")
    total = int(of_lang.agg(F.sum("n_lang")).first()[0] or 0)
    parts = max(FEWEST_SLICES, total // 1_000_000)  # ranges of keys
    frequent = spark.sparkContext.broadcast(bitmap_of(common, "h"))
    pair_keys = scratch.save(_sent(texts, _pair_screen(salt, frequent, parts, HELD), 1).applyInArrow(_keys_of_range(least), "c0 long"), "pair_keys")
    passed = spark.sparkContext.broadcast(bitmap_of(pair_keys, "c0"))
    held = scratch.save(_sent(texts, _phrase_counter(salt, frequent, passed, parts, HELD), 3).applyInArrow(_held_of_range(least), _HELD), "held")
    scratch.drop("pair_keys")
    return _ranked(_scored(held, common, parts, slice_size, most, share, scratch), common, of_lang, most)


def _ranked(scored: DataFrame, common: DataFrame, of_lang: DataFrame, most: int) -> DataFrame:
    told = scored.join(common.select(F.col("h").alias("h0"), "lang", F.col("word").alias("w0")), "h0")
    told = told.join(common.select(F.col("h").alias("h1"), F.col("word").alias("w1")), "h1")
    told = told.join(common.select(F.col("h").alias("h2"), F.col("word").alias("w2")), "h2", "left")
    text = lambda c: F.col(c).cast("string")
    told = told.join(of_lang, "lang").select(
        "lang", F.concat_ws(" ", text("w0"), text("w1"), text("w2")).alias("phrase"), "a", "l", "r", F.col("n_lang").alias("n"), "score"
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    first = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    told = told.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    ranked = told.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
