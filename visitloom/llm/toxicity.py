"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: case, full-width letters, letters of other scripts that look Latin,
and digits or signs that stand for letters inside words (``l``, ``1`` and ``|`` all become
``i``). The lexicon is learned from labelled rows: whole words of any length, and beginnings of
BEGINNINGS letters, weigh the log-odds of toxic against clean documents that hold them. Phrases around a lexicon word that
only clean documents use become exceptions. A document's hits, each word by its heaviest
entry and without those inside an exception, are summed, normalised by its length, and turned
into a probability by a logistic curve fitted on the same rows.

Labels are learned from at most MAX_LABELLED rows, taken in hash order of their ids (the
bounded sample the contract allows) and joined with their texts once; that sample alone bounds
the lexicon and the exceptions, of which none are cut. Scoring reads every whole text.

Defined results: null and empty texts score as texts without hits; without labels of both
kinds every score is the share of toxic labels (0 without labels); a document labelled both ways
counts for both; rows without doc_id are scored and never learned from; of entries that begin at
one place the heaviest counts, and equal weights (a tie) count once; repeated rows score alike;
a very long text is folded and matched whole within its task; an empty table gives an empty
result; clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.llm.common import Scratch, drop_clashing
from visitloom.session import ship

MAX_LABELLED = 20_000
LEAST_WEIGHT = 2.5
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7

# Letters that look like Latin ones, and what stands for letters within words.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h",
    "ԁ": "d", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԛ": "q", "ԝ": "w", "ӏ": "i",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "χ": "x", "γ": "y",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ʏ": "y", "ⅰ": "i", "ⅼ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "|": "i", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i"}

_FOLD = {ord(k): v for k, v in {**LOOKALIKES, **SUBSTITUTES}.items()}
_FOLD |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_FOLD |= {k: _FOLD.get(ord(v), v) for k, v in _FOLD.items() if 0xFF01 <= k <= 0xFF5E}
_FOLD |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """`` word word `` with one space around each folded word."""
    if not text:
        return " "
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text.lower().translate(_FOLD))
    return f" {_GAP.sub(' ', text).strip()} "


def admitted(doc_id: Column) -> Column:
    """Rows whose labels may be learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _entries(words: set[str]) -> set[str]:
    """Lexicon candidates of a document: `` word `` and `` begin``."""
    out = {f" {w} " for w in words}
    for w in words:
        for n in BEGINNINGS:
            if len(w) > n:
                out.add(f" {w[:n]}")
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (-20.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for k, v in self.weights.items():
                self._automaton.add_word(k, (len(k), v))
            for k in self.exceptions:
                if k not in self.weights:
                    self._automaton.add_word(k, (len(k), -1.0))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Word position -> weight of its heaviest entry, exceptions taken out."""
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        if not self.weights:
            return found
        for end, (size, weight) in self.automaton().iter(folded):
            start = end - size + 1
            if weight < 0:
                excused.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        for start, end in excused:
            for at in [at for at in found if start <= at < end]:
                del found[at]
        return found

    def features(self, folded: str, hits: dict[int, float] | None = None) -> tuple[float, float]:
        total = sum((self.hits(folded) if hits is None else hits).values())
        words = folded.count(" ") - 1
        return np.log1p(total), np.log1p(100.0 * total / (words + 20.0))

    def score(self, folded: str, hits: dict[int, float] | None = None) -> float:
        a, b = self.features(folded, hits)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def _counted(rows: DataFrame, per_text, schema: str) -> DataFrame:
    """Sums over (toxic, text) rows of what ``per_text`` finds, combined in each task first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in per_text(fold(text)):
                    sums.setdefault(k, [0, 0])[toxic] += 1
        keys = list(sums)
        for lo in range(0, len(keys), 50_000):
            part = keys[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([sums[k][1] for k in part], pa.int64()), pa.array([sums[k][0] for k in part], pa.int64())],
                ["entry", "toxic", "clean"],
            )

    return rows.mapInArrow(task, schema).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _pruned(found: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """Entries that say something their neighbours do not.

    A beginning goes if one longer entry holds nearly all its documents; a longer entry goes
    if a kept beginning of it weighs as much.
    """
    toxic = {e: t for e, t, _, _ in found}
    weight = {e: w for e, _, _, w in found}
    narrower: Counter[str] = Counter()
    for e in toxic:
        word = e.rstrip(" ")
        for n in BEGINNINGS:
            if len(word) - 1 > n or (len(word) - 1 == n and e.endswith(" ")):
                short = word[: n + 1]
                if short in toxic:
                    narrower[short] = max(narrower[short], toxic[e])
    kept = {e for e in toxic if e.endswith(" ") or narrower[e] < 0.9 * toxic[e]}
    out = {}
    for e in kept:
        word = e.rstrip(" ")
        shorter = [word[: n + 1] for n in BEGINNINGS if len(word) - 1 > n]
        if not any(s in kept and weight[s] >= weight[e] for s in shorter):
            out[e] = weight[e]
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, scratch: Scratch | None = None) -> Lexicon:
    """Lexicon, exceptions and curve, from the admitted labelled rows."""
    spark = documents.sparkSession
    ship(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & admitted(F.col("doc_id")))
    sample = usable.select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)
    # a bounded side: max_labelled rows of two numbers
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    scratch = scratch or Scratch(spark, "toxic")
    rows = scratch.save(rows, "labelled")  # read three times, each text of the sample once a pass
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        prior = bad / (bad + good) if bad + good else 0.0
        scratch.drop("labelled")
        return Lexicon(curve=(float(np.log(prior + 1e-12) - np.log(1 - prior + 1e-12)), 0.0, 0.0))
    least = 2 if bad < 100 else 4 if bad < 500 else 6
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    counted = _counted(rows, lambda t: _entries(set(t.split())), "entry string, toxic long, clean long")
    heavy = counted.where((F.col("toxic") >= least) & (odds >= LEAST_WEIGHT)).withColumn("weight", odds)
    entries = _pruned([(r["entry"], r["toxic"], r["clean"], r["weight"]) for r in heavy.collect()])
    lexicon = Lexicon(dict(sorted(entries.items(), key=lambda x: (-x[1], x[0]))))

    def phrases(folded: str) -> set[str]:
        out = set()
        for at in lexicon.hits(folded):
            end = folded.index(" ", at + 1)
            before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
            if before >= 0:
                out.add(folded[before : end + 1])
            if after >= 0:
                out.add(folded[at : after + 1])
        return out

    around = _counted(rows, phrases, "entry string, toxic long, clean long")
    excused = around.where((F.col("clean") >= 3) & (F.col("toxic") == 0)).orderBy(F.col("clean").desc(), "entry")
    lexicon = Lexicon(lexicon.weights, tuple(r["entry"] for r in excused.collect()))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(fold(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())],
                ["toxic", "a", "b"],
            )

    told = rows.mapInArrow(points, "toxic int, a double, b double").toArrow()  # max_labelled rows
    scratch.drop("labelled")
    x = np.column_stack([told.column("a").to_numpy(), told.column("b").to_numpy()])
    return Lexicon(lexicon.weights, lexicon.exceptions, _fit(x, told.column("toxic").to_numpy().astype(float)))


def score(documents: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """Documents (the columns in ``keep``, else all) with score, predicted and hits."""
    added = ("score", "predicted", "hits")
    docs = drop_clashing(documents, *added)
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    kept, text = [docs.columns.index(c) for c in keep], docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the words of max_labelled rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        for batch in batches:
            scores, hits = [], []
            for value in batch.column(text):
                folded = fold(value.as_py())
                found = lex.hits(folded)
                scores.append(lex.score(folded, found))
                hits.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(hits, pa.int64())],
                [*keep, *added],
            )

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("hits", T.LongType())])
    return docs.mapInArrow(task, schema)
