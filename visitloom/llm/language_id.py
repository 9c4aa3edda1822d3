"""Language identification by multilingual mixture inference.

Training counts byte trigrams of each language over every labelled document that the rule
admits; grams are hashed to ``BUCKETS`` buckets, so what reaches the driver is at most languages
x BUCKETS counts whatever the number of documents, and the model that is broadcast is a quarter
of a megabyte a language.

For a document, expectation-maximisation finds the proportions of all languages that best
explain its grams. The set of languages is then grown in the order of those proportions as
long as the penalised likelihood improves: each further language must gain more than
PENALTY * log(grams). Since the full mixture bounds what any set can reach, most documents
are settled by one comparison. The prediction is the largest proportion within the set.

Defined results: null texts, and texts without a letter, are ``und`` with score 0; ties go to
the smaller language name; if nothing could be learned every text is ``und``; rows without
doc_id are answered and never learned from; texts are read whole, in pieces, so a very long text
needs memory for its own bytes and bounded counts; repeated rows are answered alike; clashing
columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.llm.common import aside, drop_clashing
from visitloom.session import ship

BUCKETS = 1 << 15
#: Likelihood gain that a further language must bring, in units of log(number of grams).
PENALTY = 3.0
ROUNDS = 12
PIECE = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def admitted(doc_id: Column) -> Column:
    """Rows that may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null texts are empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _codes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket, whether its middle is a letter, and where the kept bytes stand.

    Everything in ASCII but letters is a space, and runs of spaces count as one.
    """
    b = _FOLD[raw]
    space = b == 32
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    b = b[at].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, bool), at
    code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return code >> np.uint32(32 - 15), b[1:-1] != 32, at


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count), sorted, of a batch; each text is framed by spaces."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n)
    framed = np.full(len(data) + n + 1, 32, dtype=np.uint8)
    framed[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), sizes)] = data
    out_key, out_count = [], []
    for lo in range(0, len(framed), PIECE):
        code, letter, at = _codes(framed[lo : lo + PIECE + 2])
        if not len(code):
            continue
        doc = np.searchsorted(starts, at + lo, side="right") - 1
        # a gram belongs to the text of its middle; a space in the middle must not join two texts
        good = letter | (doc[:-2] == doc[2:])
        key, count = np.unique((doc[1:-1][good] * BUCKETS + code[good]).astype(np.int64), return_counts=True)
        out_key.append(key)
        out_count.append(count)
    if not out_key:
        none = np.zeros(0, np.int64)
        return none, none, none
    key, inverse = np.unique(np.concatenate(out_key), return_inverse=True)
    count = np.bincount(inverse, np.concatenate(out_count)).astype(np.int64)
    return key // BUCKETS, key % BUCKETS, count


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about 2 MiB of text each, one row at least."""
    column = batch.column(text)
    size = np.fromiter((0 if v is None else v for v in pa.compute.binary_length(column).to_pylist()), np.int64, len(column))
    begin, total = 0, 0
    for i, s in enumerate(size):
        if total and total + s > 2 * PIECE:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += s
    if begin < len(size):
        yield batch.slice(begin)


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in _chunks(batch, 1):
            langs = part.column(0).to_pylist()
            doc, bucket, count = gram_counts(*_bytes_of(part.column(1)))
            names = sorted(set(langs))
            index = np.array([names.index(x) for x in langs])
            flat = np.bincount(index[doc] * BUCKETS + bucket, count, len(names) * BUCKETS)
            for k, name in enumerate(names):
                totals[name] = totals.get(name, 0) + flat[k * BUCKETS : (k + 1) * BUCKETS].astype(np.int64)
    for name, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
            ["lang", "bucket", "n"],
        )


class Model:
    """Log-probability of each bucket in each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float64)  # bucket x language

    def _em(self, p: np.ndarray, count: np.ndarray, doc: np.ndarray, starts: np.ndarray, total: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of each document over its allowed languages."""
        theta = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            part = p * theta[doc]
            part *= (count / part.sum(axis=1))[:, None]
            theta = np.add.reduceat(part, starts, axis=0) / total[:, None]
        mixed = (p * theta[doc]).sum(axis=1)
        return theta, np.add.reduceat(count * np.log(np.maximum(mixed, 1e-300)), starts)

    def infer(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions over the selected set, and over all languages; zero rows without grams."""
        n, k = len(offsets) - 1, len(self.languages)
        chosen, full = np.zeros((n, k)), np.zeros((n, k))
        doc, bucket, count = gram_counts(data, offsets)
        if not len(doc):
            return chosen, full
        present, starts = np.unique(doc, return_index=True)
        dense = np.searchsorted(present, doc)
        p, count = self.p[bucket], count.astype(np.float64)
        total = np.add.reduceat(count, starts)
        every = np.ones((len(present), k))
        theta, best = self._em(p, count, dense, starts, total, every)
        order = np.argsort(-theta, axis=1, kind="stable")
        single = np.add.reduceat(count[:, None] * np.log(p), starts, axis=0)
        first = order[:, 0] if k == 1 else np.argmax(single, axis=1)
        # the set starts with the likeliest single language and grows by proportion
        order = np.stack([np.concatenate([[f], row[row != f]]) for f, row in zip(first, order, strict=True)])
        now = np.zeros((len(present), k))
        now[np.arange(len(present)), order[:, 0]] = 1.0
        reached = single[np.arange(len(present)), order[:, 0]]
        price = PENALTY * np.log(total + 1)
        open_rows = np.arange(len(present))
        for size in range(2, k + 1):
            open_rows = open_rows[best[open_rows] - reached[open_rows] > price[open_rows]]
            if not len(open_rows):
                break
            allowed = np.zeros((len(open_rows), k))
            np.put_along_axis(allowed, order[open_rows, :size], 1.0, axis=1)
            pick = np.isin(dense, open_rows)
            sub = np.searchsorted(open_rows, dense[pick])
            sub_starts = np.searchsorted(sub, np.arange(len(open_rows)))
            got, like = self._em(p[pick], count[pick], sub, sub_starts, total[open_rows], allowed)
            better = like - reached[open_rows] > price[open_rows]
            now[open_rows[better]] = got[better]
            reached[open_rows[better]] = like[better]
            open_rows = open_rows[better]
        chosen[present], full[present] = now, theta
        return chosen, full


def learn(documents: DataFrame) -> Model | None:
    """A model from text and lang of the admitted rows; None if there are none."""
    ship(documents.sparkSession)
    rows = documents.where(admitted(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.select("lang", "text").mapInArrow(_count_languages, "lang string, bucket int, n long")
    summed = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.toArrow()  # languages x BUCKETS rows at most
    names = sorted(set(table.column("lang").to_pylist()))
    if not names:
        return None
    matrix = np.zeros((len(names), BUCKETS))
    row = {x: i for i, x in enumerate(names)}
    at = np.array([row[x] for x in table.column("lang").to_pylist()])
    matrix[at, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return Model(names, matrix)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Documents with lang_pred, score and mixture (language -> proportion over the set).

    ``keep`` names the input columns to return, all by default.
    """
    added = ("lang_pred", "score", "mixture")
    docs = drop_clashing(documents, *added)
    keep = docs.columns if keep is None else keep
    if model is None:
        return docs.select(*keep).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "mixture": F.expr("cast(map() as map<string,double>)")})
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")
    kept = [docs.columns.index(c) for c in keep]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array(m.languages, dtype=object)
        for batch in batches:
            for part in _chunks(batch, text):
                chosen, full = m.infer(*_bytes_of(part.column(text)))
                letters = np.fromiter(map(_has_letter, part.column(text).to_pylist()), bool, len(part))
                top = chosen.argmax(axis=1)
                known = letters & (chosen.max(axis=1) > 0)
                # letters too few for a gram: the most usual language is as good as any
                pred = np.where(letters, names[top], "und")
                at = np.arange(len(part))
                score = np.where(known, np.minimum(chosen[at, top], full[at, top]), 0.0)
                shares = [[(m.languages[j], float(row[j])) for j in np.flatnonzero(row > 0)] if ok else [] for row, ok in zip(chosen, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in kept], pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                    [*keep, *added],
                )

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    return docs.mapInArrow(answer, schema)


def keep_identified(documents: DataFrame) -> DataFrame:
    """Documents with a language in the selected set, however many share it; own columns only."""
    docs, own = aside(documents, "lang_pred", "score", "mixture")
    told = identify(docs, learn(documents))
    return told.where((F.col("lang_pred") != "und") & (F.size("mixture") > 0)).select(*own)
