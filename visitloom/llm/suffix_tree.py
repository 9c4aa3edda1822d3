"""Language-model scores by a probabilistic suffix tree.

A text is lower-cased (A-Z) and cut in words between white space; it is spelled as its words,
each followed by a blank, and an end symbol. The symbols are bytes. The tree holds contexts of
up to ``DEPTH`` bytes. The empty context and single bytes are always states. A longer context is
retained if its next-symbol distribution diverges from that of its suffix: the summed
log-likelihood ratio must exceed ``PENALTY`` nats for each of its distinct followers; suffixes of
retained contexts stay too. A state's distribution is smoothed with its suffix's one,
p(x|s) = (c(s,x) + t(s) p(x|suf s)) / (c(s) + t(s)) with t(s) distinct followers, down to 1/256.
A symbol is scored by the longest retained suffix of what stands before it; a text begins after
blanks. A token's spelled probability, the product over its bytes, is smoothed in turn with the
unigram one, (c+1)/(N+1*(V+1)), each weighing a half: the tree knows what words follow, the
unigrams know whole words. Over the training words, the end and one class of all unknown words
these probabilities sum to one at most; the score is the sum of their logarithms.

Each task sends its distinct runs of ``DEPTH`` + 1 bytes and its distinct words with their training
counts, packed in arrays. Runs with the same two bytes before their symbol meet in one group, which
holds all contexts that end in them: it builds its part of the tree and answers each of its runs.
Runs that occur only in texts to be scored come along with a count of 0. Texts are then dealt in
blocks of about ``BLOCK_BYTES``; a block asks once for each of its distinct runs and words, questions
and answers meet by ranges of hashes, and the answers go back to the block. Only the counts of
single bytes and their followers, 65,792 numbers, pass through the driver.

Defined results: a null or empty text, or one without words, is the end symbol alone; only rows
for which ``train`` is true are learned from, a null condition counts as false; without training
rows every symbol has 1/256 and a token's base probability is 1; repeated rows each count and each
get a row; columns but those named are not read, so names cannot clash; an empty table gives no
rows. Steps take about 4 MiB of text; one longer text is a step of its own, and needs some forty
bytes of memory a byte.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from visitloom.llm.common import Scratch
from visitloom.llm.perfect_hash import scrambled
from visitloom.llm.words import Distinct, Places, Words, classes, listed, split, steps
from visitloom.session import ship

DEPTH = 5
PENALTY = 1.0
BLOCK_BYTES = 32 << 20
#: Entries of distinct runs or words that a counting task holds before it hands them on.
HELD = 4_000_000

SPACE = classes(b" \t\n\x0b\x0c\r")
BLANK, END = 0x20, 0x0A
LN10 = math.log(10)


def spelled_runs(words: Words, depth: int) -> np.ndarray:
    """For each symbol of each text in order: the ``depth`` bytes before it and itself, packed."""
    lengths = np.bincount(words.row, weights=words.lengths + 1, minlength=words.rows).astype(np.int64) + 1
    base = np.concatenate([[0], np.cumsum(lengths + depth)])  # each text after ``depth`` blanks
    line = np.full(base[-1], BLANK, dtype=np.uint8)
    line[base[1:] - 1] = END
    if len(words.lengths):
        # a word's bytes move by a blank for each earlier word, and by what each text begins and ends with
        shift = np.arange(len(words.lengths)) + words.row * (depth + 1) + depth
        held = np.frombuffer(words.values.buffers()[2], dtype=np.uint8)
        line[np.arange(len(held)) + np.repeat(shift, words.lengths)] = held
    runs = np.zeros(len(line), dtype=np.int64)
    for j in range(0, depth + 1, 2):  # two bytes at a time
        two = line[: len(line) - j].astype(np.uint16)
        if j < depth:
            two[1:] |= line[: len(line) - j - 1].astype(np.uint16) << 8
        runs[j:] |= two.astype(np.int64) << (8 * j)
    symbol = np.ones(len(line), dtype=bool)
    symbol[(base[:-1, None] + np.arange(depth)).reshape(-1)] = False
    return runs[symbol]


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((scrambled(keys, 3) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _pieces(which: np.ndarray, *columns: np.ndarray):
    """(range, the columns' values in it) of each range that has some; values keep their order."""
    if not len(which):
        return
    order = np.argsort(which, kind="stable")
    which = which[order]
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    for a, b in zip(first, np.append(first[1:], len(which)), strict=True):
        yield int(which[a]), [c[order[a:b]] for c in columns]


def _rows(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())], names=list(schema))


def _whole(rows: pa.Table, column: str, dtype) -> np.ndarray:
    """The values of a column of packed arrays, one after the other."""
    return np.frombuffer(b"".join(x for x in rows.column(column).to_pylist() if x is not None), dtype=dtype)


def _all_words(rows: pa.Table) -> list[bytes]:
    return [w for x in rows.column("words").to_pylist() if x for w in x.split(b"\n")]


# --- counting

#: kind 0: runs by the two bytes before the symbol; kind 1: words by a range of hashes.
_COUNTS = {"kind": pa.int32(), "part": pa.int32(), "runs": pa.binary(), "words": pa.binary(), "counts": pa.binary()}
_COUNTS_DDL = "kind int, part int, runs binary, words binary, counts binary"


def _part_of(runs: np.ndarray, parts: int) -> np.ndarray:
    return _range((runs >> 8) & 0xFFFF, parts)


def _counter(depth: int, parts: int, ranges: int):
    """Distinct runs and words of a task's texts with their counts in training texts."""

    def emit(runs: Distinct, words: list[tuple[pa.Array, np.ndarray]]):
        keys, n = runs.all()
        out = [(0, p, r.tobytes(), None, c.tobytes()) for p, (r, c) in _pieces(_part_of(keys, parts), keys, n)]
        held, n = _added_words(words)
        out += [(1, p, None, b"\n".join(w), c.tobytes()) for p, (w, c) in _pieces(_range(_hashes(held), ranges), np.array(held, dtype=object), n)]
        yield from _rows(_COUNTS, out).to_batches()

    def count(batches):
        runs, words, held = Distinct(), [], 0
        for batch in batches:
            for admitted in (True, False):
                for step in steps(batch.filter(pc.equal(batch.column("train"), admitted))):
                    told = split(step.column("text"), SPACE)
                    keys, n = np.unique(spelled_runs(told, depth), return_counts=True)
                    runs.add(keys, n * admitted)
                    at, distinct = told.coded()
                    words.append((distinct, np.bincount(at, minlength=len(distinct)) * admitted))
                    held += len(distinct)
                    if runs.held + held > HELD:
                        yield from emit(runs, words)
                        runs, words, held = Distinct(), [], 0
        yield from emit(runs, words)

    return count


def _added_words(words: list[tuple[pa.Array, np.ndarray]]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of several lists with their summed counts."""
    if not words:
        return [], np.zeros(0, dtype=np.int64)
    told = pa.concat_arrays([w for w, _ in words]).dictionary_encode()
    n = np.zeros(len(told.dictionary), dtype=np.int64)
    np.add.at(n, told.indices.to_numpy(), np.concatenate([c for _, c in words]))
    return listed(told.dictionary), n


def _sum_part(rows: pa.Table) -> pa.Table:
    """One row of whole counts of a part's runs or words."""
    kind, part = rows.column("kind")[0].as_py(), rows.column("part")[0].as_py()
    counts = _whole(rows, "counts", np.int64)
    if kind == 0:
        gathered = Distinct()
        gathered.add(_whole(rows, "runs", np.int64), counts)
        runs, n = gathered.all()
        return _rows(_COUNTS, [(kind, part, runs.tobytes(), None, n.tobytes())])
    held, n = _added_words([(pa.array(_all_words(rows), pa.large_binary()), counts)])
    return _rows(_COUNTS, [(kind, part, None, b"\n".join(held), n.tobytes())])


def _totals(batches):
    """(edge, n): counts of a byte and its follower; under -1 and -2 all words and distinct words."""
    sums = np.zeros(1 << 16, dtype=np.int64)
    total = distinct = 0
    for batch in batches:
        for row in batch.to_pylist():
            n = np.frombuffer(row["counts"], dtype=np.int64)
            if row["kind"] == 0:
                np.add.at(sums, np.frombuffer(row["runs"], dtype=np.int64) & 0xFFFF, n)
            else:
                total, distinct = total + int(n.sum()), distinct + int((n > 0).sum())
    held = np.flatnonzero(sums)
    yield pa.record_batch([pa.array(np.concatenate([[-1, -2], held])), pa.array(np.concatenate([[total, distinct], sums[held]]))], names=["edge", "n"])


# --- the tree


def probabilities(runs: np.ndarray, n: np.ndarray, singles: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """Smoothed probability of each run's symbol after its longest retained suffix.

    ``runs``: distinct and ascending by value, with all contexts that end in the same two bytes as
    one of them; ``n``: their counts; ``singles``: 256 x 256 counts of a byte and its follower.
    """
    low = runs & 0xFFFF
    symbol, byte = low & 0xFF, low >> 8
    c, t, seen = singles.sum(), (singles.sum(axis=0) > 0).sum(), singles.sum(axis=0)
    p = (seen[symbol] + t / 256) / (c + t) if c else np.full(len(runs), 1 / 256)
    c, t = singles.sum(axis=1), (singles > 0).sum(axis=1)
    plain = np.divide(singles[byte, symbol], np.maximum(c[byte], 1))  # unsmoothed, of the suffix
    p = np.where(c[byte] > 0, (singles[byte, symbol] + t[byte] * p) / np.maximum(c[byte] + t[byte], 1), p)
    levels, kept = [], []
    for k in range(2, depth + 1):
        edges, of_run = np.unique(runs & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        count = np.bincount(of_run, weights=n, minlength=len(edges))
        contexts, of_edge = np.unique(edges >> 8, return_inverse=True)
        c = np.bincount(of_edge, weights=count, minlength=len(contexts))
        t = np.bincount(of_edge[count > 0], minlength=len(contexts))
        parent = np.zeros(len(edges))
        parent[of_run] = plain  # runs of one edge share their suffix's value
        own = np.divide(count, np.maximum(c[of_edge], 1))
        ratio = np.zeros(len(edges))
        held = count > 0
        ratio[held] = count[held] * np.log(own[held] / parent[held])
        kept.append(np.bincount(of_edge, weights=ratio, minlength=len(contexts)) > penalty * np.maximum(t, 1))
        levels.append((contexts, of_edge[of_run], count[of_run], c, t))
        plain = own[of_run]
    for k in range(depth - 2, 0, -1):  # suffixes of retained contexts
        suffixes = np.unique(levels[k][0][kept[k]] & ((1 << 8 * (k + 1)) - 1))
        kept[k - 1][np.searchsorted(levels[k - 1][0], suffixes)] = True
    for (_, at, count, c, t), stays in zip(levels, kept, strict=True):
        p = np.where(stays[at], (count + t[at] * p) / np.maximum(c[at] + t[at], 1), p)
    return p


#: What a range of hashes knows: runs with the logarithms of their probabilities, words with counts.
_KNOWN = {"range": pa.int32(), "runs": pa.binary(), "logs": pa.binary(), "words": pa.binary(), "counts": pa.binary()}
_KNOWN_DDL = "range int, runs binary, logs binary, words binary, counts binary"


def _answerer(singles, depth: int, penalty: float, ranges: int):
    def answer(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 1:
                    yield from _rows(_KNOWN, [(row["part"], None, None, row["words"], row["counts"])]).to_batches()
                    continue
                runs, n = (np.frombuffer(row[x], dtype=np.int64) for x in ("runs", "counts"))
                logs = np.log10(probabilities(runs, n, singles.value, depth, penalty))
                out = [(r, k.tobytes(), v.tobytes(), None, None) for r, (k, v) in _pieces(_range(runs, ranges), runs, logs)]
                yield from _rows(_KNOWN, out).to_batches()

    return answer


# --- blocks


def _dealer(batches):
    """A batch's rows of each block, as one compressed Arrow stream."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        out = []
        for number, (at,) in _pieces(batch.column("block").to_numpy(), np.arange(batch.num_rows)):
            rows = batch.drop_columns(["block"]).take(pa.array(at))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                writer.write_batch(rows)
            out.append((number, sink.getvalue().to_pybytes()))
        yield from _rows({"block": pa.int32(), "packed": pa.binary()}, out).to_batches()


def _texts(block: pa.Table):
    for packed in block.column("packed"):
        yield from pa.ipc.open_stream(packed.as_buffer())


_ASKED = {"block": pa.int32(), "range": pa.int32(), "runs": pa.binary(), "words": pa.binary()}
_ASKED_DDL = "block int, range int, runs binary, words binary"


def _asker(depth: int, ranges: int):
    """A block's distinct runs and words, by ranges of their hashes."""

    def ask(block: pa.Table) -> pa.Table:
        runs, held = Distinct(), set()
        for batch in _texts(block):
            for step in steps(batch):
                told = split(step.column("text"), SPACE)
                runs.add(spelled_runs(told, depth))
                held.update(listed(told.coded()[1]))
        keys, words = runs.all()[0], list(held)
        number = block.column("block")[0].as_py()
        out = [(number, r, k.tobytes(), None) for r, (k,) in _pieces(_range(keys, ranges), keys)]
        out += [(number, r, None, b"\n".join(w)) for r, (w,) in _pieces(_range(_hashes(words), ranges), np.array(words, dtype=object))]
        return _rows(_ASKED, out)

    return ask


_REPLY = {"block": pa.int32(), "runs": pa.binary(), "logs": pa.binary(), "words": pa.binary(), "counts": pa.binary()}
_REPLY_DDL = "block int, runs binary, logs binary, words binary, counts binary"


def _reply(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Each block's questions of one range with their answers; words that are not known are left out."""
    places = Places(_whole(known, "runs", np.int64))
    logs = np.append(_whole(known, "logs", np.float64), math.nan)  # every run of the texts is known
    counts = dict(zip(_all_words(known), _whole(known, "counts", np.int64).tolist(), strict=True))
    out = []
    for row in asked.to_pylist():
        if row["runs"]:
            told = logs[places.of(np.frombuffer(row["runs"], dtype=np.int64))]
            out.append((row["block"], row["runs"], told.tobytes(), None, None))
        if row["words"]:
            held = [w for w in row["words"].split(b"\n") if counts.get(w)]
            out.append((row["block"], None, None, b"\n".join(held), np.array([counts[w] for w in held], dtype=np.int64).tobytes()))
    return _rows(_REPLY, out)


def _scorer(depth: int, total: int, distinct: int, ends: int, kept: list[str], schema: pa.Schema):
    """A block's texts with the answers to its questions."""

    def score(block: pa.Table, replies: pa.Table) -> pa.Table:
        place, logs = Places(_whole(replies, "runs", np.int64)), _whole(replies, "logs", np.float64)
        counts = dict(zip(_all_words(replies), _whole(replies, "counts", np.int64).tolist(), strict=True))
        ended = math.log10((ends + 1) / (total + distinct + 1))
        out = []
        for batch in _texts(block):
            for step in steps(batch):
                told = split(step.column("text"), SPACE)
                at, own = told.coded()
                n = np.array([counts.get(w, 0) for w in listed(own)], dtype=np.int64)
                keys = spelled_runs(told, depth)
                symbol = (keys & 0xFF).astype(np.uint8)
                last = np.flatnonzero((symbol == BLANK) | (symbol == END))  # of each token, words and ends in order
                spelled = np.add.reduceat(logs[place.of(keys)], np.concatenate([[0], last[:-1] + 1]))
                tokens = np.bincount(told.row, minlength=told.rows) + 1
                row = np.repeat(np.arange(told.rows), tokens)
                plain = np.full(len(last), ended)
                plain[symbol[last] == BLANK] = np.log10((n + 1) / (total + distinct + 1))[at]
                mixed = np.logaddexp(spelled * LN10, plain * LN10) / LN10 + math.log10(0.5)
                known = np.bincount(told.row[(n > 0)[at]], minlength=told.rows) + (ends > 0)
                sums = (tokens, known, np.bincount(row, weights=plain, minlength=told.rows), np.bincount(row, weights=mixed, minlength=told.rows))
                out.append(pa.table([*(step.column(c) for c in kept), *sums], names=schema.names).cast(schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return score


def score(docs: DataFrame, train: Column, keep: list[str], text: str = "text", depth: int = DEPTH, penalty: float = PENALTY, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """The kept columns of every document with n_tokens, n_known, train_tokens, base_score and score."""
    if not 2 <= depth <= 6:
        raise ValueError("a run of depth + 1 bytes must fit in a long")
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "suffix-tree")
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")
    admitted = F.coalesce(train, F.lit(False)).alias("train")
    size, ends = docs.agg(F.sum(F.octet_length(text).cast("long")), F.count(F.when(admitted, 1))).first()
    blocks = max(1, math.ceil((size or 0) / block_bytes))
    parts, ranges = max(64, min(blocks, 1 << 16)), max(64, blocks // 4)
    told = docs.select(admitted, raw).mapInArrow(_counter(depth, parts, ranges), _COUNTS_DDL)
    counts = scratch.save(told.groupBy("kind", "part").applyInArrow(_sum_part, _COUNTS_DDL), "counts")
    sums = {r["edge"]: r["n"] for r in counts.mapInArrow(_totals, "edge long, n long").groupBy("edge").agg(F.sum("n").alias("n")).collect()}
    total, distinct = sums.pop(-1, 0) + ends, sums.pop(-2, 0) + (ends > 0)  # an end is a token
    singles = np.zeros((256, 256), dtype=np.int64)
    for edge, n in sums.items():
        singles[edge >> 8, edge & 0xFF] = n
    known = scratch.save(counts.mapInArrow(_answerer(spark.sparkContext.broadcast(singles), depth, penalty, ranges), _KNOWN_DDL), "known")
    # rows alone decide on their block, so that a task that runs again deals the same blocks
    block = F.pmod(F.xxhash64(*keep, text), F.lit(blocks)).cast("int").alias("block")
    own = [f"_{i}" for i in range(len(keep))]
    numbered = docs.select(block, *[F.col(c).alias(o) for c, o in zip(keep, own, strict=True)], raw)
    dealt = numbered.mapInArrow(_dealer, "block int, packed binary").repartition(2 * blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(_asker(depth, ranges), _ASKED_DDL)
    replies = asked.groupBy("range").cogroup(known.groupBy("range")).applyInArrow(_reply, _REPLY_DDL)
    schema = T.StructType([*numbered.select(*own).schema, *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double")])
    scorer = _scorer(depth, total, distinct, ends, own, to_arrow_schema(schema))
    scored = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(scorer, schema)
    told = scored.withColumnsRenamed(dict(zip(own, keep, strict=True)))
    return told.select(*keep, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
