"""Operators 11 to 13: plain versions of what SQL cannot express, values at the edges, and their parts."""

import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visitloom.llm import impact_search, phrases, queries, suffix_tree
from visitloom.llm.perfect_hash import PerfectHash
from visitloom.llm.words import Distinct, Places, classes, split, steps

SPACE = classes(b" \t\n\x0b\x0c\r")


# --- parts


def test_split_equals_bytes_split():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("aB ñ\n.\t;Z\x0b\x1c") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 6))]
        told = split(pa.array([b"skipped", *texts], pa.binary()).slice(1), SPACE)
        want = [(i, w) for i, t in enumerate(texts) for w in t.lower().split()]
        assert list(zip(told.row.tolist(), told.values.to_pylist(), strict=True)) == want


def test_linked_words_stay_in_a_piece_and_a_row():
    told = split(pa.array([b"a b.c d", b"e f  g"], pa.binary()), classes(b" ", b"."))
    words = told.values.to_pylist()
    assert [words[i] + words[i + 1] for i in told.linked(2)] == [b"ab", b"cd", b"ef", b"fg"]
    assert [words[i] for i in told.linked(3)] == [b"e"]


def test_steps_hold_all_rows_and_a_longer_text_alone():
    batch = pa.record_batch([pa.array([b"x" * n for n in (3, 1, 50, 0, 4, 4)], pa.binary())], names=["text"])
    assert [s.num_rows for s in steps(batch, most=5)] == [2, 1, 2, 1]


def test_distinct_and_places():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**62), 2**62, 3000)
    runs = [rng.choice(keys, 4000) for _ in range(5)]
    held = Distinct()
    for r in runs:
        held.add(r)
    told, n = held.all()
    assert dict(zip(told.tolist(), n.tolist(), strict=True)) == Counter(np.concatenate(runs).tolist())
    at = Places(told).of(keys)
    assert all((told[a] == k) if a >= 0 else k not in set(told.tolist()) for a, k in zip(at, keys, strict=True))
    assert Places(told[:0]).of(keys[:3]).tolist() == [-1, -1, -1]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 20_000])
def test_perfect_hash_is_minimal_and_strangers_are_told_by_the_stored_key(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    hashed = PerfectHash(keys)
    assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
    table = phrases.Table([keys, keys ^ np.uint64(5), np.zeros(len(keys), dtype=np.uint64)])
    none = np.zeros(len(keys), dtype=np.uint64)
    assert (table.slots([keys, keys ^ np.uint64(5), none]) >= 0).all()
    assert (table.slots([keys, keys ^ np.uint64(4), none]) == -1).all()
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash(np.array([3, 3], dtype=np.uint64))


# --- op11


def plain_scores(rows, depth=suffix_tree.DEPTH, penalty=suffix_tree.PENALTY):
    """Scores of (text, train) rows, one symbol and one context at a time."""
    spelled = [(b" " * depth + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n") for t, _ in rows]
    count = defaultdict(Counter)
    for line, (_, train) in zip(spelled, rows, strict=True):
        for i in range(depth, len(line) if train else 0):
            for k in range(depth + 1):
                count[line[i - k : i]][line[i]] += 1
    kept = {s for s in count if len(s) < 2}
    for s, after in count.items():
        if len(s) >= 2:
            c, up = sum(after.values()), count[s[1:]]
            apart = sum(n * math.log(n / c / (up[x] / sum(up.values()))) for x, n in after.items())
            if apart > penalty * len(after):
                kept |= {s[j:] for j in range(len(s) + 1)}

    def p(s, x):
        longer = 1 / 256
        for k in range(len(s) + 1):
            state = s[len(s) - k :]
            if state not in kept:
                break
            c, t = sum(count[state].values()), len(count[state])
            longer = (count[state][x] + t * longer) / (c + t)
        return longer

    words = Counter(w for t, train in rows if train for w in [*(t or "").encode().lower().split(), b"\n"])
    total, distinct = sum(words.values()), len(words)
    out = []
    for line, (t, _) in zip(spelled, rows, strict=True):
        tokens, at, base, score = [*(t or "").encode().lower().split(), b"\n"], depth, 0.0, 0.0
        for token in tokens:
            own = 1.0
            for x in token if token == b"\n" else token + b" ":
                own *= p(line[at - depth : at], x)
                at += 1
            plain = (words[token] + 1) / (total + distinct + 1)
            base, score = base + math.log10(plain), score + math.log10((plain + own) / 2)
        out.append((len(tokens), sum(words[x] > 0 for x in tokens), total, base, score))
    return out


EDGES = [None, "", " \t\n ", "A", "a a a a a a a", "the cat sat on the mat " * 20, "The Cat\x0bsat ÑANDÚ ñandú", "x" * 3000, "\x00\x01 \x85", "zz new words here"]


def _scored(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, b, "x", 0) for i, (t, b) in enumerate(rows)], "doc_id long, text string, train boolean, block string, n_tokens int")
    told = suffix_tree.score(docs, F.col("train"), keep=["doc_id", "block"], **options).orderBy("doc_id").collect()
    return [tuple(r) for r in told]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 500}, {"depth": 3, "penalty": 0.2}])
def test_scores_equal_a_plain_version(spark, sf_dir, options):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(t, i % 3 != 0 if i != 4 else None) for i, t in enumerate([*EDGES, *EDGES, *[t and t[:1500] for t in texts]])]
    told = _scored(spark, rows, **options)
    want = plain_scores(rows, **{k: v for k, v in options.items() if k != "block_bytes"})
    assert [r[:5] for r in told] == [(i, "x", *w[:3]) for i, w in enumerate(want)]
    for r, w in zip(told, want, strict=True):
        assert r[5] == pytest.approx(w[3], abs=1e-9) and r[6] == pytest.approx(w[4], abs=1e-9)


def test_scores_without_training_rows_and_of_an_empty_table(spark):
    (told,) = _scored(spark, [("a b", False)])
    assert told[:6] == (0, "x", 3, 0, 0, 0.0)
    assert told[6] == pytest.approx(sum(math.log10((1 + 256.0**-n) / 2) for n in (2, 2, 1)))
    assert _scored(spark, []) == []


def test_probabilities_of_followers_sum_to_one():
    words = split(pa.array([b"the cat the hat a cat in that hat " * 9], pa.binary()), SPACE)
    seen, n = np.unique(suffix_tree.spelled_runs(words, 5), return_counts=True)
    singles = np.zeros((256, 256), dtype=np.int64)
    np.add.at(singles, ((seen >> 8) & 0xFF, seen & 0xFF), n)
    for context in np.unique(seen >> 8):
        every = (context << 8) + np.arange(256)
        runs = np.unique(np.concatenate([seen, every]))
        counts = np.zeros(len(runs), dtype=np.int64)
        counts[np.searchsorted(runs, seen)] = n
        p = suffix_tree.probabilities(runs, counts, singles, 5, 1.0)
        assert p[np.searchsorted(runs, every)].sum() == pytest.approx(1)


def test_held_out_texts_are_likelier_than_by_their_words_alone(spark, sf_dir):
    told = [r for r in queries.op11_lm_scoring(spark, sf_dir.replace("sf0.001", "sf0.01")).collect() if r["held_out"]]
    assert sum(r["score"] > r["base_score"] for r in told) >= 0.9 * len(told)
    assert {r["doc_id"] for r in told} == {i for i in (r["doc_id"] for r in told) if zlib.crc32(str(i).encode()) % 7 == 2}


# --- op12


def plain_phrases(rows, least=10, most=2000, share=50):
    counts, totals = defaultdict(Counter), Counter()
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            cuts = [(1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            inside = [n for h, n in f.items() if len(h) == 3 and len(g) == 2 and n >= least and g in (h[:2], h[1:])]
            if not any(100 * n >= share * a for n in inside):
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


PHRASED = [
    ("en", "New York is big. New York, New York! the new york times; "), ("en", None), ("en", ""), (None, "ein zwei drei ein zwei drei"), ("und", "ein zwei drei"),
    ("en", "of the of the of the of the"), ("de", "new york"), ("en", "a\x0bb\tc  d\x1ce ÑU ñu Ñu"), ("", "leer leer leer"), ("en", "x y z x y z x y"),
]


@pytest.mark.parametrize("options", [{"least": 1}, {"least": 2, "most": 5}, {"least": 3, "share": 101}, {"least": 2, "slice_size": 4}])
def test_phrases_equal_a_plain_version(spark, options):
    rows = PHRASED * 3
    docs = spark.createDataFrame([(lang, text, 1, "w") for lang, text in rows], "lang string, text string, n long, word string").repartition(4)
    told = sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())
    assert told == plain_phrases(rows, **{k: v for k, v in options.items() if k != "slice_size"})


def test_phrases_do_not_change_when_every_key_passes_the_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "FEWEST_BITS", 64)
    rows = PHRASED * 4
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=4).collect()) == plain_phrases(rows, least=4)


def test_texts_are_read_three_times_however_many_slices(spark, tmp_path):
    def noted(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    rows = PHRASED * 3
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1).mapInArrow(noted, "lang string, text string")
    told = sorted(tuple(r) for r in phrases.collocations(docs, least=1, slice_size=1).collect())
    assert told == plain_phrases(rows, least=1)
    assert len(list(tmp_path.iterdir())) == 3  # words, pairs, and all that passed


def test_phrases_counted_beyond_a_byte_and_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 5)
    monkeypatch.setattr(phrases, "STEP", 200)
    rows = PHRASED * 300
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=255, most=7).collect()) == plain_phrases(rows, least=255, most=7)


def test_scores_beyond_64_bits():
    a = np.array([1, 10, 3_000_000, 3_000_001, 5 * 10**9, 10**12, 12])
    left, right = np.array([1, 20, 3_000_000, 10**9, 6 * 10**9, 10**12 + 1, 4 * 10**9]), np.array([3, 40, 10**10, 3_000_001, 5 * 10**9, 3 * 10**12, 4 * 10**9])
    assert phrases._scores(a, left, right).tolist() == [10**6 * x * x // (y * z) for x, y, z in zip(a.tolist(), left.tolist(), right.tolist(), strict=True)]


def test_the_best_of_a_language_keep_their_ties():
    code, score, a = np.array([7, 7, 7, 7, 9, 9]), np.array([5, 9, 5, 5, 1, 2]), np.array([3, 1, 3, 2, 8, 8])
    assert sorted(phrases._best(code, score, a, 2).tolist()) == [0, 1, 2, 4, 5]
    assert phrases._best(code[:0], score[:0], a[:0], 2).tolist() == []


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", "one two three")], "lang string, text string")).collect() == []


# --- op13


def plain_search(docs, items, k=20):
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            n = sum(c.values())
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, i, -score))
    return out


@pytest.mark.parametrize("options", [{}, {"k": 3, "pairs": 4}])
def test_search_equals_a_plain_version(spark, options):
    rng = random.Random(5)
    vocabulary = ["Tree", "tree", "ÑU", "ñu", "42", "a_b", "—", "x"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for i in range(40)]
    docs += [(7, docs[7][1]), (None, "tree"), (None, "tree tree 42"), (50, None), (51, ""), (52, "—"), (53, "tree " * 5000)]
    items = [(1, "tree 42 42"), (2, None), (3, "!!"), (4, "unheard"), (5, "ÑU x tree a b"), (6, "tree")]
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, rank int, score string").repartition(3)
    asked = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    index = impact_search.build(frame, shard_bytes=60)
    told = impact_search.search(index, asked, **options).collect()
    order = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in told), key=order) == plain_search(docs, items, options.get("k", 20))


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("i", "tree")], "item_id string, text string")
    assert impact_search.search(impact_search.build(none), items).collect() == []
    docs = spark.createDataFrame([(1, "tree")], "doc_id long, text string")
    assert impact_search.search(impact_search.build(docs), items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in impact_search.search(impact_search.build(docs), items).collect()] == [("i", 1, 1)]


def test_repeated_items_are_asked_once_by_their_smallest_text(spark):
    docs = spark.createDataFrame([(1, "tree"), (2, "bush"), (3, "none"), (4, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "tree"), (1, "bush"), (1, "tree")], "item_id long, text string")
    assert [r["doc_id"] for r in impact_search.search(impact_search.build(docs), items).collect()] == [2]


def test_impacts_beyond_64_bits_between():
    tf, n = np.array([1, 2]), np.array([10**6, 5])
    documents, terms = 10**12, 10**14
    want = [10**9 * t // (1000 * t + 12 * (75 + 25 * x * documents // terms)) for t, x in zip(tf.tolist(), n.tolist(), strict=True)]
    assert impact_search.impacts(tf, n, documents, terms).tolist() == want
