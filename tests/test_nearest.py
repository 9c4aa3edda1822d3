"""Nearest fingerprints by multi-index hashing, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from visitloom.operators import catalogue as C

SCHEMA = "id bigint, slot string, bits array<bigint>"


def _plain(rows, asked, k, cut=None):
    out = []
    for i, slot, bits in rows:
        if i not in asked or bits is None or slot is None:
            continue
        met = [(sum((x ^ y).bit_count() for x, y in zip(bits, b, strict=True)), j) for j, s, b in rows if s == slot and j != i and b is not None]
        met = sorted(m for m in met if cut is None or m[0] <= cut)[:k]
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(met)]
    return sorted(out)


def _rows(families, each, words=4, seed=5):
    """Families of prints a few bits apart, some equal, in two slots."""
    rng, rows = random.Random(seed), []
    for f in range(families):
        centre = [rng.getrandbits(32) for _ in range(words)]
        for _ in range(each):
            bits = list(centre)
            for _ in range(rng.choice([0, 0, 1, 3, 6])):
                bits[rng.randrange(words)] ^= 1 << rng.randrange(32)
            rows.append((len(rows), "ab"[f % 2], bits))
    return rows


@pytest.mark.parametrize("cut", [None, 4, 20])
def test_nearest_equals_all_pairs(spark, cut):
    rows = _rows(12, 9) + [(900, "a", None), (901, None, [0, 0, 0, 0]), (902, "c", [1, 2, 3, 4])]
    asked = {i for i, *_ in rows if i % 5 == 0}
    prints = spark.createDataFrame(rows, SCHEMA)
    got = C.nearest_by_bits(prints, prints.where(F.col("id").isin(sorted(asked))), 128, k=6, cut=cut)
    assert sorted(tuple(r) for r in got.collect()) == _plain(rows, asked, 6, cut)


def test_many_copies_and_questions_with_few_partners(spark):
    rows = [(i, "a", [7, 7]) for i in range(60)] + [(100 + i, "a", [7, 6]) for i in range(3)] + [(200, "b", [1, 1]), (201, "b", [-1 & 0xFFFFFFFF, 1])]
    prints = spark.createDataFrame(rows, SCHEMA)
    got = C.nearest_by_bits(prints, prints.where("id in (3, 59, 101, 200)"), 64, k=5)
    assert sorted(tuple(r) for r in got.collect()) == _plain(rows, {3, 59, 101, 200}, 5)


def test_no_rows(spark):
    prints = spark.createDataFrame([], SCHEMA)
    assert C.nearest_by_bits(prints, prints, 64).count() == 0


def test_near_families_meet_far_fewer_pairs_than_all(spark, monkeypatch):
    rows = _rows(150, 8)
    prints = spark.createDataFrame(rows, SCHEMA)
    left = []
    plain = C._nearest_of_all
    monkeypatch.setattr(C, "_nearest_of_all", lambda p, a, k, w: left.append(a.count()) or plain(p, a, k, w))
    got = C.nearest_by_bits(prints, prints.where("id % 10 = 0"), 128, k=4)
    assert sorted(tuple(r) for r in got.collect()) == _plain(rows, {i for i in range(0, 1200, 10)}, 4)
    assert left == [0]  # none of the questions needed its whole slot
    # pairs that one lookup of the pieces, and of those with a bit flipped, compares
    piece = lambda b: [(w, lo, b[w] >> lo & 0xFFFF) for w in range(4) for lo in (0, 16)]
    met = sum(any((x[2] ^ y[2]).bit_count() <= 1 for x, y in zip(piece(bits), piece(b), strict=True)) for i, s, bits in rows if i % 10 == 0 for _, t, b in rows if s == t)
    assert met * 20 < 120 * 600


def test_widths_must_fit(spark):
    prints = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        C.nearest_by_bits(prints, prints, 62, word=62)
