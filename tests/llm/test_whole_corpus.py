"""Training-pipeline operators leave nothing out that they should keep."""

import random
import zlib

import pytest

language_id = pytest.importorskip("visitloom.llm.language_id")


def test_short_and_evenly_mixed_texts_are_identified(spark):
    rng = random.Random(3)
    words = {lang: ["".join(rng.choices(letters, k=6)) for _ in range(60)] for lang, letters in (("x", "abcdef"), ("y", "ghijkm"), ("z", "nopqrs"))}
    data = [(i, " ".join(rng.choices(words[lang], k=80)), lang) for i, lang in enumerate(["x", "y", "z"] * 20)]
    # alike languages, over which the mixture of all spreads
    learned = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 != 2]
    data += [(i, "tuvw wxyz uvxt " * 20, f"t{k % 4}") for k, i in enumerate(learned[:12])]
    even = " ".join(" ".join(rng.choices(words[lang], k=200)) for lang in "xyz")
    data += [(1000, "tuvw wxyz", None), (1001, even, None), (1002, "12 34", None), (1003, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    told = {r["doc_id"]: r for r in language_id.identify(docs, language_id.learn(docs)).where("doc_id >= 1000").collect()}
    assert len(told[1000]["mixture"]) == 1 and told[1000]["score"] < 0.4
    assert len(told[1001]["mixture"]) == 3 and told[1001]["score"] < 0.4
    kept = {r["doc_id"] for r in language_id.keep_identified(docs).collect()}
    assert kept == {r[0] for r in data} - {1002, 1003}


def test_a_rich_lexicon_keeps_its_frequent_words(spark):
    toxicity = pytest.importorskip("visitloom.llm.toxicity")
    rng = random.Random(7)
    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 != 1][:250]
    bad, good = ids[:50], ids[50:]
    rare = {"".join(rng.choices("bcdefghjkmnpqrstuvwxyz", k=9)) for _ in range(4600)}
    words = {i: ["often"] for i in bad} | {i: ["often" if k < 12 else "never", "calm"] for k, i in enumerate(good)}
    for w in sorted(rare):
        for i in rng.sample(bad, 2):
            words[i].append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in bad)) for i in ids], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert [w for w in ("often", *sorted(rare)) if not lexicon.hits(toxicity.fold(w))] == []
