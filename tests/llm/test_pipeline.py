"""The pipeline against a plain version of its stages on a small folder."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = {"en": [f"the{i}th" for i in range(80)], "es": [f"ción{i}ñ" for i in range(80)]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = []
    for i in range(120):
        lang = "en" if i % 3 else "es"
        texts.append((" ".join(rng.choices(WORDS[lang], k=rng.randrange(20, 60))), lang))
    texts += [(texts[i][0], texts[i][1]) for i in range(0, 30, 3)]  # copies
    texts += [(texts[i][0] + " more", texts[i][1]) for i in range(40, 60, 4)]  # near copies
    item = " ".join(f"bench{i}" for i in range(14))
    texts += [("123 456", "en"), (None, "en"), (f"{texts[5][0]} {item} tail", "en")]
    data = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), data, item


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_run_equals_the_plain_version(spark, folder):
    at, data, item = folder
    lettered = [r for r in data if r[1] and re.search(r"[^\W\d_]", r[1])]
    comp = {r[0]: r[0] for r in lettered}
    sets = {r[0]: _shingles(r[1]) for r in lettered}
    for a in sets:
        for b in sets:
            if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = {k: min(x, y) if v in (x, y) else v for k, v in comp.items()}
    grams = {tuple(item.split()[i : i + 10]) for i in range(5)}
    words = {r[0]: re.findall(r"[0-9a-z\u0080-￿]+", r[1].lower()) for r in lettered}
    clean = {r[0]: r for r in lettered if comp[r[0]] == r[0] and not any(tuple(words[r[0]][i : i + 10]) in grams for i in range(len(words[r[0]])))}
    sizes = {}
    for r in clean.values():
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    got = corpus_pipeline.run(spark, at).collect()
    taken = {}
    for r in got:
        assert r["doc_id"] in clean and r["text"] == clean[r["doc_id"]][1]
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    total, weights = sum(sizes.values()), dict(zip(sorted(sizes), (3, 1, 2), strict=False))
    target, free, amount = {}, dict(weights), 1.5 * total
    while free:
        share = {s: amount * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            amount -= target[s]
            del free[s]
    # whole documents only: within half of the largest one
    largest = max(len(r[1].split()) for r in clean.values())
    assert all(abs(taken.get(s, 0) - t) <= largest / 2 for s, t in target.items())
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and max(shards) <= 39


def test_stages_return_the_columns_of_documents(spark, folder):
    at, data, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns and 0 < out.count()
