"""Operators of the training pipeline on small fixtures: nulls, empty tables, ties, brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.llm import components, decontamination, language_id, line_dedup, mixing, near_dedup, sharding, token_files, topk, toxicity, url_filter
from visitloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts, **more):
    data = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, DOCS)


EDGE = [None, "", "   ", "one", "one two three four five six", "one two three four five six", "12 34", "x" * 200_000, "a b " * 20_000]


@pytest.fixture(scope="module")
def edge(spark):
    """Odd texts, repeated rows, null ids and sources, and columns that clash with results."""
    df = _docs(spark, EDGE)
    df = df.unionByName(df.where("doc_id = 4")).unionByName(df.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    df = df.withColumn("source", F.when(F.col("doc_id") % 4 != 0, F.col("source")))
    return df.withColumns({"score": F.lit("kept"), "size": F.lit(1), "shard": F.lit(2), "n_words": F.lit(3), "copy": F.lit(4)})


def test_edge_rows_survive_every_operator(spark, edge):
    n = edge.count()
    assert language_id.identify(edge, language_id.learn(edge)).count() == n
    assert near_dedup.near_duplicates(edge).count() == n
    assert mixing.mix(edge).count() == n
    assert token_files.encode_and_read_back(edge, _tokenizer()).count() == n
    assert sharding.shard(edge, 4).count() == n
    bench = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "")], "item_id long, text string")
    assert decontamination.contamination(edge, bench).count() == n
    labels = spark.createDataFrame([(4, 0), (5, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(edge, toxicity.learn(edge, labels)).count() == n
    assert line_dedup.deduplicate_lines(edge).count() == n
    for keep in (language_id.keep_identified, near_dedup.keep_one, lambda d: decontamination.remove_documents(d, bench), lambda d: decontamination.remove_spans(d, bench), mixing.mixed_documents):
        assert keep(edge).columns == edge.columns


def test_empty_tables(spark):
    none = _docs(spark, []).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert language_id.identify(none, language_id.learn(none)).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert token_files.encode_and_read_back(none, _tokenizer()).count() == 0
    assert sharding.shard(none).count() == 0
    assert decontamination.contamination(none, bench).count() == 0
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    assert line_dedup.removed_lines(none).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 2 == 0).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    some = _docs(spark, ["a b c"])
    assert decontamination.contamination(some, bench).collect()[0]["contaminated"] is False
    assert toxicity.score(some, toxicity.learn(some, labels)).collect()[0]["score"] < 0.01


def _tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_language_rules(spark):
    words = {"aa": "thing then that this there", "bb": "quando ciñon señor el que", "cc": "über straße nicht schön"}
    rng = random.Random(3)
    data = []
    for i in range(120):
        lang = ["aa", "bb", "cc"][i % 3]
        data.append((i, " ".join(rng.choices(words[lang].split(), k=30)), lang))
    data += [(200, "123 !!", None), (201, None, "aa"), (202, words["aa"] * 5 + " " + words["bb"] * 5, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df, language_id.learn(df)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in data[:120])
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == "und" and got[200]["score"] == 0
    assert set(got[202]["mixture"]) == {"aa", "bb"}


def _brute(texts, k=5):
    sets = []
    for t in texts:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()] if t else []
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [len(s) for s in sets], comp


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", "a b", "A B"]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(6, 120))
        for _ in range(rng.randrange(1, 8)):
            new = [rng.choice(vocabulary) if rng.random() < 0.03 else w for w in base]
            texts.append(" ".join(new))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(_docs(spark, texts)).collect())
    sizes, comp = _brute(texts)
    assert got == [(i, sizes[i], comp[i], comp[i] == i) for i in range(len(texts))]


def test_two_blocks_of_a_bucket_are_compared(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice("xyz") + w if rng.random() < 0.02 else w for w in base) for _ in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(_docs(spark, texts)).collect()}
    assert [got[i] for i in range(30)] == _brute(texts)[1]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_mix_respects_caps_and_comes_near(spark):
    rng = random.Random(5)
    data = [(i, "w " * rng.randrange(1, 50), "en", s, 0) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + [None] * 10)]
    got = mixing.mix(spark.createDataFrame(data, DOCS)).withColumn("taken", F.col("size") * F.col("repeats"))
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.max("repeats").alias("r")).collect()}
    total = sum(r["size"] for r in by.values())
    assert abs(sum(r["target"] for r in by.values()) - 1.5 * total) < 1e-6
    for r in by.values():
        assert r["target"] <= 2 * r["size"] and r["r"] <= 2 and abs(r["t"] - r["target"]) <= 5
    again = mixing.mix(spark.createDataFrame(data, DOCS).repartition(7))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got.drop("taken").collect()), key=str)


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(_tokenizer())
    rng = random.Random(2)
    bits = ["the", " the", "  ", "\n", "'s", "don't", "é", "日本", "<|endoftext|>", "12", "!?", "\t", "　", " x", "\x1c"]
    texts = [None, ""] + ["".join(rng.choices(bits, k=rng.randrange(0, 25))) for _ in range(150)] + ["long word " * 9000]
    scratch = Scratch(spark, "tokens-test")
    got = sorted(token_files.encode_and_read_back(_docs(spark, texts), _tokenizer(), scratch=scratch).collect())
    start = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    name = spark.read.parquet(scratch.path("manifest")).first()["name"]
    batch = token_files.open_file(scratch.path("files"), f"{name}.arrow").get_batch(0)
    assert batch.schema.field("ids").type.list_size == token_files.SEQUENCE == batch.schema.field("mask").type.list_size


def test_topk_ties_and_odd_vectors(spark):
    data = [(i, [float(i % 3), 1.0, -0.5]) for i in range(40)] + [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 1.0, 1.0]), (53, [float("inf"), 0.0, 0.0]), (54, [2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = topk.search(df, F.col("id") % 10 == 0, rows=7, queries=2).collect()
    vec = {i: np.floor(256 * np.array(v)).astype(int) for i, v in data if v and None not in v and np.isfinite(v).all()}
    dot = lambda a, b: int(sum(x * y for x, y in zip(vec[a], vec[b], strict=False)))
    for q in (0, 10, 20, 30):
        want = sorted((-dot(q, c), c) for c in vec if c != q)[:5]
        assert [(r["rank"], -r["score"], r["vec_id"]) for r in sorted(got) if r["query_id"] == q] == [(i + 1, *w) for i, w in enumerate(want)]


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = universe.where("cast(substr(key, 2) as int) % 37 = 0")
    cascade = url_filter.Cascade.build(listed, universe)
    told = universe.select("key", cascade.contains(F.col("key")).alias("in"))
    assert told.where("in <> (cast(substr(key, 2) as int) % 37 = 0)").count() == 0 and len(cascade.levels) > 1


def test_url_rules(spark):
    urls = ["http://EXAMPLE.com/en/7x?q", "https://a.example.com/en/8", "ftp://x.com/en/", "http://notexample.net/de/8", "http://b.example.net/de/80#f", "http://org/es/", "x", None, "http://com", "a://b://com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got[0] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("org/es/", "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("com", "", None, "allow") and got[9][0] == "b:"


def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(4)
    texts = ["hot group " * 30] * 400 + ["t" * rng.randrange(0, 900) + str(i) for i in range(800)]
    got = sharding.shard(_docs(spark, texts), 8).collect()
    size, slots, homes = {}, {}, {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(r["text"], set()).add(r["shard"])
    ideal = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(s - ideal) < 0.05 * ideal + 1000 for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for t, h in homes.items() if not t.startswith("hot"))


def test_contamination_short_items_and_spans(spark):
    bench = spark.createDataFrame([(1, "Alpha beta, gamma"), (2, " ".join(f"b{i}" for i in range(12)))], "item_id long, text string")
    texts = ["x ALPHA beta-gamma y", "É alpha beta", "q " + " ".join(f"b{i}" for i in range(11)) + " z", None]
    got = {r["doc_id"]: r for r in decontamination.contamination(_docs(spark, texts), bench).collect()}
    assert [len(got[i]["hit_words"]) for i in range(4)] == [3, 0, 11, 0] and got[0]["items"] == ["1"] and got[2]["n_words"] == 13
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(_docs(spark, texts), bench).collect()}
    assert cut[0] == "x y" and cut[1] == texts[1] and cut[2] == "q z" and cut[3] is None
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_toxicity_folds_and_excuses(spark):
    rng = random.Random(9)
    data, labels = [], []
    for i in range(400):
        words = rng.choices([f"plain{j}" for j in range(200)], k=40)
        bad = i % 4 == 0
        if bad:
            words[5:5] = ["vilewordx"] * 2
        if i % 40 == 1:
            words[3:3] = ["vilewordx", "plantname"]
        data.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    data += [(900, "so V1LЕWОRDX and vi1ewordx again with plain1 words"), (901, "just plain1 words here"), (902, "the vilewordx plantname grows")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    assert got[900]["predicted"] == 1 and got[901]["predicted"] == 0 and got[902]["hits"] == 0
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in range(400)) > 390


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    lines = [" ".join(rng.choices([f"v{i}" for i in range(300)], k=rng.randrange(1, 40))) for _ in range(40)]
    texts = []
    for _ in range(60):
        some = [rng.choice(lines).split() for _ in range(4)]
        texts.append("\n".join(" ".join(w if rng.random() > 0.02 else "zz" for w in ws) for ws in some) + "\n\n")
    seen, want = [], {}
    for d, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            s = set(line.lower().split())
            if s and any(10 * len(s & o) >= 9 * len(s | o) for o in seen):
                want.setdefault(d, []).append(n)
            if s:
                seen.append(s)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(_docs(spark, texts)).collect()}
    assert got == {d: want.get(d, []) for d in range(len(texts))}
