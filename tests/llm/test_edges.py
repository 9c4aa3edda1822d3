"""What the operators answer at the edges: values of nulls, ties, repeats, long texts and clashing columns."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from visitloom.llm import decontamination, language_id, line_dedup, mixing, near_dedup, sharding, token_files, topk, toxicity, url_filter

LONG = "alpha beta " * 30_000
ROWS = [(0, None), (1, ""), (2, "   "), (3, "one two three four five six"), (3, "one two three four five six"), (4, "one two three four five six"), (None, "one two three four five six"), (5, LONG), (6, "12 34")]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns named like results must come out as they went in, or be replaced by the operator's."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") != 4, "s")})
    return df.withColumns({c: F.lit("own") for c in ("score", "size", "shard", "slot", "kept", "n_words", "items", "copy", "repeats", "cell", "part", "rep")})


def _by(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_languages(docs):
    told = language_id.identify(docs, language_id.learn(docs))
    assert set(_by(told, "doc_id", "lang_pred")) == {(0, "und"), (1, "und"), (2, "und"), (6, "und"), (3, "en"), (4, "en"), (5, "en"), (None, "en")}
    assert {r["score"] for r in told.where("lang_pred = 'und'").collect()} == {0.0}
    assert _by(language_id.keep_identified(docs), "doc_id", "score") == _by(docs.where("doc_id is null or doc_id in (3, 4, 5)"), "doc_id", "score")


def test_language_ties_go_to_the_smaller_name(spark):
    same = spark.createDataFrame([(1, "abc abc", "b"), (3, "abc abc", "a"), (9, "abc abc", None)], "doc_id long, text string, lang string")
    same = same.where("crc32(cast(doc_id as string)) % 4 <> 2 or lang is null")
    if same.where("lang is not null").count() == 2:
        assert {r["lang_pred"] for r in language_id.identify(same, language_id.learn(same)).collect()} == {"a"}


def test_near_duplicates(docs):
    assert _by(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(
        [(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (None, 2, None, True), (5, 2, 5, True), (6, 1, 6, True)], key=str
    )


def test_mixing(docs):
    told = mixing.mix(docs)
    assert _by(told, "doc_id", "size") == sorted([(0, 0), (1, 0), (2, 0), (3, 6), (3, 6), (4, 6), (None, 6), (5, 60_000), (6, 2)], key=str)
    assert len({r["repeats"] for r in told.where("doc_id = 3").collect()}) == 1
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {r["copy"] for r in out.select("copy").collect()} == {"own"}


def test_settling_ties_are_settled_alike(spark):
    rows = spark.range(40).selectExpr("id as doc_id", "'a b c' as text", "'s' as source")
    assert _by(mixing.mix(rows, budget=0.5), "doc_id", "repeats") == _by(mixing.mix(rows.repartition(7), budget=0.5), "doc_id", "repeats")


def test_token_files(docs):
    import public_tokenizers

    told = token_files.encode_and_read_back(docs, public_tokenizers.path("byte_bpe_50k.json"))
    rows = _by(told, "start", "doc_id", "n_tokens", "ids_crc32")
    assert len(rows) == len(ROWS)
    empty = zlib.crc32(b"\0\0\0\0")
    assert {r[2:] for r in rows if r[1] in (0, 1)} == {(1, empty)}
    starts = sorted((r[0], r[2]) for r in rows)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    assert starts[0][0] == 0 and min(rows, key=lambda r: r[0])[1] is None  # null ids first


def test_shards(docs):
    told = sharding.shard(docs, 3)
    assert _by(told, "doc_id", "size") == sorted([(i, len((t or "").encode()) + 16) for i, t in ROWS], key=str)
    assert {r["text_crc32"] for r in told.where("doc_id = 0 or doc_id = 1").collect()} == {0}
    assert {r["kept"] for r in told.collect()} == {"own"} and told.columns[-2:] == ["shard", "slot"]
    assert len({(r["shard"], r["slot"]) for r in told.collect()}) == len(ROWS)
    one_id = docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3"))
    assert sorted(r["slot"] for r in sharding.shard(one_id, 1).collect()) == [0, 1, 2, 3]


def test_contamination(docs, spark):
    bench = spark.createDataFrame([("b", "TWO, three"), ("a", "two three"), ("n", None), ("e", "")], "item_id string, text string")
    told = decontamination.contamination(docs, bench)
    assert _by(told, "doc_id", "n_words", "hit_words", "items") == sorted(
        [(i, len((t or "").split()), [2, 3] if t and "two" in t else [], ["a", "b"] if t and "two" in t else []) for i, t in ROWS], key=str
    )
    assert _by(decontamination.remove_documents(docs, bench), "doc_id", "n_words") == sorted([(0, "own"), (1, "own"), (2, "own"), (5, "own"), (6, "own")], key=str)
    assert {r["text"] for r in decontamination.remove_spans(docs, bench).where("doc_id = 4").collect()} == {"one four five six"}
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_lines(docs):
    told = line_dedup.deduplicate_lines(docs)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in told.where("doc_id is not null").collect()}
    assert got == {0: (0, 0, "own"), 1: (1, 0, "own"), 2: (1, 0, "own"), 3: (1, 0, "own"), 4: (1, 1, "own"), 5: (1, 0, "own"), 6: (1, 0, "own")}
    assert told.where("doc_id is null").first()["text"] == "one two three four five six"


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(3, 0), (4, 1), (None, 1), (6, None), (5, 0)], "doc_id long, toxic int")
    told = toxicity.score(docs, toxicity.learn(docs, labels))
    assert told.count() == len(ROWS) and {r["kept"] for r in told.collect()} == {"own"}
    assert len({r["score"] for r in told.where("doc_id in (0, 1, 2)").collect()}) == 1
    assert max(r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect()) < 1e-6


def test_urls(spark):
    url = "https://Example.COM/en/7" + "x" * 100_000
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, url), (4, url), (5, "://.com/en/"), (6, "a://com/en/?q")], "page_id long, url string")
    pages = pages.withColumns({"host": F.lit("own"), "verdict": F.lit("own"), "key": F.lit("own")})
    told = url_filter.judge(pages)
    assert _by(told, "page_id", "host", "rule", "verdict", "key")[:3] == [(1, "", None, "allow", "own"), (2, "", None, "allow", "own"), (3, "", None, "allow", "own")]
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in told.where("page_id > 3").collect()} == {(4, "example.com/en/7", "allow"), (5, "com/en/", "block"), (6, "com/en/", "block")}


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, []), (7, [0.5] * 5000), (None, [9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("own"), "rank": F.lit("own"), "id": F.lit("own")})
    got = _by(topk.search(vectors, F.col("id") == 0), "rank", "vec_id", "score")
    assert got == [(1, 1, 65536), (2, 1, 65536), (3, 7, 32768), (4, 6, 0)]


@pytest.mark.parametrize("case", ["no documents", "no benchmark", "clashing"])
def test_pipeline(spark, tmp_path, case, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.limit(0) if case == "no documents" else docs
    docs = docs.withColumns({c: F.lit("own") for c in ("score", "mixture", "hit_words", "repeats", "gone_doc", "component_id")}) if case == "clashing" else docs
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    (bench.limit(0) if case == "no benchmark" else bench).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"]
    n = out.count()
    assert (n == 0) == (case == "no documents")
    if case == "clashing":
        assert out.where("score <> 'own' or mixture <> 'own' or hit_words <> 'own' or repeats <> 'own' or gone_doc <> 'own' or component_id <> 'own'").count() == 0
        plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
        plain.write.parquet(str(tmp_path / "plain" / "documents.parquet"))
        bench.write.parquet(str(tmp_path / "plain" / "benchmark.parquet"))
        assert n == corpus_pipeline.run(spark, str(tmp_path / "plain")).count()
