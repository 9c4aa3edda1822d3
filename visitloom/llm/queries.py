"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm import decontamination, impact_search, language_id, line_dedup, mixing, near_dedup, phrases, sharding, suffix_tree, token_files, topk, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs), keep=["doc_id"])
    held_out = F.coalesce(~language_id.admitted(F.col("doc_id")), F.lit(False))  # a null id has no remainder
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.map_keys("mixture").alias("languages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = mixing.mix(_table(spark, sf_dir, "documents"))
    return told.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.encode_and_read_back(_table(spark, sf_dir, "documents"), tokenizer)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return told.select("page_id", "host", "path", "rule", "verdict")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = line_dedup.removed_lines(_table(spark, sf_dir, "documents"))
    return told.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = sharding.shard(_table(spark, sf_dir, "documents"))
    return told.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decontamination.contamination(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    )
    return told.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    told = toxicity.score(docs, lexicon, keep=["doc_id"])
    held_out = F.coalesce(~toxicity.admitted(F.col("doc_id")), F.lit(False))  # a null id has no remainder
    return told.select("doc_id", held_out.alias("held_out"), "score", "predicted", "hits")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    told = suffix_tree.score(docs, ~held_out, keep=["doc_id"])
    held_out = F.coalesce(held_out, F.lit(False))  # a null id has no remainder
    return told.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = impact_search.build(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return impact_search.search(index, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_near_dedup, op3_mixing, op4_token_files, op5_topk, op6_url_filter, op7_line_dedup, op8_sharding, op9_decontamination, op10_toxicity, op11_lm_scoring, op12_phrase_mining, op13_ranked_search)}

_SIZES = r"""
sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
)"""

ORACLE_SQL = {
    "op2_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, hash(list_slice(w, s, s + 4), least(len(w), 5)) AS g
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(s) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_of AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM both_of JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, ways.b FROM reach JOIN ways ON reach.seen = ways.a
),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = d.doc_id
""",
    "op3_mixing": f"""
WITH {_SIZES},
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sizes GROUP BY source
),
-- sources in the order in which rising water meets their caps
filled AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS held,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free,
         1.5::DOUBLE * sum(source_size) OVER () AS amount
  FROM totals
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (
  SELECT *, (weight * (amount - held)) / free AS share FROM filled
),
first_free AS (
  SELECT held, free, amount FROM level WHERE share <= 2 * source_size
  ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1
),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.free IS NULL OR (l.weight * (f.amount - f.held)) / f.free > 2 * l.source_size THEN (2 * l.source_size)::DOUBLE
              ELSE (l.weight * (f.amount - f.held)) / f.free END AS target
  FROM level l LEFT JOIN first_free f ON true
),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
),
need AS (SELECT *, target - whole * source_size AS need FROM plan),
ordered AS (
  SELECT s.*, n.source_size, n.target, n.whole, n.need,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sizes s JOIN need n ON s.source IS NOT DISTINCT FROM n.source
),
c0 AS (SELECT *, CASE WHEN need > 0 AND upto - size / 2.0 <= need THEN 1 ELSE 0 END AS extra FROM ordered),
g0 AS (SELECT *, need - sum(extra * size) OVER (PARTITION BY source) AS gap FROM c0),
b0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN extra = CASE WHEN gap > 0 THEN 0 ELSE 1 END AND size > 0 AND abs(abs(gap) - size) < abs(gap) THEN abs(abs(gap) - size) END ASC NULLS LAST, h, doc_id) AS rn FROM g0),
c1 AS (SELECT * EXCLUDE (extra, gap, rn), CASE WHEN rn = 1 AND extra = CASE WHEN gap > 0 THEN 0 ELSE 1 END AND size > 0 AND abs(abs(gap) - size) < abs(gap) THEN 1 - extra ELSE extra END AS extra FROM b0),
g1 AS (SELECT *, need - sum(extra * size) OVER (PARTITION BY source) AS gap FROM c1),
b1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN extra = CASE WHEN gap > 0 THEN 0 ELSE 1 END AND size > 0 AND abs(abs(gap) - size) < abs(gap) THEN abs(abs(gap) - size) END ASC NULLS LAST, h, doc_id) AS rn FROM g1),
c2 AS (SELECT * EXCLUDE (extra, gap, rn), CASE WHEN rn = 1 AND extra = CASE WHEN gap > 0 THEN 0 ELSE 1 END AND size > 0 AND abs(abs(gap) - size) < abs(gap) THEN 1 - extra ELSE extra END AS extra FROM b1)
SELECT doc_id, size, source_size, target, (size * (whole + extra))::BIGINT AS taken FROM c2
""",
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op6_url_filter": r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (page_id)
""",
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, l AS line_no,
         list_sort(list_distinct(list_filter(regexp_split_to_array(lower(string_split(text, chr(10))[l + 1]), '[\x20\x09\x0B-\x0D]'), lambda w: w <> ''))) AS w
  FROM documents, unnest(range(len(string_split(text, chr(10))))) t(l) WHERE text IS NOT NULL
),
cls AS (SELECT w, min((doc_id, line_no)) AS pos, len(w) AS n FROM lines WHERE len(w) > 0 GROUP BY w),
toks AS (SELECT pos, n, unnest(w) AS t FROM cls),
pairs AS (
  SELECT x.pos AS later FROM toks x JOIN toks y ON x.t = y.t AND y.pos < x.pos AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY x.pos, y.pos, x.n, y.n HAVING count(*) * 19 >= (x.n + y.n) * 9
),
goes AS (SELECT DISTINCT later FROM pairs),
judged AS (
  SELECT l.doc_id, l.line_no, len(l.w) > 0 AND ((l.doc_id, l.line_no) <> c.pos OR c.pos IN (SELECT later FROM goes)) AS gone
  FROM lines l LEFT JOIN cls c ON l.w = c.w
)
SELECT doc_id, count(DISTINCT line_no) AS n_lines, count(DISTINCT line_no) FILTER (gone) AS n_removed,
       coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (gone), '') AS removed
FROM judged GROUP BY doc_id
""",
    "op9_decontamination": r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, list_slice(w, s, s + least(10, len(w)) - 1) AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0
),
d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
spots AS (
  SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g
  FROM d, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(w) - n + 2)) t(s)
),
hits AS (SELECT doc_id, item, s, spots.n FROM spots JOIN win ON spots.n = win.n AND spots.g = win.g),
per AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit, count(DISTINCT item) AS n_items,
         sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha
  FROM hits, unnest(range(s, s + n)) t(p) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id)
""",
    "op12_phrase_mining": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM w, (VALUES (1), (2), (3)) sizes(k)
),
f AS (SELECT lang, k, g, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
parts AS (
  SELECT lang, k, g, a, cut, array_to_string(w[1:cut], ' ') AS first_part, array_to_string(w[cut + 1:], ' ') AS rest
  FROM often, (VALUES (1), (2)) x(cut) WHERE cut < k
),
cuts AS (
  SELECT c.lang, c.k, c.g, c.a, c.cut, l.a AS l, r.a AS r, ((1000000 * c.a * c.a) // (l.a * r.a)) AS score
  FROM parts c JOIN f l ON l.lang = c.lang AND l.g = first_part JOIN f r ON r.lang = c.lang AND r.g = rest
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS g, max(a) AS longest
  FROM often, (VALUES (1), (2)) p(i) WHERE k = 3 GROUP BY ALL
),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.g = lowest.g
  WHERE longest IS NULL OR 100 * longest < 50 * a
),
ranked AS (SELECT *, g AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM kept)
SELECT lang, rank::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
    "op13_ranked_search": r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
q AS (SELECT item_id, term, count(*) AS repeats FROM b GROUP BY ALL),
len_of AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len_of),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, whole),
s AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len_of USING (doc_id), whole GROUP BY ALL
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
""",
}
