"""The queries of the training-data operators; ORACLES has the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import decontamination, language_id, manifest, minhash, mixing, oracles, packing, prefix_trie, token_counts, token_files, topk, toxicity, url_filter, vector_dedup
from undula.llm.common import dropped_at_end, fold, read_table, shared_folder

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    dropped_at_end(spark, path)
    return token_files.digest(token_files.read_token_files(spark, path))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("mix_rate", 9).alias("mix_rate"), "mix_copies", "mix_copy", F.round("mix_place", 9).alias("mix_place"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLES["op10_mixing"] = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM counts)::DOUBLE * (pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM counts)) / n AS rate FROM counts),
parts AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.source, md5(coalesce(d.text, '')) AS text_md5, d.text IS NULL AS no_text, rate, greatest(1, ceil(rate / {mixing.MOST_MEAN}))::INT AS parts
  FROM documents d JOIN rates ON d.source IS NOT DISTINCT FROM rates.source),
drawn AS (
  SELECT r, rate / parts AS m, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE AS u
  FROM parts, unnest(range(1, parts + 1)) AS t(j)),
walk AS (
  SELECT r, m, u, 0 AS k, exp(-m) AS p, exp(-m) AS cdf FROM drawn
  UNION ALL
  SELECT r, m, u, k + 1, p * m / (k + 1), cdf + p * m / (k + 1) FROM walk WHERE cdf <= u AND k < {mixing.MOST_COPIES}),
n AS (SELECT r, sum(k)::INT AS copies FROM (SELECT r, u, max(k) AS k FROM walk GROUP BY r, u, m) GROUP BY r)
SELECT doc_id, source, round(rate, 9) AS mix_rate, copies AS mix_copies, i::INT AS mix_copy,
  round(('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE, 9) AS mix_place,
  CASE WHEN no_text THEN NULL ELSE text_md5 END AS text_md5
FROM parts JOIN n USING (r), unnest(range(1, copies + 1)) AS t(i)
"""


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: The rules that the contract names.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), RULES)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on_fold(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train_on_fold(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


ORACLES["op8_top_k"] = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS codes
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.codes, c.codes)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.codes) = len(c.codes) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op11_decontamination"] = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(10, len(ws)) AS size, list_slice(ws, i, i + least(10, len(ws)) - 1) AS gram
  FROM items, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM grams),
placed AS (
  SELECT r, i, size, list_slice(ws, i, i + size - 1) AS gram
  FROM cut, sizes, unnest(range(1, len(ws) - size + 2)) AS t(i) WHERE len(ws) >= size),
hits AS (SELECT r, i, p.size, item FROM placed p JOIN grams g ON p.gram = g.gram AND p.size = g.size),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, i, size FROM hits), unnest(range(i, i + size)) AS t(k) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.history_trie(read_table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = oracles.TRIE


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.prove(read_table(spark, sf_dir, "documents"))


ORACLES["op13_manifest"] = oracles.manifest()


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
