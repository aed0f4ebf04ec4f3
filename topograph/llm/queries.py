"""Queries opN_<name> over the given tables, one for each operator, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "sha")


@query
def op7_greedy_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


@query
def op8_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.sharding import shards

    return shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query
def op9_media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.media import stored_payloads

    return stored_payloads(table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op2_url_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


ORACLE_SQL["op2_url_digest_filter"] = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, r.h || r.p AS rule, r.verdict FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM m GROUP BY page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (page_id)
"""


@query
def op3_consensus_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query
def op6_separator_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.token_counts import document_token_counts

    return document_token_counts(table(spark, sf_dir, "documents"))


def _shard_oracle() -> str:
    from topograph.llm.sharding import oracle

    return oracle(SHARD_BYTES)


ORACLE_SQL["op8_extendible_hash_shards"] = _shard_oracle()


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.periods import periodic_runs, planted, run_digests

    return run_digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))


@query
def op12_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.rank_bpe import digests

    return digests(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label))


ORACLE_SQL["op13_hard_negatives"] = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
