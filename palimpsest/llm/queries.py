"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, linededup, mixing, packing, ppm, sharding, simhash, tiff, toxicity, urlfilter

SHARDS = 40


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kmeans_tree_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.knn(_table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, ["doc_id"])
    return scored.withColumn("held_out", toxicity.held_out()).select("doc_id", "held_out", "score", "predicted", "worst_score", "worst_start", "worst_end")


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest_media(tiff.store_texts(_table(spark, sf_dir, "documents")))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(_table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, urlfilter.RULES))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_kmeans_tree_knn, op2_toxicity, op3_tiff_pages, op4_ppm, op5_url_rules, op6_line_dedup, op7_minimax_shards, op8_simhash, op9_source_mix, op10_harmonic_packing]
    return {f.__name__: f for f in own}


_WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH u AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN {_ASCII_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
k AS (SELECT row_number() OVER () AS k, * FROM u),
best AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM k, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM k LEFT JOIN best USING (k)
"""

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT k, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
n AS (SELECT *, {_ASCII_LOWER.format(f"trim(line, {_WS})")} AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last FROM n WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT n.*, (hot.key IS NOT NULL AND doc_id <> last) AS gone FROM n LEFT JOIN hot USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY k
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_rules": OP5_SQL, "op6_line_dedup": OP6_SQL}
