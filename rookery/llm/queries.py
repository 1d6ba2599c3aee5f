"""The registered queries of this package: each applies one operator with production parameters to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import decontaminate, divergence, html_text, language, licenses, minhash, pieces, quality, sharding, simhash, spelling, toxicity, url_filter
from rookery.llm.common import read


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.quality_rules(read(spark, folder, "documents"))
    return found.select("doc_id", *quality.BASE, "base_failed", "kept", "p_quality", *[f"vote_{r.name}" for r in quality.RULES])


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(read(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(licenses.paths_of(read(spark, folder, "documents")))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read(spark, folder, "pages"))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(read(spark, folder, "pages"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(read(spark, folder, "documents"))


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_pieces(read(spark, folder, "documents"), pieces.default_path())


def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(read(spark, folder, "documents"))


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read(spark, folder, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_simhash": op5_simhash,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_main_text": op8_main_text,
    "op9_language": op9_language,
    "op10_pieces": op10_pieces,
    "op11_minhash": op11_minhash,
    "op12_spelling": op12_spelling,
    "op13_divergence": op13_divergence,
}

ORACLE = {
    "op2_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, len(gram) AS n, array_to_string(gram, ' ') AS gram
  FROM (SELECT item, unnest(list_transform(range(0, greatest(len(w) - 10, 0) + 1), lambda i: w[i + 1 : i + 10])) AS gram FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM g),
s AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, k WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.i, s.n, g.item FROM s JOIN g USING (n, gram)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
