"""The opN_ queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from geolith.llm import decontamination, licenses, lm, media_ts, ngram_join, pii, quality, secret_scan, sentencepiece_codec, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir)).drop("found")


def model_path() -> str:
    """The SentencePiece model: SENTENCEPIECE_MODEL, or the public vocabulary's file."""
    if path := os.environ.get("SENTENCEPIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(_documents(spark, sf_dir), model_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_documents(spark, sf_dir)).drop("found")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_lm_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op8_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.stream_digests(_documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archived_captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    said = F.element_at(F.try_element_at("metadata", F.lit(1))["fields"], "payload-bytes").cast("long")
    return captures.select(
        warc.page_of("response.record_id").alias("page_id"),
        F.coalesce("response.payload_bytes", said).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        warc.page_of("response.refers_to").alias("refers_to"),
        F.size("requests").cast("long").alias("n_requests"),
        F.size("metadata").cast("long").alias("n_metadata"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_documents(spark, sf_dir), words_in_gram=4, percent=85)


OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS html FROM pages),
d AS (SELECT page_id, octet_length(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to,
       CAST(1 AS BIGINT) AS n_requests, CAST(1 AS BIGINT) AS n_metadata
FROM d LEFT JOIN f ON d.digest = f.digest
"""


OP10 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS root FROM d UNION SELECT l.y, r.root FROM r JOIN l ON r.x = l.x WHERE r.root < l.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(root) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licenses, op2_secret_scan, op3_sentencepiece, op4_quality, op5_pii, op6_decontamination, op7_lm_ppm, op8_media_ts, op9_warc, op10_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.sql(), "op9_warc": OP9, "op10_ngram_join": OP10}
