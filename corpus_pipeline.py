"""Corpus pipeline over documents; counted as part of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. The first four return the columns of documents; the last
returns one row of token ids per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geolith.llm import decontamination, ngram_join, pii, quality, sentencepiece_codec
from geolith.llm.queries import model_path
from geolith.tables import dropped, materialised


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of quality."""
    return quality.kept(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word grams, similarity 0.8)."""
    return ngram_join.deduplicated(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars of the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids, source spans and decoded text."""
    return sentencepiece_codec.encode_digests(docs, model_path(), with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_copies),
    ("personal data", redact_personal_data),
    ("SentencePiece encoding", tokenise),
]

#: SQL can express neither the classifier nor alignment nor the encoding; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialised(stage(spark, docs, sf_dir))
        dropped(before)
    return docs
