"""A pipeline over ``documents``: each stage reads what its predecessor kept.

All stages but the last return the columns of ``documents``. Every stage takes
null, empty and very long texts, repeated rows and ids, empty tables and further
columns of any name: null and empty texts have no words, so no later stage than
the classifier drops them; of rows with one id near-dedup keeps one; rows with a
null id are kept by near-dedup and substring dedup as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontamination, minhash_dedup, quality, sentencepiece_codec, substring_dedup


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return minhash_dedup.keep_first(docs)


def substring_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document with a smaller id are cut; documents of which nothing is left go."""
    return substring_dedup.clean(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents of which nothing is left go."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids and the digest of the ids decoded again."""
    return sentencepiece_codec.encode(docs, decoded_sha256="decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup_),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]
#: SQL can't express the classifier; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
