"""Items: dated text records with a source, and their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t

#: 2024-01-01 in UTC
START = 1704067200
QUALITY = {1: "primary", 2: "high_signal"}


def source_quality(tier: F.Column) -> F.Column:
    """By tier of authority: 1 primary, 2 high_signal, else discovery."""
    return F.when(tier == 1, QUALITY[1]).when(tier == 2, QUALITY[2]).otherwise("discovery")


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as items: the first line is the title, the rest the summary; time and tier follow from id and source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("item_id"),
        title.alias("title"),
        F.expr("substring(coalesce(text, ''), char_length(substring_index(coalesce(text, ''), '\n', 1)) + 2)").alias("summary"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        (F.lit(1) + F.coalesce(F.expr("try_cast(substring(source, 4) AS int)"), F.lit(2)) % 3).alias("tier"),
        F.timestamp_seconds(F.lit(START) + F.col("doc_id") % 30 * 86400 + F.col("doc_id") % 1440 * 60).alias("published_at"),
    ).withColumn("quality", source_quality(F.col("tier")))


def normalized(items: DataFrame) -> DataFrame:
    """Titles squeezed, composed (NFKC) and without a trailing source name, summaries without markup, canonical URLs."""
    return items.withColumns({"title": t.without_source(t.composed(t.squeezed(F.col("title"))), F.col("source_id")), "summary": t.composed(t.without_tags(F.col("summary"))), "url": t.canonical_url(F.col("url"))})


def with_keys(items: DataFrame) -> DataFrame:
    return items.withColumns({"fingerprint": t.fingerprint(F.col("url"), F.col("title")), "event_key": t.event_fingerprint(F.col("url"), F.col("title"), F.col("published_at"))})


def with_tokens(items: DataFrame) -> DataFrame:
    return items.withColumns({"tokens": t.title_tokens(F.col("title")), "day": F.to_date("published_at")})


def candidates(rows: DataFrame) -> DataFrame:
    """Candidates as sources give them: titles without character references, composed; summaries as plain text; canonical URLs; each page of ``provenance`` once, in order; an id where there is none.

    The id is made of the source's own id, else of the URL.
    """
    urls = F.array_distinct(F.array_compact(F.transform("provenance", t.canonical_url)))
    made = rows.withColumns({"title": t.composed(t.unescaped(t.squeezed(F.col("title")))), "summary": t.composed(t.unescaped(t.without_tags(F.col("summary")))), "url": t.canonical_url(F.col("url")), "provenance": urls})
    own = F.coalesce(F.nullif(F.col("native_id"), F.lit("")), F.col("url"))
    return made.withColumn("candidate_id", F.coalesce(F.nullif(F.col("candidate_id"), F.lit("")), t.short_id("item-", 24, F.col("source_id"), own)))


def publication_key() -> F.Column:
    """The key that a row was published with, else one of its id and the hash of its content, each of which its fingerprint stands in for."""
    known = F.col("key").startswith("chat|")
    part = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("fingerprint"))
    return F.when(F.coalesce(known, F.lit(False)), F.col("key")).otherwise(F.concat(F.lit("chat|"), part("candidate_id"), F.lit("|"), part("content_hash")))
