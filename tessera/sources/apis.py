"""JSON answers of public interfaces as items: parsed with a schema, one row a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions import times

FILINGS = "cik string, name string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, primaryDocument: array<string>, primaryDocDescription: array<string>>>"
NOTICES = "count int, total_pages int, results array<struct<document_number: string, title: string, publication_date: string, type: string, abstract: string, html_url: string>>"
NEWS = "results array<struct<date: string, title: string, url: string, uuid: string, teaser: string, topic: string>>"
RELEASES = "result struct<currentPage: int, totalPagesCount: int, items: array<struct<MediaReleaseId: string, Title: string, DateTime: string, Url: string, AgencyAbbr: string>>>"


def answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def filings(answer: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    """Column-parallel arrays as rows, shorter ones padded with null; wanted forms, each accession once, and the watermark of its issuer."""
    r = "filings.recent."
    zipped = F.arrays_zip(*[F.coalesce(F.col(r + c), F.array().cast("array<string>")) for c in ("accessionNumber", "form", "filingDate", "primaryDocument", "primaryDocDescription")])
    rows = answer.select("cik", "name", F.inline_outer(zipped)).toDF("cik", "name", "native_id", "form", "filed", "document", "title")
    rows = rows.where(F.col("form").isin(*forms)).dropDuplicates(["cik", "native_id"])
    return rows.withColumn("published_at", times.parse_iso(F.col("filed")))


def watermarks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cik").agg(F.max(F.concat_ws(":", "filed", "native_id")).alias("watermark"))


def notices(answer: DataFrame) -> DataFrame:
    return answer.select(F.inline("results")).select(F.col("document_number").alias("native_id"), t.squeezed(F.col("title")).alias("title"), F.col("html_url").alias("url"), times.parse_iso(F.col("publication_date")).alias("published_at"), t.without_tags(F.col("abstract")).alias("summary")).dropDuplicates(["native_id"])


def news(answer: DataFrame) -> DataFrame:
    return answer.select(F.inline("results")).select(F.col("uuid").alias("native_id"), t.squeezed(F.col("title")).alias("title"), "url", times.parse_epoch(F.col("date")).alias("published_at"), t.without_tags(F.col("teaser")).alias("summary")).dropDuplicates(["native_id"])


def releases(answer: DataFrame, base: str, zone: str = "Asia/Singapore") -> DataFrame:
    """Local times without a zone become UTC, relative links absolute."""
    rows = answer.select(F.inline("result.items"))
    url = F.when(F.col("Url").startswith("http"), F.col("Url")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(F.regexp_replace("Url", "^/+", ""))))
    return rows.select(F.col("MediaReleaseId").alias("native_id"), t.squeezed(F.col("Title")).alias("title"), url.alias("url"), F.to_utc_timestamp(times.parse_iso(F.col("DateTime")), zone).alias("published_at"), F.col("AgencyAbbr").alias("agency")).dropDuplicates(["native_id"])


def properties(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.from_json("props", "k bigint")["k"])
