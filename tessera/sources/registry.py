"""The registry of sources: read with a schema, checked as a table, read by method."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.sources import collectors, feeds

SCHEMA = "source_id string, name string, method string, url string, authority_tier int, category string, entity_coverage array<string>, enabled boolean, " + collectors.RULES
#: How a method reads files that need no registry's rules; all methods read answers, see ``collectors``.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"rss": feeds.rss, "atom": feeds.atom, "sitemap": feeds.sitemap}


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def violations(sources: DataFrame) -> DataFrame:
    """One row for each rule that a source breaks, those of its method among them; must be empty before a run."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "no source_id": blank("source_id"),
        "no name": blank("name"),
        "unknown method": ~F.coalesce(F.col("method").isin(*collectors.METHODS), F.lit(False)),
        "url is not https": t.canonical_url(F.col("url")).isNull(),
        "tier is not 1 to 3": ~F.coalesce(F.col("authority_tier").between(1, 3), F.lit(False)),
        "enabled is not given": F.col("enabled").isNull(),
    } | collectors.broken_rules()
    broken = sources.select("source_id", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("rule"))
    twice = sources.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").select("source_id", F.lit("source_id is not unique").alias("rule"))
    return broken.unionByName(twice)


def enabled(sources: DataFrame) -> DataFrame:
    return sources.where("enabled")


def collect_source(spark: SparkSession, method: str, path: str) -> DataFrame:
    """The rows of one source's files by its method."""
    if method not in READERS:
        raise ValueError(f"unknown method: {method}")
    return READERS[method](spark, path)
