"""RSS 2.0, RSS 1.0/RDF and Atom feeds as items, by Spark's XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions import times

RSS = "title string, link string, guid string, pubDate string, `dc:date` string, description string"
ATOM = "title string, id string, updated string, published string, summary string, link array<struct<_href: string, _rel: string>>"
COLUMNS = ("native_id", "title", "url", "published_at", "summary")


def rss(spark: SparkSession, path: str) -> DataFrame:
    """``item`` elements of all files at ``path``; a date is pubDate, else dc:date."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path)
    at = F.coalesce(times.parse_rfc822(F.col("pubDate")), times.parse_iso(F.col("`dc:date`")))
    return raw.select(F.coalesce("guid", "link").alias("native_id"), t.squeezed(F.col("title")).alias("title"), F.trim("link").alias("url"), at.alias("published_at"), t.without_tags(F.col("description")).alias("summary"))


def atom(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    link = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get("link", F.lit(0)))
    at = F.coalesce(times.parse_iso(F.col("published")), times.parse_iso(F.col("updated")))
    return raw.select(F.col("id").alias("native_id"), t.squeezed(F.col("title")).alias("title"), link["_href"].alias("url"), at.alias("published_at"), t.without_tags(F.col("summary")).alias("summary"))


def official(rows: DataFrame, host: str, path: str, now: F.Column, lookback_days: int) -> DataFrame:
    """Each row with ``problem``: null for rows to take. Off-host links, and rows without title or date, are problems; old rows are dropped."""
    url = t.canonical_url(F.col("url"))
    good = (F.try_parse_url(url, F.lit("HOST")) == host) & F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/")).rlike(path)
    problem = F.when(~F.coalesce(good, F.lit(False)), "not an official link").when(F.coalesce("title", F.lit("")) == "", "no title").when(F.col("published_at").isNull(), "no date").when(times.is_future(F.col("published_at"), now), "future date")
    return rows.withColumn("problem", problem).where(F.col("published_at").isNull() | ~times.is_stale(F.col("published_at"), now, lookback_days))


def merged(feeds: dict[str, DataFrame]) -> DataFrame:
    """Rows of several feeds, once by native id, with the feeds they stood in, newest first; rows that contradict each other are a problem."""
    each = [f.withColumn("feed", F.lit(name)) for name, f in feeds.items()]
    rows = each[0]
    for other in each[1:]:
        rows = rows.unionByName(other)
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in ("native_id", "feed")]), F.struct("feed", "url")).alias("r")
    grouped = rows.groupBy("native_id").agg(first, F.array_sort(F.collect_set("feed")).alias("feeds"), F.count_distinct("title", "url").alias("n"))
    return grouped.select("native_id", "r.*", "feeds", (F.col("n") > 1).alias("conflict")).orderBy(F.desc_nulls_last("published_at"), F.desc("native_id"))


def status(rows: DataFrame) -> DataFrame:
    """partial, failed, empty or success: by whether there are rows and problems."""
    n, bad = F.count_if(F.col("problem").isNull()), F.count("problem")
    return rows.agg(F.when((n > 0) & (bad > 0), "partial").when(bad > 0, "failed").when(n == 0, "empty").otherwise("success").alias("status"), n.alias("n_rows"), bad.alias("n_problems"))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``url`` elements: url, published_at (lastmod)."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return raw.select(F.trim("loc").alias("url"), times.parse_iso(F.col("lastmod")).alias("published_at")).where("url IS NOT NULL")


def listing_digest(rows: DataFrame) -> DataFrame:
    """One checksum of a listing, in any order: equal to the last run's, nothing has changed."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("url", "published_at").cast("decimal(38,0)")).alias("digest"))


def content_digest(parts: F.Column) -> F.Column:
    """SHA-256 of a listing's files in their order: equal to the last run's, nothing has changed. Null files count as empty; null for no listing.

    Fixed value: the files are joined by a backslash and an n, two characters.
    """
    return F.sha2(F.array_join(F.transform(parts, lambda x: F.coalesce(x, F.lit(""))), "\\n"), 256)


def latest(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("published_at"), F.desc("url")).limit(n)
