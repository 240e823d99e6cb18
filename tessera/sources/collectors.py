"""Every source of a registry by its method, in one plan: raw answers become items and a status for each source.

``collect(registry, answers)`` joins the answers (see ``sources.answers``, or any
table with its columns) with the registry and gives each to its method. Methods
are expressions over a column of text: feeds are cut at their elements and parsed
with ``from_xml``, JSON with ``from_json``, markup by the linear reader in Arrow
batches. What can't be used is a row with a ``problem``, never left out silently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tessera.functions import text as t
from tessera.functions import times
from tessera.sources import apis, html_pages
from tessera.sources.html_pages import Listing

#: What a registry row may say besides its address; null: the method's default.
RULES = "host string, path string, date string, reach int, inside array<string>, skip array<string>, whole boolean, forms array<string>, zone string, rewrite array<string>, lookback_days int, summary_chars int, exclude array<string>"
_RULES = [r.split()[0] for r in RULES.split(", ")]
#: Of each parsed item.
_ITEM = ["source_id", "place", "native_id", "title", "url", "published_at", "summary", "problem"]

RSS = "title string, link string, guid string, pubDate string, `dc:date` string, updated string, description string"
ATOM = "title string, id string, updated string, published string, summary string, link array<struct<_href: string, _rel: string>>"
SITEMAP = "loc string, lastmod string"

# ---------------------------------------------------------------- bytes to text


@pandas_udf(StringType())
def _repaired(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes in their declared charset; a wrong declaration means UTF-8 where they are that, else windows-1252."""

    def one(data: bytes | None, name: str | None) -> str | None:
        if data is None:
            return None
        for c in (name if name and name not in ("us-ascii", "ascii") else "utf-8", "utf-8"):
            try:
                return data.decode(c)
            except (UnicodeDecodeError, LookupError):
                continue
        return data.decode("windows-1252", "replace")

    return pd.Series([one(b, c) for b, c in zip(body, charset, strict=True)], dtype="object")


def decoded(body: Column, content_type: Column) -> Column:
    """The text of an answer: UTF-8 in the JVM, other charsets (declared in the answer's head, or its content type) in an Arrow UDF."""
    head = F.decode(F.unhex(F.regexp_replace(F.hex(F.substring(body, 1, 300)), "(?:[89A-F].)|([0-7].)", "$1")), "UTF-8")
    name = lambda text, pattern: F.nullif(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)), F.lit(""))
    charset = F.coalesce(name(head, r"(?i)(?:encoding|charset)\s*=\s*[\"']?([A-Za-z0-9._-]+)"), name(content_type, r"(?i)charset\s*=\s*\"?([A-Za-z0-9._-]+)"), F.lit("utf-8"))
    plain = charset.isin("utf-8", "utf8", "us-ascii", "ascii") & F.is_valid_utf8(body.cast("string"))
    text = F.when(plain, body.cast("string")).otherwise(_repaired(F.when(~plain, body), charset))
    return F.ltrim(F.regexp_replace(text, "^﻿", ""))


# ---------------------------------------------------------------- methods


def _elements(rows: DataFrame, tag: str, schema: str) -> DataFrame:
    """``x``: each ``tag`` element of the text, parsed; null where it can't be. Elements that never end aren't there: ``malformed`` tells of them."""
    parts = F.split("text", rf"<{tag}(?=[\s>/])")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    closed = F.filter(parts, lambda p: F.contains(p, F.lit(f"</{tag}")))
    chunks = F.transform(closed, lambda p: F.concat(F.lit(f"<{tag}"), F.substring_index(p, f"</{tag}", 1), F.lit(f"</{tag}>")))
    parsed = F.from_xml("chunk", schema + ", _broken string", {"rowTag": tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return rows.withColumn("chunk", F.explode(chunks)).withColumn("x", parsed)


def malformed(text: Column) -> Column:
    """Why a feed is not whole, or null: its root never ends, elements in it don't, or it declares entities."""
    ends = lambda tag: F.size(F.split(text, rf"<{tag}(?=[\s>/])")) != F.size(F.split(text, f"</{tag}\\s*>"))
    whole = F.rtrim(text).rlike(r"(?i)</(rss|rdf:RDF|feed|urlset|sitemapindex)\s*>\s*$")
    return F.when(text.rlike(r"(?i)<!(DOCTYPE|ENTITY)"), "declares entities").when(~whole, "a feed that is cut off").when(ends("item") | ends("entry") | ends("url"), "elements that never end")


def _feed(rows: DataFrame) -> DataFrame:
    """RSS 2.0, RSS 1.0 and Atom; a date is pubDate, else dc:date, else updated."""
    rows = rows.where(~F.col("text").rlike(r"(?i)<!(DOCTYPE|ENTITY)"))
    x = lambda c: F.col(f"x.{c}")
    items = _elements(rows, "item", RSS)
    at = F.coalesce(times.parse_rfc822(x("pubDate")), times.parse_iso(x("`dc:date`")), times.parse_iso(x("updated")))
    items = items.select("source_id", "place", "base", *_RULES, F.coalesce(x("guid"), x("link")).alias("native_id"), x("title").alias("title"), x("link").alias("url"), at.alias("published_at"), x("description").alias("summary"), _unread("x"))
    entries = _elements(rows, "entry", ATOM)
    link = F.coalesce(F.get(F.filter(x("link"), lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get(x("link"), F.lit(0)))
    entries = entries.select("source_id", "place", "base", *_RULES, x("id").alias("native_id"), x("title").alias("title"), link["_href"].alias("url"), F.coalesce(times.parse_iso(x("published")), times.parse_iso(x("updated"))).alias("published_at"), x("summary").alias("summary"), _unread("x"))
    return items.unionByName(entries)


def _unread(x: str) -> Column:
    return F.when(F.col(x).isNull() | F.col(f"{x}._broken").isNotNull(), "can't be read").alias("problem")


def _publisher_feed(rows: DataFrame) -> DataFrame:
    """A news search that is held to one publisher: its own links come from the summaries."""
    found = _feed(rows)
    own = F.nullif(F.regexp_extract(F.coalesce("summary", F.lit("")), r"(?i)href\s*=\s*[\"'](https://[^\"'\s]+)[\"']", 1), F.lit(""))
    ours = F.coalesce(F.try_parse_url(own, F.lit("HOST")).endswith(F.col("host")), F.lit(False))
    return found.withColumn("url", F.when(ours, own).otherwise(F.col("url")))


def _sitemap(rows: DataFrame) -> DataFrame:
    rows = rows.where(~F.col("text").rlike(r"(?i)<!(DOCTYPE|ENTITY)"))
    x = lambda c: F.col(f"x.{c}")
    named = F.regexp_replace(F.regexp_extract(F.coalesce(x("loc"), F.lit("")), r"([^/]+)/?$", 1), "[-_]+", " ")
    return _elements(rows, "url", SITEMAP).select("source_id", "place", "base", *_RULES, F.trim(x("loc")).alias("native_id"), named.alias("title"), F.trim(x("loc")).alias("url"), times.parse_iso(x("lastmod")).alias("published_at"), F.lit("").alias("summary"), _unread("x"))


def _json(schema: str, at: str) -> Callable[[DataFrame], DataFrame]:
    """Answers parsed by ``schema``; one that isn't JSON, or has not the array ``at``, is one problem."""

    def read(rows: DataFrame) -> DataFrame:
        return rows.withColumn("j", F.from_json("text", schema, {"mode": "PERMISSIVE"})).withColumn("unread", F.col(f"j.{at}").isNull())

    return read


def _rows_or_problem(rows: DataFrame, items: Column, fields: dict[str, Callable[[Column], Column]]) -> DataFrame:
    each = rows.withColumn("x", F.explode(F.when(F.col("unread"), F.array(F.lit(None))).otherwise(items)))
    made = {name: f(F.col("x")) for name, f in fields.items()}
    return each.select("source_id", "place", "base", *_RULES, *[made.get(c, F.lit("")).alias(c) for c in ("native_id", "title", "url", "published_at", "summary")], F.when(F.col("unread"), "can't be read").alias("problem"))


def _notices(rows: DataFrame) -> DataFrame:
    fields = {"native_id": lambda x: x["document_number"], "title": lambda x: x["title"], "url": lambda x: x["html_url"], "published_at": lambda x: times.parse_iso(x["publication_date"]), "summary": lambda x: x["abstract"]}
    return _rows_or_problem(_json(apis.NOTICES, "results")(rows), F.col("j.results"), fields)


def _news(rows: DataFrame) -> DataFrame:
    fields = {"native_id": lambda x: x["uuid"], "title": lambda x: x["title"], "url": lambda x: x["url"], "published_at": lambda x: times.parse_epoch(x["date"]), "summary": lambda x: x["teaser"]}
    return _rows_or_problem(_json(apis.NEWS, "results")(rows), F.col("j.results"), fields)


def _absolute(url: Column, base: Column) -> Column:
    """A link with the host of its page's address, if it has none of its own."""
    root = F.regexp_extract(base, "^(https?://[^/]+)", 1)
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(root, F.lit("/"), F.regexp_replace(url, "^/+", "")))


def _releases(rows: DataFrame) -> DataFrame:
    zone = F.coalesce(F.col("zone"), F.lit("UTC"))
    fields = {"native_id": lambda x: x["MediaReleaseId"], "title": lambda x: x["Title"], "url": lambda x: _absolute(x["Url"], F.col("base")), "published_at": lambda x: F.to_utc_timestamp(times.parse_iso(x["DateTime"]), zone), "summary": lambda x: F.coalesce(x["AgencyAbbr"], F.lit(""))}
    return _rows_or_problem(_json(apis.RELEASES, "result.items")(rows), F.col("j.result.items"), fields)


def _filings(rows: DataFrame) -> DataFrame:
    """Column-parallel arrays; the forms that the registry names, all if none."""
    r = "j.filings.recent."
    columns = ("accessionNumber", "form", "filingDate", "primaryDocument", "primaryDocDescription")
    zipped = F.arrays_zip(*[F.coalesce(F.col(r + c), F.array().cast("array<string>")).alias(c) for c in columns])
    wanted = F.filter(zipped, lambda x: F.coalesce(F.size("forms") <= 0, F.lit(True)) | F.array_contains(F.coalesce("forms", F.array().cast("array<string>")), x["form"]))
    url = lambda x: _absolute(F.concat(F.lit("Archives/edgar/data/"), F.col("j.cik"), F.lit("/"), F.replace(x["accessionNumber"], F.lit("-"), F.lit("")), F.lit("/"), F.coalesce(x["primaryDocument"], F.lit(""))), F.col("base"))
    fields = {"native_id": lambda x: x["accessionNumber"], "title": lambda x: F.concat_ws(" ", F.col("j.name"), x["form"], F.nullif(x["primaryDocDescription"], F.lit(""))), "url": url, "published_at": lambda x: times.parse_iso(x["filingDate"])}
    return _rows_or_problem(_json(apis.FILINGS, "filings.recent.accessionNumber")(rows), wanted, fields)


SHARD = "id string, title string, url string, date string, category string"


def _shards(rows: DataFrame) -> DataFrame:
    """An array of records; categories that the registry excludes go."""
    rows = rows.withColumn("j", F.from_json("text", f"array<struct<{SHARD}>>")).withColumn("unread", F.col("j").isNull())
    kept = F.filter("j", lambda x: ~F.array_contains(F.coalesce("exclude", F.array().cast("array<string>")), F.coalesce(x["category"], F.lit(""))))
    fields = {"native_id": lambda x: x["id"], "title": lambda x: x["title"], "url": lambda x: _absolute(x["url"], F.col("base")), "published_at": lambda x: times.parse_any(x["date"])}
    return _rows_or_problem(rows, kept, fields)


@lru_cache(1024)
def _listing(host: str, path: str, date: str | None, reach: int | None, inside: tuple, skip: tuple | None, whole: bool | None) -> Listing:
    more = {k: v for k, v in (("date", date), ("reach", reach), ("skip", skip), ("whole", whole)) if v is not None}
    return Listing(host, path, inside=inside if len(inside) == 2 else ("", ""), **more)


def _markup(read: Callable[[dict], list[tuple]]) -> Callable[[DataFrame], DataFrame]:
    """A method over pages: (native_id, url, title, date_text, problem) of each release of a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r["source_id"], r["place"], r["base"], *[r[c] for c in _RULES], *x) for r in b.to_dict("records") for x in read(r)]
            yield pd.DataFrame(out, columns=["source_id", "place", "base", *_RULES, "native_id", "url", "title", "date_text", "problem"], dtype="object")

    def method(rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("source_id", "place", "base", *_RULES).schema)
        found = rows.select("source_id", "place", "base", "text", *_RULES).mapInPandas(run, schema + ", native_id string, url string, title string, date_text string, problem string")
        at = times.parse_any(F.col("date_text"))
        wrong = F.when(F.col("date_text").isNotNull() & at.isNull(), "a date that can't be read")
        return found.withColumns({"published_at": at, "summary": F.lit(""), "problem": F.coalesce("problem", wrong)}).drop("date_text")

    return method


def _plain(x) -> bool:
    return x is None or (isinstance(x, float) and x != x)


def _releases_of(r: dict) -> list[tuple]:
    some = lambda x: None if _plain(x) else x
    reach = some(r["reach"])
    rule = _listing(r["host"], r["path"], some(r["date"]), None if reach is None else int(reach), tuple(r["inside"] if r["inside"] is not None else ()), None if r["skip"] is None else tuple(r["skip"]), some(r["whole"]))
    return html_pages.listed(r["text"], r["base"] or "", rule)


def _articles_of(r: dict) -> list[tuple]:
    return [(url, url, title, date, None) for url, title, date in html_pages.ld_articles(r["text"])]


METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rss": _feed, "atom": _feed, "rdf": _feed, "publisher_rss": _publisher_feed, "sitemap": _sitemap,
    "notices_json": _notices, "news_json": _news, "releases_json": _releases, "filings_json": _filings, "shards_json": _shards,
    "listing_html": _markup(_releases_of), "linked_data_html": _markup(_articles_of),
}
FEEDS = ("rss", "atom", "rdf", "publisher_rss", "sitemap")


def broken_rules() -> dict[str, Column]:
    """What each method asks of its registry row, besides what all rows need."""
    lacks = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    method = F.col("method")
    query = F.coalesce(F.try_url_decode(F.try_parse_url("url", F.lit("QUERY"), F.lit("q"))), F.lit(""))
    flat = F.regexp_replace(F.regexp_replace(query, r"\([^()]*\)", " "), r"\([^()]*\)", " ")
    return {
        "no host or path of its releases": method.isin("listing_html") & (lacks("host") | lacks("path")),
        "no host of its publisher": method.isin("publisher_rss") & lacks("host"),
        "a search that isn't held to one publisher": method.isin("publisher_rss") & ((F.regexp_count(query, F.lit(r"(?i)(?:^|[\s(])site:\S+")) != 1) | flat.rlike(r"\bOR\b")),
        "no zone of its times": method.isin("releases_json") & lacks("zone"),
        "an unknown place of its dates": ~F.coalesce(F.col("date").isin("near", "before", "after", "path", "none"), F.lit(True)),
        "a container with no two ends": ~F.coalesce(F.size("inside").isin(-1, 0, 2), F.lit(True)),
        "a rewrite with no two sides": ~F.coalesce(F.size("rewrite").isin(-1, 0, 2), F.lit(True)),
        "days or lengths below one": ~F.coalesce(F.col("lookback_days") > 0, F.lit(True)) | ~F.coalesce(F.col("summary_chars") > 0, F.lit(True)) | ~F.coalesce(F.col("reach") > 0, F.lit(True)),
    }


# ---------------------------------------------------------------- all sources


def read_answers(registry: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers with their source's method and rules, and their text; ``failure`` also tells of feeds that aren't whole."""
    known = registry.where("enabled").select("source_id", "method", *[F.col(r) for r in _RULES])
    rows = answers.select("source_id", "place", F.col("url").alias("base"), "status", "content_type", "body", "failure").join(known, "source_id")
    rows = rows.withColumn("text", F.when(F.col("status") == 200, decoded(F.col("body"), F.col("content_type")))).drop("body")
    return rows.withColumn("failure", F.coalesce("failure", F.when(F.col("method").isin(*FEEDS) & F.col("text").isNotNull(), malformed(F.col("text")))))


def parsed(rows: DataFrame) -> DataFrame:
    """Items of all methods as they stand in the answers."""
    each = [read(rows.where((F.col("method") == name) & F.col("text").isNotNull())) for name, read in METHODS.items() if name not in ("atom", "rdf", "rss")]
    each.append(_feed(rows.where(F.col("method").isin("rss", "atom", "rdf") & F.col("text").isNotNull())))
    return reduce(DataFrame.unionByName, each)


def checked(items: DataFrame, now: Column) -> DataFrame:
    """Titles, links and summaries as items have them; links of other hosts or paths, lacking titles or dates and dates to come are problems; old rows go."""
    link = F.regexp_replace(F.trim("url"), "^(https?://[^/]+)//", "$1/")
    rewritten = F.when(F.size("rewrite") == 2, F.replace(link, F.get("rewrite", F.lit(0)), F.get("rewrite", F.lit(1)))).otherwise(link)
    url = t.canonical_url(rewritten)
    path = F.concat(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), F.try_parse_url(url, F.lit("QUERY"))), F.lit("")))
    official = url.isNotNull() & (F.col("host").isNull() | (F.try_parse_url(url, F.lit("HOST")) == F.col("host"))) & (F.col("path").isNull() | F.rlike(path, F.col("path")))
    title, at = t.squeezed(F.col("title")), F.col("published_at")
    marked = F.coalesce(F.rlike("summary", F.lit("[<&]")), F.lit(False))
    summary = F.when(marked, t.html_text(F.when(marked, F.col("summary")))).otherwise(t.squeezed(F.coalesce("summary", F.lit(""))))
    dated = ~F.coalesce(F.col("date") == "none", F.lit(False))
    problem = F.coalesce("problem", F.when(~F.coalesce(official, F.lit(False)), "not an official link").when(F.coalesce(title, F.lit("")) == "", "no title").when(at.isNull() & dated, "no date").when(times.is_future(at, now), "future date"))
    shown = F.when(F.col("summary_chars").isNotNull(), F.left(summary, F.col("summary_chars"))).otherwise(summary)
    rows = items.select("source_id", "place", F.coalesce("native_id", url, F.col("url")).alias("native_id"), title.alias("title"), url.alias("url"), "published_at", shown.alias("summary"), problem.alias("problem"), "lookback_days")
    old = F.unix_timestamp("published_at") < F.unix_timestamp(now) - F.col("lookback_days") * 86400
    return rows.where(~F.coalesce(old, F.lit(False))).drop("lookback_days")


def merged(rows: DataFrame) -> DataFrame:
    """Each item of a source once, as its first good answer has it, with that answer's place and how many answers have it; good rows that contradict each other are a problem."""
    good = F.col("problem").isNull()
    first = F.min_by(F.struct("title", "url", "published_at", "summary", "problem"), F.struct(~good, "place", "url", "title"))
    grouped = rows.groupBy("source_id", "native_id").agg(first.alias("r"), F.min_by("place", F.struct(~good, "place", "url", "title")).alias("place"), F.count_distinct("place").alias("n_places"), F.min(F.when(good, F.struct("title", "url"))).alias("a"), F.max(F.when(good, F.struct("title", "url"))).alias("z"))
    conflict = F.when(F.col("a") != F.col("z"), "rows that contradict each other")
    return grouped.select("source_id", "native_id", "r.title", "r.url", "r.published_at", "r.summary", "place", "n_places", F.coalesce("r.problem", conflict).alias("problem"))


def statuses(registry: DataFrame, answers: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each enabled source: ``status`` (success, partial, failed, empty, not_modified, unread), its good rows, problems and failures, and the reasons."""
    asked = answers.groupBy("source_id").agg(F.count("*").alias("n_answers"), F.count_if(F.col("status") == 304).alias("n_same"), F.count("failure").alias("n_failures"), F.collect_set("failure").alias("failures"))
    made = items.groupBy("source_id").agg(F.count_if(F.col("problem").isNull()).alias("n_rows"), F.count("problem").alias("n_problems"), F.collect_set("problem").alias("problems"))
    both = registry.where("enabled").select("source_id").join(asked, "source_id", "left").join(made, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    bad = zero("n_problems") + zero("n_failures")
    status = F.when(F.col("n_answers").isNull(), "unread").when(F.col("n_same") == F.col("n_answers"), "not_modified").when((zero("n_rows") > 0) & (bad > 0), "partial").when(bad > 0, "failed").when(zero("n_rows") == 0, "empty").otherwise("success")
    none = F.array().cast("array<string>")
    return both.select("source_id", status.alias("status"), zero("n_answers").alias("n_answers"), zero("n_rows").alias("n_rows"), zero("n_problems").alias("n_problems"), zero("n_failures").alias("n_failures"), F.array_sort(F.array_union(F.coalesce("failures", none), F.coalesce("problems", none))).alias("reasons"))


def collect(registry: DataFrame, answers: DataFrame, now: Column, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Items (``source_id``, ``native_id``, ``title``, ``url``, ``published_at``, ``summary``, ``place``, ``n_places``, ``problem``) and statuses of all enabled sources.

    ``keep`` writes what both read (answers as text, items), ``tables.stored`` for example; else it is computed again for each.
    """
    keep = keep or (lambda df, name: df)
    rows = keep(read_answers(registry, answers), "answers")
    items = keep(merged(checked(parsed(rows), now)), "items")
    return items, statuses(registry, rows, items)
