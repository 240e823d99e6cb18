import json
from datetime import datetime

from pyspark.sql import functions as F

from tessera.sources import apis, feeds, html_pages, registry
from tessera.streaming import jobs

NOW = datetime(2024, 1, 20)


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<?xml version="1.0"?><rss><channel><item><title>One  &amp; two</title><link>https://gov.example/r/1</link><guid>1</guid><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;text&lt;/p&gt;</description></item>
<item><title>Decoy</title><link>https://other.example/r/2</link><guid>2</guid><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Undated</title><link>https://gov.example/r/3</link><guid>3</guid></item></channel></rss>""")
    rows = feeds.rss(spark, str(tmp_path / "a.xml"))
    got = {r.native_id: r for r in feeds.official(rows, "gov.example", "^/r/", F.lit(NOW), 30).collect()}
    assert got["1"].title == "One & two" and got["1"].summary == "text" and got["1"].problem is None
    assert got["2"].problem == "not an official link" and got["3"].problem == "no date"
    assert feeds.status(feeds.official(rows, "gov.example", "^/r/", F.lit(NOW), 30)).collect()[0].status == "partial"
    both = feeds.merged({"x": rows, "y": rows}).collect()
    assert len(both) == 3 and both[0].feeds == ["x", "y"] and not both[0].conflict
    (tmp_path / "b.xml").write_text("""<feed><entry><title>A</title><id>i</id><link rel="self" href="https://s/"/><link href="https://a/"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>""")
    r = feeds.atom(spark, str(tmp_path / "b.xml")).collect()[0]
    assert r.url == "https://a/" and r.published_at == datetime(2024, 1, 2)


def test_json_answers(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"cik": "7", "name": "N", "filings": {"recent": {"accessionNumber": ["a-1", "a-2", "a-1"], "form": ["8-K", "4", "8-K"], "filingDate": ["2024-01-02", "2024-01-03", "2024-01-02"], "primaryDocument": ["x.htm"]}}}))
    rows = apis.filings(apis.answers(spark, str(tmp_path / "f.json"), apis.FILINGS), ("8-K",))
    assert [(r.native_id, r.published_at) for r in rows.collect()] == [("a-1", datetime(2024, 1, 2))]
    assert apis.watermarks(rows).collect()[0].watermark == "2024-01-02:a-1"
    (tmp_path / "n.json").write_text(json.dumps({"results": [{"date": "1704067200", "title": "T", "url": "u", "uuid": "1", "teaser": "<b>x</b>"}, {"date": "bad", "title": "T", "url": "u", "uuid": "2"}]}))
    got = {r.native_id: r.published_at for r in apis.news(apis.answers(spark, str(tmp_path / "n.json"), apis.NEWS)).collect()}
    assert got == {"1": datetime(2024, 1, 1), "2": None}
    (tmp_path / "r.json").write_text(json.dumps({"result": {"items": [{"MediaReleaseId": "m", "Title": "T", "DateTime": "2024-01-01 08:00:00", "Url": "/p/1"}]}}))
    r = apis.releases(apis.answers(spark, str(tmp_path / "r.json"), apis.RELEASES), "https://s.example").collect()[0]
    assert r.url == "https://s.example/p/1" and r.published_at == datetime(2024, 1, 1)


def test_links_and_their_dates(spark):
    page = "<p>January 2, 2024 <a href='/one'>First story</a></p>" + "x" * 300 + "<p><a href='/two'><img alt='Second'></a> 3 March 2024</p><script>'<a href=no>'</script>"
    got = html_pages.links(spark.createDataFrame([(1, page), (2, None)], "page_id bigint, html string"), "page_id", "html").collect()
    assert [(r.href, r.title, r.date_text) for r in got] == [("/one", "First story", "January 2, 2024"), ("/two", "Second", "3 March 2024")]
    assert html_pages.nearest([["a", "", 0, ""], ["b", "", 10, ""]], [(5, "d")]) == {}
    assert html_pages.nearest([["a", "", 0, ""]], [(2501, "d")]) == {}


def test_streams(spark, tmp_path):
    rows = [("k1", datetime(2024, 1, 1)), ("k1", datetime(2024, 1, 1, 5)), ("k2", datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "event_key string, published_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.deduplicated(jobs.read(spark, str(tmp_path / "in"), "event_key string, published_at timestamp"))
    taken = []
    jobs.each_batch(stream, lambda batch, _: taken.extend(r.event_key for r in batch.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(taken) == ["k1", "k2"]


def test_health_in_a_stream(spark, tmp_path):
    schema = "source_id bigint, event_id bigint, at timestamp, status string"
    for k, statuses in enumerate((["failed", "failed"], ["failed", "success", "empty"])):
        rows = [(1, 10 * k + n, datetime(2024, 1, 1 + k, n), s) for n, s in enumerate(statuses)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        last = []
        jobs.each_batch(jobs.health(jobs.read(spark, str(tmp_path / "in"), schema)), lambda batch, _, last=last: last.extend(batch.collect()), str(tmp_path / "cp"), mode="update").awaitTermination(120)
        got = last[-1]
        assert (got.consecutive_failures, got.consecutive_empty) == ((2, 0), (0, 1))[k] and got.n_attempts == (2, 5)[k]


def test_registry(spark, tmp_path):
    good = {"source_id": "a", "name": "A", "method": "rss", "url": "https://a.example/f", "authority_tier": 1, "category": "c", "entity_coverage": [], "enabled": True}
    (tmp_path / "s.json").write_text(json.dumps([good, good | {"source_id": "b", "method": "x", "authority_tier": 9, "enabled": False}, good]))
    rows = registry.read(spark, str(tmp_path / "s.json"))
    assert sorted((r.source_id, r.rule) for r in registry.violations(rows).collect()) == [("a", "source_id is not unique"), ("b", "tier is not 1 to 3"), ("b", "unknown method")]
    assert registry.enabled(rows).count() == 2


def test_sitemaps_and_linked_data(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<urlset><url><loc>https://a/1</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a/2</loc><lastmod>2024-01-03</lastmod></url><url><loc>https://a/3</loc></url></urlset>")
    rows = registry.collect_source(spark, "sitemap", str(tmp_path / "m.xml"))
    assert [r.url for r in feeds.latest(rows, 2).collect()] == ["https://a/2", "https://a/1"]
    assert feeds.listing_digest(rows).collect() == feeds.listing_digest(rows.repartition(3)).collect() != feeds.listing_digest(feeds.latest(rows, 2)).collect()
    page = '<script type="application/ld+json">{"@graph": [{"@type": ["NewsArticle"], "url": "u", "headline": "H  x", "datePublished": "2024-01-01", "isPartOf": {"@type": "Article", "url": "v", "name": "N", "datePublished": "d"}}]}</script><script type="application/ld+json">{bad</script>'
    got = html_pages.linked_data(spark.createDataFrame([(1, page), (2, None)], "page_id bigint, html string"), "page_id", "html").collect()
    assert [tuple(r) for r in got] == [(1, "u", "H x", "2024-01-01"), (1, "v", "N", "d")]


def test_listings_by_rules(spark):
    base = "https://news.example/list"
    pages = {
        "time": "<nav><a href='/x'>home</a></nav><li><time datetime='2024-03-02T08:00:00-05:00'></time> <a href='/press/a-1'>First</a></li><li><time datetime='2024-03-01'></time><a href='/press/a-2'>Second</a></li><a href='https://else.example/press/a-3'>Decoy</a>",
        "path": "<a href='/actions/20240305'>Fifth</a><a href='/actions/other'>None</a><a href='/actions/20240305'>Read more</a>",
        "after": "<a href='/r/1'>One</a> January 5, 2024 <a href='/r/2'>Two</a><a href='/r/3'>Three</a> 7 Sept 2023",
        "before": "02/01/2024 <a href='/p?id=9'>Nine</a> 02/02/2024 <a href='/p?id=10'>Ten</a>",
        "none": "<a href='/u/1'>Undated</a>",
        "inside": "<a href='/r/0'>Outside</a><main><a href='/r/1'>In</a></main><a href='/r/2'>Out</a>",
        "broken": "<a href='/r/1'>One<a href='/r/2'>Two</a>",
    }
    rules = {
        "time": html_pages.Listing("news.example", r"^/press/(a-\d+)$"), "path": html_pages.Listing("news.example", r"^/actions/(\d+)$", date="path"), "after": html_pages.Listing("news.example", r"^/r/", date="after"),
        "before": html_pages.Listing("news.example", r"^/p\?id=(\d+)", date="before", reach=1200), "none": html_pages.Listing("news.example", r"^/u/", date="none"),
        "inside": html_pages.Listing("news.example", r"^/r/", date="none", inside=("<main>", "</main>")), "broken": html_pages.Listing("news.example", r"^/r/", whole=True),
    }
    got = {}
    for k, rule in rules.items():
        found = html_pages.releases(spark.createDataFrame([(1, pages[k], base), (2, None, None)], "page int, html string, base string"), "page", "html", "base", rule)
        got[k] = [(r.native_id, r.title, r.published_at and r.published_at.isoformat(), r.problem) for r in found.orderBy("position").collect()]
    assert got["time"] == [("a-1", "First", "2024-03-02T13:00:00", None), ("a-2", "Second", "2024-03-01T00:00:00", None)]
    assert got["path"] == [("20240305", "Fifth", "2024-03-05T00:00:00", None)]
    assert got["after"] == [("/r/1", "One", "2024-01-05T00:00:00", None), ("/r/2", "Two", None, "no date"), ("/r/3", "Three", "2023-09-07T00:00:00", None)]
    assert got["before"] == [("9", "Nine", "2024-02-01T00:00:00", None), ("10", "Ten", "2024-02-02T00:00:00", None)]
    assert got["none"] == [("/u/1", "Undated", None, None)] and got["inside"] == [("/r/1", "In", None, None)] and got["broken"][0][3] == "links that never end"
    rows = html_pages.releases(spark.createDataFrame([(1, pages["time"], base), (2, pages["before"], base)], "page int, html string, base string"), "page", "html", "base", html_pages.Listing("news.example", r"^/(?:press/|p\?)"))
    since = F.lit("2024-02-15").cast("timestamp")
    assert {r.page: r.is_old for r in html_pages.pages_to_read(rows, "page", since).collect()} == {1: False, 2: True}
    assert html_pages.in_window(rows, since, F.lit("2024-03-01").cast("timestamp")).count() == 1


def test_issues_shards_and_publishers(spark):
    feed = spark.createDataFrame([("https://g.example/2024/2024-05-04/index", "2024-05-04"), ("https://g.example/2024/2024-05-11/index", "2024-06-01")], "url string, day string").withColumn("published_at", F.to_timestamp("day"))
    issues = spark.createDataFrame([(u, "<a href='/n/1'>Notice</a>") for u in ("https://g.example/2024/2024-05-04/index", "https://g.example/2024/2024-05-11/index")], "url string, html string")
    found = html_pages.two_levels(feed, issues, html_pages.Listing("g.example", "^/n/", date="none")).orderBy("issue").collect()
    assert [(r.title, r.problem) for r in found] == [("Notice", None), ("Notice", "the issue's date is not the feed's")]
    shards = html_pages.shards(spark.createDataFrame([(0, '[{"id": "a"}, {"id": "b"}]'), (1, "no")], "page int, text string"), "id: string")
    assert [tuple(r) for r in shards.orderBy("page", "place").collect()] == [(0, 0, "a"), (0, 1, "b")]
    assert html_pages.publisher_only("(a OR b) site:x.example") and not html_pages.publisher_only("a OR b site:x.example") and not html_pages.publisher_only("site:a site:b")
    news = spark.createDataFrame([("https://search.example/1", "<a href=\"https://www.pub.example/a\">t</a>"), ("https://search.example/2", None)], "url string, summary string")
    assert [r.url for r in html_pages.publisher_links(news, "pub.example").collect()] == ["https://www.pub.example/a", "https://search.example/2"]


def test_a_stream_in_batches_keeps_the_last_of_each_key(spark, tmp_path):
    for k, rows in enumerate([[(1, 5, "a"), (2, 1, "b")], [(1, 3, "late"), (2, 4, "c")]]):
        spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.read(spark, f"{tmp_path}/in", "k int, at int, v string", files_per_batch=1)
        found = jobs.latest_by_key(stream, "k", "at", "v", f"{tmp_path}/out", f"{tmp_path}/offsets").collect()
    assert {r.k: r.v for r in found} == {1: "a", 2: "c"}


def test_a_listing_is_known_by_its_files(spark):
    import hashlib

    row = spark.range(1).select(*[feeds.content_digest(x).alias(n) for n, x in (("two", F.array(F.lit("a"), F.lit("b"))), ("gap", F.array(F.lit("a"), F.lit(None).cast("string"))), ("none", F.lit(None).cast("array<string>")))]).first()
    assert row.two == hashlib.sha256(rb"a\nb").hexdigest() and row.gap == hashlib.sha256(rb"a\n").hexdigest() and row.none is None


def test_a_batch_may_read_every_page_of_the_longest_listing(spark, tmp_path, monkeypatch):
    import pytest

    from tessera.plans import queries
    from tessera.sources import listing

    spark.range(350).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-02 00:00:00' AS ts", "20L * (id % 2) AS user_id", "'view' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    asked = {}

    def read(*args, **options):
        asked.update(options)
        raise KeyboardInterrupt

    monkeypatch.setattr(listing, "read", read)
    with pytest.raises(KeyboardInterrupt):
        queries.stream_listing(spark, str(tmp_path))
    assert asked["pages"] == 4
    page = listing.stored_pages({"path": asked["path"]})
    every = [row[0] for k in range(5) for row in page("0", k)]
    assert [len(page("0", k)) for k in (0, 3, 4, 1)] == [100, 50, 0, 100] and sorted(map(int, every)) == list(range(350))
