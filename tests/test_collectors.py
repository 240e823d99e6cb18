"""Sources by method, raw answers, listings as streams: broken, foreign and repeated rows beside good ones."""

import re
import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.plans import queries
from tessera.functions import markup
from tessera.sources import answers, collectors, html_pages, listing, registry
from tessera.streaming import jobs



def now():
    return F.lit("2024-06-01").cast("timestamp")


def registered(spark, *rows):
    columns = [f.split()[0] for f in registry.SCHEMA.split(", ")]
    given = [{"source_id": k, "name": k, "method": m, "url": f"https://{k}.example/", "authority_tier": 1, "enabled": True} | more for k, m, more in rows]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in given], registry.SCHEMA)


def answered(spark, *rows):
    """(source, place, body or None, content type)"""
    made = [(k, place, f"https://{k}.example/list", 200, kind, body if isinstance(body, bytes) else body.encode(), None) for k, place, body, kind in rows]
    return spark.createDataFrame(made, "source_id string, place int, url string, status int, content_type string, body binary, failure string")


def test_feeds_of_all_kinds_and_charsets(spark):
    item = lambda t, k, more="": f"<item><title>{t}</title><link>https://news.example/{k}</link><guid>{k}</guid><pubDate>Fri, 03 May 2024 10:00:00 GMT</pubDate>{more}</item>"
    sources = registered(
        spark, ("cp1252", "rss", {}), ("lied", "rss", {}), ("cut", "rss", {}), ("entity", "rss", {}), ("two", "rss", {}), ("atom", "atom", {"host": "a.example"}), ("far", "rss", {"host": "news.example", "path": "^/ok", "lookback_days": 90}),
        ("moved", "rss", {"rewrite": ["/content/", "/"], "host": "news.example"}), ("map", "sitemap", {}),
    )
    rows = answered(
        spark,
        ("cp1252", 0, ('<?xml version="1.0" encoding="windows-1252"?><rss>' + item("“Zürich” – café", "z") + "</rss>").encode("windows-1252"), None),
        ("lied", 0, '<?xml version="1.0" encoding="us-ascii"?><rss>' + item("Füß", "f") + "</rss>", "text/xml; charset=us-ascii"),
        ("cut", 0, "<rss><channel>" + item("Good", "g") + "<item><title>Never", None),
        ("entity", 0, "<!DOCTYPE x [<!ENTITY y 'z'>]><rss>" + item("No", "n") + "</rss>", None),
        ("two", 0, "<rss>" + item("One", "1", "<description>&lt;b&gt;a &amp;amp; b&lt;/b&gt;</description>") + item("Same", "s") + "</rss>", None),
        ("two", 1, "<rss>" + item("One", "1") + item("Other", "s") + "<item><title>Broken</b></item></rss>", None),
        ("atom", 0, '<feed><entry><id>i</id><title> A  b </title><link rel="self" href="https://x.example/"/><link href="https://A.example/p#f"/><updated>2024-05-01T00:00:00Z</updated></entry></feed>', None),
        ("far", 0, "<rss>" + item("Path", "no") + item("Fine", "ok1") + item("", "ok2") + item("Old", "ok3").replace("2024", "2023") + item("Later", "ok4").replace("May", "Jul") + item("When", "ok5").replace("Fri, 03 May 2024 10:00:00 GMT", "soon") + "</rss>", None),
        ("moved", 0, "<rss>" + item("M", "/content/m").replace("example//content", "example//content") + "</rss>", None),
        ("map", 0, "<urlset><url><loc>https://map.example/some-news_item/</loc><lastmod>2024-05-02</lastmod></url></urlset>", None),
    )
    items, statuses = collectors.collect(sources, rows, now())
    got = {}
    for r in items.collect():
        got.setdefault(r.source_id, {})[r.native_id] = r
    assert got["cp1252"]["z"].title == "“Zürich” – café" and got["lied"]["f"].title == "Füß"
    assert set(got["cut"]) == {"g"} and "entity" not in got
    assert got["two"]["1"].summary == "a & b" and got["two"]["1"].n_places == 2 and got["two"]["s"].problem == "rows that contradict each other"
    assert (got["atom"]["i"].title, got["atom"]["i"].url, got["atom"]["i"].published_at) == ("A b", "https://a.example/p", datetime(2024, 5, 1))
    assert {r.title: r.problem for r in got["far"].values()} == {"Path": "not an official link", "Fine": None, "": "no title", "Later": "future date", "When": "no date"}
    assert got["moved"]["/content/m"].url == "https://news.example/m" and got["map"]["https://map.example/some-news_item/"].title == "some news item"
    status = {r.source_id: (r.status, r.reasons) for r in statuses.collect()}
    assert status["cp1252"] == ("success", []) and status["cut"] == ("partial", ["a feed that is cut off"]) and status["entity"] == ("failed", ["declares entities"])
    assert status["two"][0] == "partial" and "can't be read" in status["two"][1] and status["far"][0] == "partial"


def test_json_markup_and_sources_without_rows(spark):
    sources = registered(
        spark, ("filings", "filings_json", {"forms": ["8-K"]}), ("odd", "notices_json", {}), ("news", "news_json", {}), ("empty", "news_json", {}), ("local", "releases_json", {"zone": "Asia/Singapore"}), ("shards", "shards_json", {"exclude": ["X"]}),
        ("page", "listing_html", {"host": "page.example", "path": r"^/r/(\d+)$"}), ("ld", "linked_data_html", {}), ("quiet", "rss", {}), ("off", "rss", {"enabled": False}),
    )
    ld = {"@graph": [{"@type": "NewsArticle", "url": "https://ld.example/a", "headline": "Head", "datePublished": "2024-05-05"}]}
    rows = answered(
        spark,
        ("filings", 0, json.dumps({"cik": "9", "name": "Co", "filings": {"recent": {"accessionNumber": ["1-1", "1-2", "1-1"], "form": ["8-K", "10-K", "8-K"], "filingDate": ["2024-05-01", "2024-05-02", "2024-05-01"], "primaryDocument": ["a.htm", "b.htm", "a.htm"]}}}), None),
        ("odd", 0, "<html>", None), ("odd", 1, json.dumps({"results": [{"document_number": "d", "title": "T", "html_url": "https://odd.example/d", "publication_date": "2024-05-01", "abstract": None}]}), None),
        ("news", 0, json.dumps({"results": [{"uuid": "u", "title": "T", "url": "https://news.example/u", "date": "1714521600", "teaser": "<p>x</p>"}]}), None), ("empty", 0, '{"results": []}', None),
        ("local", 0, json.dumps({"result": {"items": [{"MediaReleaseId": "m", "Title": "T", "DateTime": "2024-05-01T08:00:00", "Url": "/m"}]}}), None),
        ("shards", 0, json.dumps([{"id": "a", "title": "A", "url": "/a", "date": "May 1, 2024", "category": "Y"}, {"id": "b", "title": "B", "url": "/b", "date": "May 1, 2024", "category": "X"}]), None),
        ("page", 0, "<ul><li><time datetime='2024-05-04'></time><a href=/r/1>First</a></li><li><a href='https://else.example/r/2'>Decoy</a></li><li><a href=/r/3>Third</a> <span>31 February 2024</span>", None),
        ("ld", 0, f"<script type='application/ld+json'>{json.dumps(ld)}</script>", None), ("off", 0, "<rss></rss>", None), ("unknown", 0, "<rss></rss>", None),
    )
    items, statuses = collectors.collect(sources, rows, now())
    got = {(r.source_id, r.native_id): r for r in items.collect()}
    assert got["filings", "1-1"].url == "https://filings.example/Archives/edgar/data/9/11/a.htm" and ("filings", "1-2") not in got
    assert got["local", "m"].published_at == datetime(2024, 5, 1) and got["local", "m"].url == "https://local.example/m" and got["news", "u"].summary == "x"
    assert ("shards", "b") not in got and got["ld", "https://ld.example/a"].title == "Head"
    assert got["page", "1"].published_at == datetime(2024, 5, 4) and got["page", "3"].problem == "a date that can't be read"
    status = {r.source_id: (r.status, r.n_rows) for r in statuses.collect()}
    assert status == {"filings": ("success", 1), "odd": ("partial", 1), "news": ("success", 1), "empty": ("empty", 0), "local": ("success", 1), "shards": ("success", 1), "page": ("partial", 1), "ld": ("success", 1), "quiet": ("unread", 0)}


def test_no_answers_and_no_sources(spark):
    none = spark.createDataFrame([], "source_id string, place int, url string, status int, content_type string, body binary, failure string")
    items, statuses = collectors.collect(registered(spark, ("a", "rss", {})), none, now())
    assert items.count() == 0 and [r.status for r in statuses.collect()] == ["unread"]


def test_rules_of_methods(spark):
    rows = registered(
        spark, ("a", "listing_html", {}), ("b", "publisher_rss", {"host": "p.example", "url": "https://n.example/?q=site%3Ap.example+OR+x"}), ("c", "publisher_rss", {"host": "p.example", "url": "https://n.example/?q=site%3Ap.example+(x+OR+y)"}),
        ("d", "releases_json", {}), ("e", "rss", {"date": "somewhere", "inside": ["<main>"], "lookback_days": 0}), ("f", "carrier pigeon", {}), ("g", "rss", {}),
    )
    assert sorted((r.source_id, r.rule) for r in registry.violations(rows).collect()) == [
        ("a", "no host or path of its releases"), ("b", "a search that isn't held to one publisher"), ("d", "no zone of its times"),
        ("e", "a container with no two ends"), ("e", "an unknown place of its dates"), ("e", "days or lengths below one"), ("f", "unknown method"),
    ]


# ---------------------------------------------------------------- markup


@pytest.mark.parametrize("part", ["<", "<a ", "<a href='", "<a href=\"x' ", "<!--", "</", "<script>", "<title>", "<b>x", "<a href=x>y", "<time datetime=2024-01-01>", "&amp", "<a b=", "2024-01-01 "])
def test_broken_markup_costs_no_more_than_its_length(part):
    page = part * (1_000_000 // len(part))
    began = time.time()
    html_pages.parsed(page)
    collectors.t.plain_text(page)
    assert time.time() - began < 30  # some 3 s on a free machine


def test_tokens_of_markup():
    found = list(markup.tokens("a<b><!-- <i> --><A HREF='x>y' q=\"1\" z>t&amp;</a ><script>if (a<b) '</p>'</script>1 < 2<br/><a 'unclosed>u</a>"))
    assert found == [
        ("text", "a", ""), ("start", "b", ""), ("start", "a", " HREF='x>y' q=\"1\" z"), ("text", "t&amp;", ""), ("end", "a", ""), ("start", "script", ""), ("text", "if (a<b) '</p>'", ""), ("end", "script", ""),
        ("text", "1 < 2", ""), ("start", "br", "/"), ("start", "a", " 'unclosed"), ("text", "u", ""), ("end", "a", ""),
    ]
    assert markup.attributes(" HREF='x&gt;y' q = \"1\" z Q=2 w=a/b") == {"href": "x>y", "q": "1", "z": "", "w": "a/b"}


# ---------------------------------------------------------------- raw answers


class Recorded:
    """Answers of a made-up net, and what was asked of it."""

    def __init__(self, net):
        self.net, self.asked = net, []

    def __call__(self, url, headers):
        self.asked.append((url, headers))
        found = self.net[url]
        found = found.pop(0) if isinstance(found, list) else found
        if isinstance(found, Exception):
            raise found
        return found


def test_bounded_requests():
    A = answers.Answer
    net = {
        "https://a.example/ok": A(200, {"Content-Type": "text/xml; charset=utf-8", "ETag": "e"}, b"x"),
        "https://a.example/again": [A(503), OSError("reset"), A(200, {"Content-Type": "text/xml"}, b"y")],
        "https://a.example/busy": [A(429, {"Retry-After": "60"}), A(429), A(429)],
        "https://a.example/moved": A(301, {"Location": "/ok"}), "https://a.example/away": A(302, {"Location": "https://b.example/"}),
        "https://a.example/loop": A(302, {"Location": "/loop"}), "https://a.example/same": A(304), "https://a.example/gone": A(404),
        "https://a.example/image": A(200, {"Content-Type": "image/png"}, b"p"), "https://a.example/br": A(200, {"Content-Type": "text/xml", "Content-Encoding": "br"}, b"p"),
        "https://a.example/large": A(200, {"Content-Type": "text/xml"}, b"x" * (answers.BODY + 1)),
    }
    waits = []

    def ask(name, budget=9, kinds=("text/xml",)):
        answer, attempts, failure = answers.fetched(Recorded(net), f"https://a.example/{name}", {}, kinds, answers.Budget(budget), waits.append)
        return answer and answer.body, attempts, failure

    assert ask("ok") == (b"x", 1, None) and ask("again") == (b"y", 3, None) and waits == [0.25, 0.5]
    assert ask("busy") == (b"", 3, "status 429") and waits[2:] == [5.0, 0.5]
    assert ask("moved") == (b"x", 2, None) and ask("away")[2] == "a redirect that leads elsewhere" and ask("loop")[2] == "too many redirects"
    assert ask("same") == (b"", 1, None) and ask("gone")[2] == "status 404" and ask("image")[2] == "content of the kind image/png" and ask("br")[2] and ask("large")[2]
    assert ask("ok", budget=0)[2] == "no attempts are left"
    assert answers.fetched(Recorded(net), "http://a.example/ok", {}, (), answers.Budget(9))[2] == answers.fetched(Recorded(net), "https://u:p@a.example/ok", {}, (), answers.Budget(9))[2] == "not an https address"


def net(url, headers):
    """What the executors ask in the test below."""
    if headers.get("If-None-Match") == "e1":
        return answers.Answer(304)
    if "down" in url:
        return answers.Answer(404)
    return answers.Answer(200, {"Content-Type": "text/xml", "ETag": "e1"}, f"<rss><item><title>T</title><link>{url}/1</link><pubDate>Fri, 03 May 2024 10:00:00 GMT</pubDate></item></rss>".encode())


def test_answers_are_a_data_source_that_asks_only_for_what_is_read(spark):
    requests = [{"source_id": k, "place": p, "url": f"https://{k}.example/{p}", "etag": e} for k, p, e in (("a", 0, None), ("a", 1, None), ("b", 0, "e1"), ("down", 0, None))]
    found = answers.read(spark, requests, "tests.test_collectors:net")
    assert {(r.source_id, r.place): (r.status, r.etag, r.failure) for r in found.collect()} == {("a", 0): (200, "e1", None), ("a", 1): (200, "e1", None), ("b", 0): (304, None, None), ("down", 0): (404, None, "status 404")}
    one = answers.read(spark, requests + [{"source_id": "raises", "url": "x"}], "tests.test_collectors:net").where("source_id = 'b' AND status = 304")
    assert one.count() == 1
    items, statuses = collectors.collect(registered(spark, *[(k, "rss", {}) for k in ("a", "b", "down")]), found, now())
    assert {r.source_id: (r.status, r.n_rows) for r in statuses.collect()} == {"a": ("success", 2), "b": ("not_modified", 0), "down": ("failed", 0)}


# ---------------------------------------------------------------- listings as a stream


def pages_of(options):
    """A pager over lists of ids in a file, three a page."""
    def page(source, k):
        with open(options["file"]) as f:
            ids = json.load(f)[source][3 * k : 3 * k + 3]
        return [(i, f"title {i}", f"https://{source}.example/{i}", datetime(2024, 1, 1)) for i in ids]

    return page


def test_a_listing_stream_gives_each_row_once_and_fails_closed(spark, tmp_path):
    file = tmp_path / "ids.json"

    def run(**ids):
        file.write_text(json.dumps(ids))
        stream = listing.read(spark, list(ids), "tests.test_collectors:pages_of", pages=20, file=str(file))
        return sorted((r.source, r.native_id) for r in jobs.appended(stream, f"{tmp_path}/out", f"{tmp_path}/offsets").collect())

    names = lambda a, b: [f"n{k}" for k in range(b, a - 1, -1)]
    first = run(x=names(0, 9), y=[])
    assert first == [("x", "n7"), ("x", "n8"), ("x", "n9")]
    assert run(x=names(0, 9), y=[]) == first
    assert run(x=names(0, 21), y=["u", "t"]) == sorted(first + [("x", f"n{k}") for k in range(10, 22)] + [("y", "t"), ("y", "u")])
    before = run(x=names(0, 22), y=["u", "t"])
    with pytest.raises(Exception, match="boundary"):
        run(x=names(30, 40), y=["u", "t"])  # n22 is gone
    with pytest.raises(Exception, match="boundary"):
        run(x=names(0, 22), y=[])  # the batch that was planned is asked for again
    # what failed wrote nothing, and goes on when the listing is whole again: first with the batch that was planned
    assert run(x=names(0, 42), y=["u", "t"])[-2:] == [("y", "t"), ("y", "u")]
    assert run(x=names(0, 42), y=["u", "t"]) == sorted(before + [("x", f"n{k}") for k in range(23, 43)])


def test_a_frontier_without_its_listing_is_an_error():
    reader = listing.ListingSource({"sources": '["y"]', "pager": "x:y"}).streamReader(None)
    at = lambda ids: {"frontiers": json.dumps({"y": ids})}
    for end in (at(None), {"frontiers": "{}"}):
        with pytest.raises(listing.ListingError, match="gone"):
            reader.partitions(at(["u", "t"]), end)
    assert reader.partitions(at(None), at(None)) == reader.partitions(at(["u", "t"]), at(["u", "s"])) == [] and len(reader.partitions(at(None), at(["u", "t"]))) == 1


def test_rows_that_come_while_pages_are_read():
    pages = {0: ["c", "b"], 1: ["b", "a"], 2: ["o", "p"]}  # c came after the batch began, b moved to the next page
    page = lambda source, k: [(i, None, None, None) for i in pages.get(k, [])]
    assert [r[2] for r in listing.stretch(page, "s", "o", "b", "b", 9)] == ["b", "a"]
    assert [r[2] for r in listing.stretch(page, "s", None, "b", "a", 9)] == ["b", "a"]
    for last, newest in (("z", "b"), ("o", "z"), ("b", "o")):
        with pytest.raises(listing.ListingError):
            list(listing.stretch(page, "s", last, newest, newest, 9))
    with pytest.raises(listing.ListingError, match="2 pages"):
        list(listing.stretch(page, "s", "o", "b", "b", 2))


def test_an_event_is_only_in_the_list_of_its_sources_format(spark):
    plan = queries._answers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lists = re.findall(r"collect_list\((.{9})", plan)
    assert len(lists) >= 6 and set(lists) == {"CASE WHEN"}
