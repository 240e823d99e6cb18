"""Links and dated links of pages, parsed in Arrow batches."""

from __future__ import annotations

import html as html_entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import markup, times

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
DATE = re.compile(rf"\b(?:(?:{MONTHS})\.? \d{{1,2}}, \d{{4}}|\d{{1,2}} (?:{MONTHS}) \d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}})\b")


class _Links:
    """Links with their text and place, and dates with their place, by character of the page's text."""

    def __init__(self, source: str) -> None:
        self.links: list[list] = []
        self.dates: list[tuple[int, str]] = []
        self.at = 0
        link, skipped = None, 0
        words: list[str] = []

        def end_link() -> None:
            if link is not None:
                link[1] = "".join(words)
            words.clear()

        for kind, what, written in markup.tokens(source):
            if kind == "text":
                if skipped:
                    continue
                data = html_entities.unescape(what)
                self.dates += [(self.at + m.start(), m[0]) for m in DATE.finditer(data)]
                if link is not None:
                    words.append(data)
                self.at += len(data)
            elif kind == "start" and what in ("script", "style"):
                skipped += 1
            elif kind == "end" and what in ("script", "style"):
                skipped = max(0, skipped - 1)
            elif kind == "start" and what == "a":
                a = markup.attributes(written)
                if "href" in a:
                    end_link()
                    link = [a["href"].strip(), "", self.at, a.get("aria-label") or a.get("title") or ""]
                    self.links.append(link)
            elif kind == "start" and what == "img" and link is not None and not link[3]:
                link[3] = markup.attributes(written).get("alt") or ""
            elif kind == "start" and what == "time" and (at := markup.attributes(written).get("datetime")):
                self.dates.append((self.at, at.strip()))
            elif kind == "end" and what == "a":
                end_link()
                link = None
        end_link()


def parsed(html: str | None) -> _Links:
    return _Links(html or "")


def nearest(links: list[list], dates: list[tuple[int, str]], most: int = 2500) -> dict[int, str]:
    """For each date the one nearest link within reach; a date between two equally near links belongs to none. Links keep their nearest date."""
    best: dict[int, tuple[int, str]] = {}
    places = [l[2] for l in links]
    for at, text in dates:
        # links are in the order of their places
        right = bisect_left(places, at)
        near = [(abs(at - places[k]), k) for k in (right - 2, right - 1, right, right + 1) if 0 <= k < len(places)]
        least = min(near, default=(most + 1, -1))
        if least[0] > most or sum(d == least[0] for d, _ in near) > 1:
            continue
        if least[1] not in best or least[0] < best[least[1]][0]:
            best[least[1]] = (least[0], text)
    return {k: text for k, (_, text) in best.items()}


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, ``position``, ``href``, ``title``, ``date_text``: each link, its text (else label, else image text), and the date that belongs to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, source in zip(b[key], b[html], strict=True):
                p = parsed(source)
                dated = nearest(p.links, p.dates)
                out += [(k, n, href, " ".join((text.strip() or label).split()), dated.get(n)) for n, (href, text, _, label) in enumerate(p.links)]
            yield pd.DataFrame(out, columns=[key, "position", "href", "title", "date_text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, position int, href string, title string, date_text string")


LD = re.compile(r"<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>", re.S | re.I)
ARTICLES = frozenset(["Article", "NewsArticle", "PressRelease", "BlogPosting", "Report"])


def ld_articles(source: str | None) -> list[tuple[str, str, str]]:
    """(url, headline, date) of every article in a page's JSON-LD, however deep; scripts that aren't JSON are passed over."""
    found, todo = [], []
    for body in LD.findall(source or ""):
        try:
            todo.append(json.loads(body))
        except ValueError:
            continue
    while todo:
        node = todo.pop(0)
        if isinstance(node, list):
            todo = node + todo
        elif isinstance(node, dict):
            kinds = node.get("@type")
            url, title, date = node.get("url"), node.get("headline") or node.get("name"), node.get("datePublished")
            if ARTICLES & set(kinds if isinstance(kinds, list) else [kinds]) and all(isinstance(x, str) and x.strip() for x in (url, title, date)):
                found.append((url.strip(), " ".join(title.split()), date.strip()))
            todo = [x for x in node.values() if isinstance(x, (dict, list))] + todo
    return list(dict.fromkeys(found))


def linked_data(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, ``url``, ``title``, ``date_text`` of the articles that pages describe as linked data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *a) for k, source in zip(b[key], b[html], strict=True) for a in ld_articles(source)]
            yield pd.DataFrame(out, columns=[key, "url", "title", "date_text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, url string, title string, date_text string")


@dataclass(frozen=True)
class Listing:
    """What tells the releases of a listing page from its other links.

    ``path``: a pattern of the path and query of a release's link; its first group, if it has one, is the release's own id (else the path is).
    ``date``: where its date stands: ``near`` (the one nearest link of a date, within ``reach`` characters), ``before`` or ``after`` the link (in the stretch to the
    last or next release, within ``reach``), ``path`` (year, month and day in the path), or ``none``.
    ``inside``: text of an element that opens the listing, and of one that ends it; only links between them count. ``skip``: titles of links that name nothing.
    ``whole``: a page with more opened than closed links is refused.
    """

    host: str
    path: str
    date: str = "near"
    reach: int = 2500
    inside: tuple[str, str] = ("", "")
    skip: tuple[str, ...] = ("read more", "learn more", "more", "view", "details")
    whole: bool = False


PATH_DATE = re.compile(r"(20\d\d)[/-]?(0[1-9]|1[0-2])[/-]?(0[1-9]|[12]\d|3[01])")


def listed(source: str | None, base: str, rule: Listing) -> list[tuple[str, str, str, str | None, str | None]]:
    """(native_id, url, title, date_text, problem) of every release of a page, in its order; a release that several links lead to is its first with a title."""
    text = source or ""
    opens, ends = rule.inside
    if opens:
        start = text.find(opens)
        text = "" if start < 0 else text[start : len(text) if not ends or (stop := text.find(ends, start)) < 0 else stop]
    if rule.whole and len(re.findall(r"<a\b", text, re.I)) != len(re.findall(r"</a\s*>", text, re.I)):
        return [("", base, "", None, "links that never end")]
    page = parsed(text)
    near = nearest(page.links, page.dates, rule.reach) if rule.date == "near" else {}
    own = []
    for n, (href, words, at, label) in enumerate(page.links):
        url = urlsplit(urljoin(base, href))
        target = url.path + (f"?{url.query}" if url.query else "")
        m = re.search(rule.path, target)
        title = " ".join((words.strip() or label).split())
        if url.scheme == "https" and url.hostname == rule.host and m and title.casefold() not in ("", *rule.skip):
            own.append((n, at, len(words), (m[1] if m.re.groups else url.path), url.geturl(), title))
    found: dict[str, tuple] = {}
    for k, (n, at, size, native, url, title) in enumerate(own):
        before = own[k - 1][1] + own[k - 1][2] if k else 0
        after = own[k + 1][1] if k + 1 < len(own) else page.at
        if rule.date == "near":
            date = near.get(n)
        elif rule.date == "path":
            m = PATH_DATE.search(url)
            date = "-".join(m.groups()) if m else None
        elif rule.date == "before":
            date = next((d for p, d in reversed(page.dates) if max(before, at - rule.reach) <= p <= at), None)
        elif rule.date == "after":
            date = next((d for p, d in page.dates if at <= p <= min(after, at + size + rule.reach)), None)
        else:
            date = None
        problem = "no date" if rule.date != "none" and date is None else None
        if native not in found:
            found[native] = (native, url, title, date, problem)
        elif found[native][2] != title and not problem and found[native][4] is None and found[native][3] != date:
            found[native] = (*found[native][:4], "one id with two dates")
    return list(found.values())


def releases(pages: DataFrame, key: str, html: str, base: str, rule: Listing) -> DataFrame:
    """``key``, ``position``, ``native_id``, ``url``, ``title``, ``published_at``, ``problem`` of the releases that listing pages name; ``base`` is the column of the page's own address."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, n, *r) for k, source, at in zip(b[key], b[html], b[base], strict=True) for n, r in enumerate(listed(source, at or "", rule))]
            yield pd.DataFrame(out, columns=[key, "position", "native_id", "url", "title", "date_text", "problem"])

    rows = pages.select(*dict.fromkeys([key, html, base])).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, position int, native_id string, url string, title string, date_text string, problem string")
    at = times.parse_any(F.col("date_text"))
    wrong = F.when(F.col("date_text").isNotNull() & at.isNull(), "a date that can't be read")
    return rows.select(key, "position", "native_id", "url", "title", at.alias("published_at"), F.coalesce("problem", wrong).alias("problem"))


def in_window(rows: DataFrame, since: F.Column, until: F.Column) -> DataFrame:
    """Releases of a window of days, both ends taken; rows without a date stay, for who reads their problem."""
    at = F.col("published_at")
    return rows.where(at.isNull() | ((at >= since) & (at <= until)))


def pages_to_read(rows: DataFrame, key: str, since: F.Column) -> DataFrame:
    """``key``, ``is_old``: pages none of whose dated releases is of ``since`` or later; a scan may stop at the first such page."""
    return rows.groupBy(key).agg((F.max("published_at") < since).alias("is_old"))


def shards(pages: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON shards that hold a listing's pages: ``text`` with an array of records of ``schema``."""
    return pages.select("page", F.posexplode(F.from_json("text", f"array<struct<{schema}>>")).alias("place", "r")).select("page", "place", "r.*")


def two_levels(feed: DataFrame, issues: DataFrame, rule: Listing, days: int = 1) -> DataFrame:
    """Releases of the issue pages that a feed names: ``feed`` has url and published_at, ``issues`` url and html. An issue whose address has another date than its feed entry, beyond ``days``, is a problem."""
    found = releases(issues.withColumnRenamed("url", "issue"), "issue", "html", "issue", rule)
    y, m, d = (F.regexp_extract("issue", PATH_DATE.pattern, k) for k in (1, 2, 3))
    route = F.concat_ws("-", y, m, d).try_cast("date")
    met = found.drop("published_at").join(feed.select(F.col("url").alias("issue"), "published_at"), "issue")
    apart = F.abs(F.datediff(route, F.to_date("published_at"))) > days
    return met.withColumn("problem", F.coalesce(F.when(F.coalesce(apart, F.lit(True)), "the issue's date is not the feed's"), F.when(F.col("problem") != "no date", F.col("problem"))))


def publisher_only(query: str) -> bool:
    """Whether a news search is held to one publisher: one ``site:`` and no OR outside brackets."""
    flat = query
    while (inner := re.sub(r"\([^()]*\)", " ", flat)) != flat:
        flat = inner
    return len(re.findall(r"(?i)(?:^|[\s(])site:\S+", query)) == 1 and not re.search(r"\bOR\b", flat)


def publisher_links(feed: DataFrame, host: str) -> DataFrame:
    """Rows of such a feed with the publisher's own link of their summary (as HTML), where it has one, as ``url``."""
    pattern = rf"(?i)href\s*=\s*[\"'](https://(?:[a-z0-9-]+\.)*{re.escape(host)}/[^\"'\s]*)[\"']"
    own = F.nullif(F.regexp_extract(F.coalesce("summary", F.lit("")), pattern, 1), F.lit(""))
    return feed.withColumn("url", F.coalesce(own, F.col("url")))
