"""A data source of raw answers: the requests of a registry, fetched by a callable, a partition for each source.

    spark.read.format("answers").option("requests", ...).option("fetcher", "package.module:function").load()

``fetcher`` names a callable ``(url, headers) -> Answer`` that every executor can
import; tests and archives read recorded answers with it. What is around it is
here: https alone, redirects within a host, bounded attempts with waits, a budget
of attempts a source, expected kinds of content, a bound on the body. A filter on
``source_id`` is pushed into the source: the others are never asked.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib import import_module
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

ANSWERS = "source_id string, place int, url string, status int, content_type string, etag string, last_modified string, body binary, attempts int, failure string"
#: Fixed values of the interface's limits: attempts, redirects, longest waits in seconds, bytes.
ATTEMPTS, REDIRECTS, WAIT, RETRY_AFTER, BODY = 3, 3, 2.0, 5.0, 2_000_000
AGAIN = frozenset([429, 500, 502, 503, 504])


@dataclass(frozen=True)
class Answer:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


def named(path: str) -> Callable:
    """The object that ``module:name`` names."""
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)


class Budget:
    """Attempts that the requests of one source share."""

    def __init__(self, most: int) -> None:
        self.left = most

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def fetched(fetch: Callable[[str, dict], Answer], url: str, headers: dict[str, str], kinds: tuple[str, ...], budget: Budget, sleep: Callable[[float], None] = time.sleep) -> tuple[Answer | None, int, str | None]:
    """The answer, the attempts that it took, and why there is none or it is of no use."""
    attempts, redirects, now = 0, 0, url
    while True:
        parts = urlsplit(now)
        if parts.scheme != "https" or not parts.hostname or parts.username or parts.password:
            return None, attempts, "not an https address"
        if attempts - redirects >= ATTEMPTS or not budget.spend():
            return None, attempts, "no attempts are left"
        attempts += 1
        try:
            answer = fetch(now, headers)
        except OSError as e:
            sleep(min(WAIT, 0.25 * 2 ** (attempts - 1)))
            if attempts - redirects >= ATTEMPTS:
                return None, attempts, f"no answer: {type(e).__name__}"
            continue
        own = {k.lower(): v for k, v in answer.headers.items()}
        if answer.status in (301, 302, 303, 307, 308):
            target = urljoin(now, own.get("location", ""))
            redirects += 1
            if redirects > REDIRECTS or urlsplit(target).hostname != parts.hostname:
                return None, attempts, "a redirect that leads elsewhere" if redirects <= REDIRECTS else "too many redirects"
            now = target
            continue
        if answer.status in AGAIN:
            if attempts - redirects >= ATTEMPTS:
                return Answer(answer.status, own), attempts, f"status {answer.status}"
            asked = own.get("retry-after", "")
            sleep(min(RETRY_AFTER, float(asked)) if answer.status == 429 and asked.isdigit() else min(WAIT, 0.25 * 2 ** (attempts - 1)))
            continue
        kind = own.get("content-type", "").partition(";")[0].strip().lower()
        failure = None
        if answer.status == 304:
            pass
        elif answer.status != 200:
            failure = f"status {answer.status}"
        elif own.get("content-encoding", "").lower() == "br":
            failure = "an encoding that wasn't asked for"
        elif kinds and kind not in kinds:
            failure = f"content of the kind {kind or 'unknown'}"
        elif len(answer.body) > BODY:
            failure = f"more than {BODY} bytes"
        return Answer(answer.status, own, b"" if failure else answer.body), attempts, failure


class _Requests(InputPartition):
    def __init__(self, requests: list[dict]) -> None:
        super().__init__(requests[0]["source_id"])
        self.requests = requests


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.requests = json.loads(options["requests"])
        self.fetcher, self.budget = options["fetcher"], int(options.get("budget", "9"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source_id",):
                self.requests = [r for r in self.requests if r["source_id"] == f.value]
            elif isinstance(f, In) and f.attribute == ("source_id",):
                self.requests = [r for r in self.requests if r["source_id"] in f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        by: dict[str, list[dict]] = {}
        for r in self.requests:
            by.setdefault(r["source_id"], []).append(r)
        return [_Requests(x) for x in by.values()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, _Requests):  # what Spark reads where there are no partitions
            return
        fetch, budget = named(self.fetcher), Budget(self.budget)
        for r in sorted(partition.requests, key=lambda r: r.get("place", 0)):
            headers = {k: v for k, v in (("If-None-Match", r.get("etag")), ("If-Modified-Since", r.get("last_modified"))) if v}
            answer, attempts, failure = fetched(fetch, r["url"], headers, tuple(r.get("kinds") or ()), budget)
            own = answer.headers if answer else {}
            yield r["source_id"], r.get("place", 0), r["url"], answer.status if answer else None, own.get("content-type"), own.get("etag"), own.get("last-modified"), answer.body if answer else None, attempts, failure


class AnswerSource(DataSource):
    """Options: ``requests`` (JSON: source_id, place, url, etag, last_modified, kinds of each), ``fetcher``, ``budget`` of attempts a source."""

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return ANSWERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, requests: list[dict], fetcher: str, budget: int = 9) -> DataFrame:
    """The answers to the requests: some per source of a registry, so their list is as short as the registry."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnswerSource)
    return spark.read.format("answers").option("requests", json.dumps(requests)).option("fetcher", fetcher).option("budget", budget).load()
