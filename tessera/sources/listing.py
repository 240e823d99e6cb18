"""A stream over listings: newest first, in pages, whose offset is each source's frontier.

    spark.readStream.format("listing").option("sources", '["a", "b"]').option("pager", "package.module:function").load()

The offset of a source is its boundary, the id of the newest row when the batch
began, with the last id of that first page. A batch holds the rows from the last boundary (excluded) to the new one
(included), read page by page until the last boundary is met; a source without a
boundary begins with its first page, as it was then. Offsets are in the query's checkpoint, so a
batch that is run again asks for the same rows, and rows that have come since
are left for the next. A boundary that the listing no longer has, a listing that
is empty after it had one, or a source that is no longer asked for, is an error:
nothing is begun anew behind the user's back.

``pager`` names a callable ``(options) -> (source, page) -> rows`` that driver and
executors can import; a row is (native_id, title, url, published_at), and a page
beyond the end has none. The offset has an entry for each source of the registry.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.sources.answers import named

ROWS = "source string, page int, native_id string, title string, url string, published_at timestamp"
Row = tuple[str, str | None, str | None, datetime | None]
#: A pager over stored pages reads so many at once.
AHEAD = 100


class ListingError(RuntimeError):
    """A frontier that can't be trusted; the query stops with it."""


class _Stretch(InputPartition):
    def __init__(self, source: str, last: str | None, newest: str, floor: str) -> None:
        super().__init__(source)
        self.source, self.last, self.newest, self.floor = source, last, newest, floor


def stretch(page: Callable[[str, int], list[Row]], source: str, last: str | None, newest: str, floor: str, most: int) -> Iterator[tuple]:
    """The rows from the boundary ``newest`` down to ``last``, without it; of a source that begins, down to ``floor``, with it."""
    seen: set[str] = set()
    begun = False
    for k in range(most):
        rows = page(source, k)
        if not rows:
            raise ListingError(f"{source}: the listing ends before the boundary {last or floor!r}")
        for row in rows:
            begun = begun or row[0] == newest
            if row[0] == last:
                if not begun:
                    raise ListingError(f"{source}: the boundary {newest!r} stands behind {last!r}")
                return
            if begun and row[0] not in seen:  # a row that came meanwhile moves others to the next page
                seen.add(row[0])
                yield source, k, *row
            if last is None and row[0] == floor:
                return
    raise ListingError(f"{source}: no boundary within {most} pages")


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.sources, self.options, self.most = json.loads(options["sources"]), dict(options), int(options.get("pages", "1000"))

    def _pager(self) -> Callable[[str, int], list[Row]]:
        return named(self.options["pager"])(self.options)

    def initialOffset(self) -> dict:
        return {"frontiers": "{}"}

    def latestOffset(self) -> dict:
        page = self._pager()
        with ThreadPoolExecutor(8) as pool:
            first = list(pool.map(lambda s: page(s, 0), self.sources))
        return {"frontiers": json.dumps({s: [rows[0][0], rows[-1][0]] if rows else None for s, rows in zip(self.sources, first, strict=True)}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["frontiers"]), json.loads(end["frontiers"])
        last = {s: ids[0] for s, ids in old.items() if ids}
        for s, boundary in last.items():
            if not new.get(s):
                raise ListingError(f"{s}: the boundary {boundary!r} is gone with the whole listing")
        return [_Stretch(s, last.get(s), *ids) for s, ids in new.items() if ids and ids[0] != last.get(s)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, _Stretch):
            yield from stretch(self._pager(), partition.source, partition.last, partition.newest, partition.floor, self.most)


class ListingSource(DataSource):
    """Options: ``sources`` (JSON list), ``pager``, ``pages`` (how many a batch may read of a source), and the pager's own."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def read(spark: SparkSession, sources: list[str], pager: str, pages: int = 1000, **options: str) -> DataFrame:
    spark.dataSource.register(ListingSource)
    reader = spark.readStream.format("listing").option("sources", json.dumps(sources)).option("pager", pager).option("pages", pages)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def stored_pages(options: dict[str, str]) -> Callable[[str, int], list[Row]]:
    """A pager over recorded listings: Parquet at ``path`` (any address that PyArrow opens), in folders by ``source``, with page, place and the rows' columns."""
    path = options["path"]
    system, root = pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)
    kept = ds.dataset(root, filesystem=system, partitioning=ds.partitioning(pa.schema([("source", pa.string())]), flavor="hive"), format="parquet")

    held: dict[str, tuple[int, int, dict[int, list[Row]]]] = {}

    def page(source: str, k: int) -> list[Row]:
        # the first page alone, as an offset asks for; whoever reads on gets the next ones with it
        begin, end, pages = held.get(source, (0, 0, {}))
        if not begin <= k < end:
            begin, end, pages = k, k + (AHEAD if k else 1), {}
            rows = kept.to_table(["page", "place", "native_id", "title", "url", "published_at"], filter=(pc.field("source") == source) & (pc.field("page") >= begin) & (pc.field("page") < end)).sort_by([("page", "ascending"), ("place", "ascending")])
            at = rows.column("published_at").cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
            for n, *row in zip(*(rows.column(c).to_pylist() for c in ("page", "native_id", "title", "url")), at.to_pylist(), strict=True):
                pages.setdefault(n, []).append(tuple(row))
            held[source] = begin, end, pages
        return pages.get(k, [])

    return page
