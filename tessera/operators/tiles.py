"""Joins of items that share an entity, in tiles: no pair is a row before it is compared, so that what is shuffled grows with the items.

Both sides are dealt into blocks by their keys, a block's rows at random into parts of some ``TILE`` rows, and each part of the left meets
each part of the right in one group. There a text's tokens are counted over an index of the other side's tokens; equal texts
are compared once. A pair that shares several entities belongs to the block of the first of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.tables import stored

#: Rows of either side in a tile, on average at most.
TILE = 4096
#: Tiles of one join are dealt into so many tasks at most.
TASKS = 4096
#: So many different texts of the left are counted at once.
TEXTS = 512


def tiled(left: DataFrame, right: DataFrame, keys: list[str], find: Callable[[tuple, pa.Table, pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """The rows of ``find(key, part of left, part of right)`` for every pair of parts of a block; both sides have ``id`` and the keys."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def work(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(find(key, a, b)), out) if a.num_rows and b.num_rows else out.empty_table()

    many = lambda rows, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    sizes = stored(many(left, "n_a").join(many(right, "n_b"), keys), "tiles")
    tiles = sizes.agg(F.coalesce(F.sum(F.col("n_a").cast("bigint") * F.col("n_b")), F.lit(0))).first()[0]
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS, tiles))
    by = [*keys, "part_a", "part_b"]

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        parts = rows.join(sizes, keys).withColumn(f"part_{own}", F.pmod(F.xxhash64("id"), F.col(f"n_{own}").cast("bigint")).cast("int"))
        parts = parts.withColumn(f"part_{other}", F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_a", "n_b")
        # columns of its own: both sides may come from one table
        return parts.select(*[F.col(c).alias(c) for c in parts.columns]).repartition(tasks, *by).groupBy(*by)

    return dealt(left, "a", "b").cogroup(dealt(right, "b", "a")).applyInArrow(work, schema)


def texts(column: pa.ChunkedArray) -> tuple[np.ndarray, list[list[str]], list[str]]:
    """The number of each row's text among the different ones, their tokens and the texts; a text is its tokens in order between blanks."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    said = coded.dictionary.to_pylist()
    return coded.indices.to_numpy(zero_copy_only=False), [x.split(" ") for x in said], said


def index(tokens: list[list[str]]) -> dict[str, np.ndarray]:
    """Each token with the numbers of the texts that have it."""
    found: dict[str, list[int]] = {}
    for k, words in enumerate(tokens):
        for w in words:
            found.setdefault(w, []).append(k)
    return {w: np.asarray(x, dtype=np.int32) for w, x in found.items()}


def counted(tokens: list[str], postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """How many of the tokens each of n texts has."""
    hits = [postings[w] for w in tokens if w in postings]
    return np.bincount(np.concatenate(hits), minlength=n) if hits else np.zeros(n, dtype=np.int64)


class Names:
    """Names of both sides' rows as bits, in the order of the names, so that tiles agree on which of several is first."""

    def __init__(self, *columns: pa.ChunkedArray) -> None:
        lists = [c.to_pylist() for c in columns]
        self.names = sorted({x for rows in lists for row in rows for x in row})
        self.place = {x: k for k, x in enumerate(self.names)}
        self.sides = [self._bits(rows) for rows in lists]

    def _bits(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(self.names) // 64 + 1, len(rows)), dtype=np.uint64)
        for k, row in enumerate(rows):
            for x in row:
                at = self.place[x]
                out[at >> 6, k] |= np.uint64(1 << (at & 63))
        return out

    def first(self, shared: np.ndarray, name: str) -> np.ndarray:
        """Where no name before this one is shared."""
        at = self.place[name]
        before = (shared[at >> 6] & np.uint64((1 << (at & 63)) - 1)) == 0
        return before & ~shared[: at >> 6].any(axis=0)

    def of(self, bits: np.ndarray) -> list[str]:
        return [x for k, x in enumerate(self.names) if int(bits[k >> 6]) >> (k & 63) & 1]

    def bits(self, names: list[str] | tuple[str, ...]) -> np.ndarray:
        return self._bits([[x for x in names if x in self.place]])[:, 0]


@dataclass
class Row:
    """One row of the left with the rows of the right that it may pair with: places, tokens in common, Jaccard, shared names."""

    at: int
    others: np.ndarray
    common: np.ndarray
    jaccard: np.ndarray
    shared: np.ndarray


class Tile:
    """A part of the left against a part of the right: columns ``id``, ``source_id``, ``row`` (tokens in order), ``high``."""

    def __init__(self, entity: str, a: pa.Table, b: pa.Table) -> None:
        self.entity, self.a, self.b = entity, a, b
        self.of_a, self.words_a, self.said_a = texts(a.column("row"))
        self.of_b, self.words_b, self.said_b = texts(b.column("row"))
        self.postings = index(self.words_b)
        self.size_a, self.size_b, self.chars_a, self.chars_b = (np.asarray([len(x) for x in of], dtype=np.int64) for of in (self.words_a, self.words_b, self.said_a, self.said_b))
        self.names = Names(a.column("high"), b.column("high"))
        self.high_a, self.high_b = self.names.sides
        self.ids_a, self.ids_b = (x.column("id").to_numpy() for x in (a, b))
        codes = {x: k for k, x in enumerate({*a.column("source_id").to_pylist(), *b.column("source_id").to_pylist()} - {None, ""}, 1)}
        self.source_a, self.source_b = (np.asarray([codes.get(x, none) for x in side.column("source_id").to_pylist()]) for side, none in ((a, -1), (b, 0)))
        self.one_a, self.one_b = (self._one(*x) for x in ((self.of_a, self.source_a, -1), (self.of_b, self.source_b, 0)))
        self.rows_a, self.rows_b = ([*np.split(order := np.argsort(of, kind="stable"), np.searchsorted(of[order], np.arange(1, n)))] for of, n in ((self.of_a, len(self.said_a)), (self.of_b, len(self.said_b))))

    @staticmethod
    def _one(of: np.ndarray, source: np.ndarray, none: int) -> np.ndarray:
        """The source of each text, ``none`` where its rows have several or none."""
        least, most = (np.full(of.max(initial=-1) + 1, x) for x in (np.iinfo(np.int64).max, -1))
        np.minimum.at(least, of, source)
        np.maximum.at(most, of, source)
        return np.where((least == most) & (least > 0), least, none)

    def rows(self, possible: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], apart: bool = True) -> Iterator[tuple[int, Row]]:
        """Each text of the left with its rows, and what of the right has two tokens in common, another source, and this entity as the first shared; ``possible`` tells by texts, of some of the left at once. ``apart``: without rows of the same id."""
        for begin in range(0, len(self.words_a), TEXTS):
            us = np.arange(begin, min(begin + TEXTS, len(self.words_a)))
            common = np.stack([counted(self.words_a[u], self.postings, len(self.said_b)) for u in us])
            # texts of one source only are no pair
            common[self.one_a[us, None] == self.one_b] = 0
            jaccard = common / (self.size_a[us, None] + self.size_b - common)
            good = (common >= 2) & possible(us, common, jaccard)
            for u in us[good.any(axis=1)]:
                yield from ((int(u), row) for row in self._rows_of(u, good[u - begin], common[u - begin], jaccard[u - begin], apart))

    def _rows_of(self, u: int, good: np.ndarray, common: np.ndarray, jaccard: np.ndarray, apart: bool) -> Iterator[Row]:
        vs = np.flatnonzero(good)
        others = np.sort(np.concatenate([self.rows_b[v] for v in vs])) if 8 * len(vs) < len(good) else np.flatnonzero(good[self.of_b])
        for i in self.rows_a[u]:
            shared = self.high_b[:, others] & self.high_a[:, i, None]
            fits = (not apart or self.ids_b[others] != self.ids_a[i]) & (self.source_b[others] != self.source_a[i]) & self.names.first(shared, self.entity)
            if fits.any():
                js = others[fits]
                yield Row(int(i), js, common[self.of_b[js]], jaccard[self.of_b[js]], shared[:, fits])
