"""Product codes of vectors: each part of a vector is replaced by the index of the nearest entry of its codebook.

Vectors are written once as blocks, a NumPy matrix each, one dimension after
another. A round of fitting is one ``treeAggregate`` over the blocks: in a block
the squared distances to all entries accumulate dimension by dimension, each part
goes to the nearest entry, and ``np.add.at`` adds it to int64 tensors of sums and
counts, which merge through a reduction tree. What a task holds or the driver
gets depends on the size of a block and of the codebooks, never on the number of
vectors. All numbers are integers, so no result depends on the order of sums.

Defined results: vectors that are null or hold a null or a component that is not
finite are dropped; a vector shorter than the longest kept one is filled up with
zeros, and so are all up to a multiple of the number of parts; with fewer kept
vectors than entries each is an entry, and without any the result is empty; rows
with the same id are rows of their own, in order of their components; null ids
come last, null labels are one label. Distances that a long can't hold are an
error. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components in a block: 1 MB as stored.
BLOCK = 1 << 18
#: Levels of the reduction tree.
DEPTH = 2


def _is_whole(vector: str) -> Column:
    """Not null, and of finite components."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def blocks(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The kept vectors as integers in blocks, in a stored table, and the first ``ENTRIES`` of them by id, one a row."""
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(_is_whole("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False).astype(np.int64)
            step = max(1, BLOCK // max(1, int(sizes.max(initial=0))))
            for first in range(0, batch.num_rows, step):
                part, own = batch.slice(first, step), sizes[first : first + step]
                values = np.floor(scale * part.column("vector").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
                largest = float(np.abs(values).max(initial=0))
                matrix = np.zeros((int(own.max(initial=0)), len(own)), np.int32)
                if largest < 2**31:  # else fitting refuses the table
                    matrix[c.ranges(np.zeros(len(own), np.int64), own), np.repeat(np.arange(len(own)), own)] = values
                yield pa.RecordBatch.from_arrays(
                    [*(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), part.column(k)) for k in ("id", "label")), pa.array([len(own)]), pa.array([len(matrix)]), pa.array([largest]), pa.array([matrix.tobytes()], pa.binary())],
                    names=["id", "label", "n", "width", "largest", "components"],
                )

    made = c.batched(rows, run, f"id array<{kinds['id']}>, label array<{kinds['label']}>, n bigint, width bigint, largest double, components binary")
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(ENTRIES).collect()
    seeds = np.zeros((len(first), max([len(r.vector) for r in first], default=0)), np.float64)
    for k, r in enumerate(first):
        seeds[k, : len(r.vector)] = np.floor(scale * np.array(r.vector, np.float64))
    return c.stored(made, "vector-blocks"), seeds


def _cut(components: bytes, width: int, n: int, books: np.ndarray) -> np.ndarray:
    """A block's numbers as (part, dimension in the part, vector)."""
    parts, _, d = books.shape
    whole = np.zeros((parts * d, n), np.int64)
    whole[:width] = np.frombuffer(components, np.int32).reshape(width, n)
    return whole.reshape(parts, d, n)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part of each vector its nearest entry, the first of equally near ones, and the squared distance."""
    parts, d, n = block.shape
    distance = np.zeros((parts, books.shape[1], n), np.int64)
    for j in range(d):
        apart = block[:, None, j] - books[:, :, j, None]
        distance += apart * apart
    codes = distance.argmin(axis=1)
    return codes, np.take_along_axis(distance, codes[:, None], 1)[:, 0]


def fit(table: DataFrame, seeds: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, dimension in the part) for the blocks, beginning with the parts of ``seeds``."""
    most = table.agg(F.coalesce(F.max("width"), F.lit(0)).alias("width"), F.coalesce(F.max("largest"), F.lit(0.0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    d = -(-most.width // parts)
    if parts * d * (2 * most.largest + 1) ** 2 >= 2.0**63 or most.largest * most.n >= 2.0**63:
        raise ValueError(f"components up to {most.largest:g} give distances or sums that a long can't hold")
    whole = np.zeros((len(seeds), parts * d), np.int64)
    whole[:, : seeds.shape[1]] = seeds
    books = whole.reshape(len(seeds), parts, d).transpose(1, 0, 2).copy()
    if not books.size:
        return books
    rdd = table.select("components", "width", "n").rdd.map(tuple)
    for _ in range(rounds):
        now = books

        def add(total: tuple[np.ndarray, np.ndarray], row: tuple) -> tuple[np.ndarray, np.ndarray]:
            block = _cut(*row, now)
            codes, _ = nearest(block, now)
            np.add.at(total[0], (np.arange(len(now))[:, None], codes), block.transpose(0, 2, 1))
            np.add.at(total[1], (np.arange(len(now))[:, None], codes), 1)
            return total

        def merge(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            return x[0] + y[0], x[1] + y[1]

        sums, counts = rdd.treeAggregate((np.zeros_like(now), np.zeros(now.shape[:2], np.int64)), add, merge, DEPTH)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], now)
    return books


def encoded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """``id``, ``label``, ``code`` (two hex digits for each part) and ``error`` (the squared distances' sum) of each vector of the blocks."""
    kinds = {f.name: f.dataType.elementType.simpleString() for f in table.schema if f.name in ("id", "label")}
    digits = np.array([f"{k:02x}" for k in range(256)], "S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = batch.column("n")[k].as_py()
                codes, apart = nearest(_cut(batch.column("components")[k].as_buffer(), batch.column("width")[k].as_py(), n, books), books)
                text = np.ascontiguousarray(digits[codes].T).view(f"S{2 * len(codes)}").ravel()
                own = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([own.column("id").flatten(), own.column("label").flatten(), pa.array(text.astype(str)), pa.array(apart.sum(axis=0))], names=["id", "label", "code", "error"])

    return c.batched(table, run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def decoded(codes: DataFrame, books: np.ndarray, code: str = "code", scale: int = SCALE) -> DataFrame:
    """``codes`` with the column ``decoded``: the vector of its codes' entries."""
    parts, _, d = books.shape
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in book]) for book in books])
    index = lambda k: F.conv(F.substring(code, 2 * k + 1, 2), 16, 10).cast("int")
    return codes.withColumn(c.free_name(codes, "decoded"), F.flatten(F.array(*[F.get(F.get(entries, F.lit(k)), index(k)) for k in range(parts)])))


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` (a stored table of ``label`` and ``error``) with ``label_error``, the errors' sum over equal labels, nulls together.

    The labels' sums are joined back; labels with many rows meet a broadcast of at most 1 / ``common.HOT_SHARE`` sums.
    """
    keyed = rows.withColumns({"_no_label": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = c.stored(keyed.groupBy("_no_label", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return c.joined(keyed, sums, ["_no_label", "_label"]).drop("_no_label", "_label")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all kept vectors with their errors (``id``, ``code``, ``error``, ``label_error``), and the codebooks."""
    table, seeds = blocks(vectors, id, vector, label)
    books = fit(table, seeds)
    rows = c.stored(encoded(table, books), "vector-codes")
    c.dropped(table)
    return with_label_error(rows), books


def brute_force(rows: list[tuple], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[dict, list]:
    """id to (code, error) and the codebooks, of (id, vector) rows of one length, in plain integers; for tests."""
    from math import floor, isfinite

    kept = sorted((i, [floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and isfinite(x) for x in v))
    d = len(kept[0][1]) // parts
    cut = lambda v: [v[k * d : (k + 1) * d] for k in range(parts)]
    books = [[cut(v)[k] for _, v in kept[:entries]] for k in range(parts)]

    def best(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[k]))

    for _ in range(rounds):
        own = [[[] for _ in books[k]] for k in range(parts)]
        for _, v in kept:
            for k, x in enumerate(cut(v)):
                own[k][best(k, x)[1]].append(x)
        books = [[[sum(col) // len(xs) for col in zip(*xs, strict=True)] if xs else books[k][j] for j, xs in enumerate(own[k])] for k in range(parts)]
    found = {}
    for i, v in kept:
        near = [best(k, x) for k, x in enumerate(cut(v))]
        found[i] = ("".join(f"{j:02x}" for _, j in near), sum(e for e, _ in near))
    return found, books
