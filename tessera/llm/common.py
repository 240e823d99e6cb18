"""What several operators share: reading Arrow text without copying, splitting
bytes into words, 64-bit hashes of words and of word sequences, folds, and
tables in the folder that all executors share.

Text travels as Arrow buffers and stays bytes: a block of documents is one
``uint8`` array with offsets, and words, hashes and n-grams are whole-array
numpy operations over it. Blocks are cut at about ``BLOCK_BYTES`` so that a
Python worker's memory does not depend on the size of a partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
U64 = np.uint64

#: A-Z to a-z, all other bytes as they are.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of words between white space: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder of the cluster's ``spark.checkpoint.dir``; on one machine, where it may be unset, one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` gave and that no later result reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key with this share of all rows is hot; at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001


def joined(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Rows of ``left`` with the one row of ``right`` that has their keys; both are stored tables.

    ``n`` of ``right`` says how many rows of ``left`` have its keys. Rows of hot keys stay where they are and meet a broadcast
    of at most 1 / ``HOT_SHARE`` rows of ``right``, whose columns must be of bounded size; no task gets all rows of a hot key.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    is_hot = F.col(n) >= max(2, HOT_SHARE * total)
    hot = F.broadcast(right.where(is_hot).drop(n))
    rest = left.join(F.broadcast(right.where(is_hot).select(*keys)), keys, "left_anti").join(right.where(~is_hot).drop(n).hint("merge"), keys)
    return left.join(hot, keys).unionByName(rest)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores, so that it is no column of ``df`` (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ---------------------------------------------------------------- Arrow text


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, null as empty, without a copy where there are no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``most`` bytes of text each (a longer document stands alone), with bytes and offsets."""
    data, offsets = text_bytes(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, batch.num_rows)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


# ---------------------------------------------------------------- words and hashes


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base modulo 2**64, or of its inverse."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        grown = np.full(size, _INVERSE if inverse else _BASE, U64)
        grown[0] = 1
        _powers[key] = have = np.multiply.accumulate(grown)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a hash so that all its bits depend on all of the input (the splitmix64 finaliser)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of ``inside`` bytes, none across documents, and each document's first word (n + 1)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    is_in = inside[data]
    begins = is_in.copy()
    begins[1:] &= ~is_in[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = is_in[edges]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = is_in[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the bytes stand."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(len(data), inverse=True)[starts])


def gram_hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` words from each start."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * powers(len(words)), out=sums[1:])
    return mixed((sums[starts + length] - sums[starts]) * powers(len(words), inverse=True)[starts])


def within(firsts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of ``length`` words that lies in one document, and its document."""
    counts = np.maximum(np.diff(firsts) - length + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    return ranges(firsts[:-1], counts), docs


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``count`` numbers each, one after another."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def batched(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(run, schema)


def as_int64(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return h.view(np.int64)


def nested(flat: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column: ``counts`` values for each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)
