"""Benchmark decontamination with an FM-index for each training shard.

The test phrases (windows of consecutive words of each benchmark item) go to
every shard in blocks of bounded size; where they are several, each is a pass of
its own over the documents, of which only rows with hits are kept. A shard is a run of documents in one
task. Its words become symbols of the phrase block's vocabulary; only runs of
words in which every neighbouring pair also stands side by side in some phrase
can hold a phrase, so the shard's FM-index is built over these runs and nothing
is lost. Backward search through wavelet-tree ranks finds the rows of all
phrases at once, the sampled suffix positions locate them, and overlapping
occurrences are merged into removal spans.

Defined results: a null or empty text has no words and no spans; an item
without words has no windows; repeated items and repeated documents are judged
row by row; a null item_id never enters an item list but its words count as
hits; empty tables give no rows, or no hits; extra columns of either table are
left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c
from tessera.llm.fm_index import FMIndex

WINDOW = 10
#: UTF-8 bytes of benchmark text in one block of phrases; a worker holds some five times that of it.
PHRASE_BYTES = 8 << 20
WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

FOUND = "n_words bigint, n_hit bigint, spans array<struct<first:int,last:int>>, items array<string>"


class Phrases:
    """A block of benchmark windows: vocabulary, pairs, distinct patterns and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        raw = [text.encode() for _, text in items]
        data = c.ASCII_LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
        starts, ends, firsts = c.word_spans(data, offsets, c.ALNUM)
        words = c.span_hashes(data, starts, ends)
        self.hashes, symbols = np.unique(words, return_inverse=True)
        self.sigma = len(self.hashes) + 1
        self.text = (symbols + 1).astype(np.int32)
        # windows of each item; an item of fewer words is one
        n = np.diff(firsts)
        counts, sizes = np.where(n < window, n > 0, n - window + 1).astype(np.int64), np.minimum(n, window)
        at, item = c.ranges(firsts[:-1], counts), np.repeat(np.arange(len(n)), counts)
        grams, length = np.zeros(len(at), np.uint64), sizes[item]
        for size in np.unique(length).tolist():
            own = length == size
            grams[own] = c.mixed(c.gram_hashes(words, at[own], size) + np.uint64(size))
        _, first, pattern = np.unique(grams, return_index=True, return_inverse=True)
        self.at, self.lengths = at[first].astype(np.int32), length[first].astype(np.int32)
        self.least = int(self.lengths.min()) if len(first) else 0
        follows = np.zeros(len(words), bool)
        follows[: len(words) - 1] = True
        follows[firsts[1:][firsts[1:] > 0] - 1] = False
        left = np.flatnonzero(follows)
        self.pairs = np.unique(self.text[left].astype(np.int64) * self.sigma + self.text[left + 1])
        known: dict[str, int] = {}
        owner = np.array([-1 if i is None else known.setdefault(i, len(known)) for i, _ in items], np.int64)[item]
        self.ids = list(known)
        owned = np.unique(pattern[owner >= 0] * max(1, len(known)) + owner[owner >= 0])
        self.owner = (owned % max(1, len(known))).astype(np.int32)
        self.owner_at = np.searchsorted(owned // max(1, len(known)), np.arange(len(first) + 1))

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The symbol of each word hash; 0 where no phrase has it."""
        if not len(self.hashes):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at + 1, 0)


def shard_runs(symbols: np.ndarray, firsts: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the runs that can hold a phrase: every neighbouring pair in them is a pair of some phrase."""
    n = len(symbols)
    joined = np.zeros(n + 1, bool)  # word k goes on from word k - 1
    if n > 1 and len(phrases.pairs):
        both = np.flatnonzero((symbols[1:] > 0) & (symbols[:-1] > 0)) + 1
        key = symbols[both - 1] * phrases.sigma + symbols[both]
        at = np.minimum(np.searchsorted(phrases.pairs, key), len(phrases.pairs) - 1)
        joined[both[phrases.pairs[at] == key]] = True
    joined[firsts] = False
    starts = np.flatnonzero((symbols > 0) & ~joined[:-1])
    stops = np.flatnonzero((symbols > 0) & ~joined[1:]) + 1
    keep = stops - starts >= max(1, phrases.least)
    return starts[keep], (stops - starts)[keep]


def occurrences(symbols: np.ndarray, firsts: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and first word of every occurrence in the shard."""
    none = np.zeros(0, np.int64)
    starts, lengths = shard_runs(symbols, firsts, phrases)
    if not len(starts):
        return none, none
    ends = np.cumsum(lengths + 1)
    sequence = np.zeros(int(ends[-1]), np.int64)
    words = c.ranges(starts, lengths)
    places = c.ranges(ends - lengths - 1, lengths)
    sequence[places] = symbols[words]
    word_of = np.zeros(len(sequence), np.int64)
    word_of[places] = words
    # phrases with a word that the shard lacks need no search
    lacks = np.ones(phrases.sigma, bool)
    lacks[sequence] = False
    missing = np.concatenate([[0], np.cumsum(lacks[phrases.text])])
    live = np.flatnonzero(missing[phrases.at + phrases.lengths] == missing[phrases.at])
    index = FMIndex(sequence, phrases.sigma).compact()
    lo, hi = index.search(phrases.text, phrases.at[live], phrases.lengths[live])
    counts = np.maximum(hi - lo, 0)
    return np.repeat(live, counts), word_of[index.locate(c.ranges(lo, counts))]


def shard(data: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list, np.ndarray, list, np.ndarray]:
    """Words, hit words, spans and items of each document of a shard."""
    data = c.ASCII_LOWER[data]
    starts, ends, firsts = c.word_spans(data, offsets, c.ALNUM)
    pattern, word = occurrences(phrases.symbols(c.span_hashes(data, starts, ends)), firsts, phrases)
    n = len(starts)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, word, 1)
    np.add.at(depth, word + phrases.lengths[pattern], -1)
    hit = np.cumsum(depth)[:n] > 0
    counted = np.concatenate([[0], np.cumsum(hit)])
    edge = np.zeros(n + 1, bool)
    edge[firsts[firsts < n]] = True
    opens = np.flatnonzero(hit & (edge[:n] | ~np.concatenate([[False], hit[:-1]])))
    closes = np.flatnonzero(hit & (np.concatenate([edge[1:n], [True]]) | ~np.concatenate([hit[1:], [False]]))) + 1
    doc = np.searchsorted(firsts, opens, "right") - 1
    spans = [opens - firsts[doc], closes - firsts[doc]]
    span_counts = np.bincount(doc, minlength=len(offsets) - 1)
    owners = phrases.owner_at[pattern + 1] - phrases.owner_at[pattern]
    item = phrases.owner[c.ranges(phrases.owner_at[pattern], owners)]
    in_doc = np.repeat(np.searchsorted(firsts, word, "right") - 1, owners)
    found = np.unique(np.stack([in_doc, item]), axis=1)
    item_counts = np.bincount(found[0].astype(np.int64), minlength=len(offsets) - 1)
    return np.diff(firsts), np.diff(counted[firsts]), spans, span_counts, [phrases.ids[k] for k in found[1].astype(np.int64)], item_counts


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark in blocks of about ``most`` bytes, streamed a partition at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    block, held = [], 0
    for row in rows.toLocalIterator():
        block.append((row.i, row.t or ""))
        held += len(block[-1][1].encode())
        if held >= most:
            yield block
            block, held = [], 0
    yield block


def _searched(rows: DataFrame, phrases: Phrases, every: bool, keys: list[str]) -> tuple[DataFrame, Broadcast]:
    """``keys``, n_words, n_hit, spans and items of each row (or of those with hits) of ``keys`` and ``text``; and the broadcast that it needs."""
    sent = rows.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in c.blocks(batch, "text"):
                words, hits, (first, last), spans, items, n_items = shard(data, offsets, sent.value)
                pairs = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["first", "last"])
                columns = [*(part.column(k) for k in keys), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), c.nested(pairs, spans), c.nested(pa.array(items, pa.string()), n_items)]
                found = pa.RecordBatch.from_arrays(columns, [*keys, "n_words", "n_hit", "spans", "items"])
                yield found if every else found.filter(pa.array(hits > 0))

    return c.batched(rows, run, ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), FOUND])), sent


def _by_text(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, window: int, phrase_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """What one block of phrases finds in each document, and None; of several blocks the key, digest and number of words of each document, and what all find in each text that has a hit, by the text's SHA-256.

    Blocks are searched one after another, each in a pass that writes the few rows with hits; texts are never shuffled, and a block's broadcast goes when its pass is done.
    """
    blocks = phrase_blocks(benchmark, item, item_text, phrase_bytes)
    first, second = next(blocks), next(blocks, None)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    if second is None:
        return _searched(rows, Phrases(first, window), True, ["key"])[0], None
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    tables = []
    for n, items in enumerate(chain([first, second], blocks)):
        found, sent = _searched(rows, Phrases(items, window), n == 0, ["key", "digest"])
        tables.append(c.stored(found.withColumn("block", F.lit(n)), f"phrases-{n}"))
        sent.destroy()
    hits = reduce(DataFrame.unionByName, [x.where("n_hit > 0").select("digest", "block", "spans", "items") for x in tables])
    # documents of one text have the same hits
    return tables[0].select("key", "digest", "n_words"), _merged(hits.dropDuplicates(["digest", "block"]))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """Per document: key, n_words, n_hit, spans (merged word spans to remove, first to last, last excluded), items.

    One row for each input row. ``key`` is an integer column. More benchmark text than ``phrase_bytes`` is searched block by block.
    """
    rows, hits = _by_text(docs, benchmark, key, text, item, item_text, window, phrase_bytes)
    if hits is None:
        return rows.withColumnRenamed("key", key)
    met = rows.join(hits, "digest", "left")
    none = lambda k: F.coalesce(k, F.expr(f"cast(array() as {hits.schema[k].dataType.simpleString()})")).alias(k)
    return met.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), none("spans"), none("items"))


def _merged(hits: DataFrame) -> DataFrame:
    """The blocks' findings in each text as one row."""
    found = hits.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<first:int,last:int>>)"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["last"] >= s["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last"))))).otherwise(F.concat(done, F.array(s))),
    )
    return found.withColumn("spans", merged).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"]))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the query returns: counts and the digest of the sorted items."""
    return found.select(
        key, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def without_spans(text: bytes, words: list[tuple[int, int]], spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans``, each cut up to the next kept word."""
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : words[first][0]])
        at = words[last][0] if last < len(words) else len(text)
    return b"".join([*out, text[at:]])


def cut(rows: pa.RecordBatch, text: str, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """The rows without each one's spans of words; rows with spans of which nothing is left go."""
    texts = rows.column(text).to_pylist()
    gone = np.zeros(rows.num_rows, bool)
    for d, own in enumerate(spans):
        if own:
            raw = texts[d].encode()
            words = [m.span() for m in WORD.finditer(raw.translate(c.ASCII_LOWER.tobytes()))]
            texts[d] = without_spans(raw, words, own).decode()
            gone[d] = not WORD.search(texts[d].encode().lower())
    columns = {n: rows.column(n) for n in rows.schema.names}
    columns[text] = pa.array(texts, rows.schema.field(text).type)
    if "n_chars" in columns:
        columns["n_chars"] = pa.array([n if not own or t is None else len(t) for n, own, t in zip(columns["n_chars"].to_pylist(), spans, texts, strict=True)], rows.schema.field("n_chars").type)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(pa.array(~gone))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """The documents with every benchmark passage cut out of ``text``; rows of which nothing is left go.

    All columns stay as they are but ``text``, and ``n_chars`` where there is one.
    However many blocks the benchmark has, all are judged on the text as it came, and it is cut once.
    """
    schema = docs.schema
    blocks = phrase_blocks(benchmark, "item_id", "text", phrase_bytes)
    first_block = next(blocks)
    if not next(blocks, None):
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(first_block, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offsets in c.blocks(batch, text):
                    _, hits, (first, last), counts, _, _ = shard(data, offsets, sent.value)
                    if not hits.any():
                        yield rows
                        continue
                    pairs, at = list(zip(first.tolist(), last.tolist(), strict=True)), np.cumsum(counts) - counts
                    yield cut(rows, text, [pairs[k : k + n] for k, n in zip(at.tolist(), counts.tolist(), strict=True)])

        return docs.mapInArrow(run, schema)

    mark, spans = c.free_name(docs, "_text"), c.free_name(docs, "_spans")
    _, hits = _by_text(docs.withColumn(mark, F.lit(0)), benchmark, mark, text, "item_id", "text", window, phrase_bytes)
    joined = docs.withColumn(mark, F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))).join(hits.select(F.col("digest").alias(mark), F.col("spans").alias(spans)), mark, "left")

    def run_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in c.blocks(batch, text):
                own = [[(x["first"], x["last"]) for x in s or ()] for s in rows.column(spans).to_pylist()]
                yield cut(rows.select(schema.names), text, own)

    return joined.select(*[F.col(f"`{x}`") for x in docs.columns], spans).mapInArrow(run_merged, schema)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str, bool]]:
    """The contract word by word, for tests."""

    def words(t: str | None) -> list[str]:
        return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or ""))

    out = {}
    for doc, text in docs:
        have, hit, found = words(text), set(), set()
        for item, t in items:
            w = words(t)
            for k in range(min(1, len(w)) if len(w) < window else len(w) - window + 1):
                part = w[k : k + window]
                for at in range(len(have) - len(part) + 1):
                    if have[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        found.add(str(item))
        out[doc] = (len(have), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out
