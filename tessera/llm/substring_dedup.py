"""Substring dedup with a compressed FM-index for each shard.

A word goes when a window of ``WINDOW`` consecutive words that covers it also
starts in a document with a smaller id. Every window has one anchor, the
smallest hash among its runs of ``GRAM`` words, so equal windows have equal
anchors; consecutive windows of one anchor are a piece. An anchor that only one
document holds cannot have a repeated window, which leaves a small part of the
text. Of that part:

* equal pieces are one row with its smallest document before anything is
  searched, so a group of copies, however large, costs one piece;
* pieces that share an anchor but differ go to the anchor's shard. A shard
  builds FM-indexes over its pieces and streams them through backward search
  over the wavelet tree. The matching statistics, cut to ``WINDOW`` words by the
  LCP, give the rows of every window; the smallest document among the rows that
  the search found decides, and intervals of such windows are reported;
* an anchor with more than ``HOT`` different pieces, or more than
  ``INDEX_WORDS`` words of them, is no single shard's work: its windows are
  hashed one by one and their smallest document is found by an aggregation with
  map-side combine, which is exact as well.

A piece of more than ``LONG`` windows (a text of one repeated word) is cut.

Spans name the piece they were found in, and a document checks the piece's
hash before it removes anything, so documents that share an id are judged by
their own text. Defined results: a null or empty text has no words; a text
shorter than a window loses nothing; a document with a null id loses nothing
and removes nothing from others; documents with equal ids do not count as
smaller than one another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c
from tessera.llm.fm_index import FMIndex

WINDOW = 50
GRAM = 10
#: Different pieces of one anchor beyond which its windows are aggregated one by one.
HOT = 2000
#: Words in one index and of one anchor's pieces at most, windows of one piece at most, and streamed at a time.
INDEX_WORDS = 400_000
LONG = 4096
STREAM = 64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, in log(width) passes."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def piece_runs(words: np.ndarray, firsts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, document, first word and number of windows of every piece."""
    starts, docs = c.within(firsts, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    grams = c.gram_hashes(words, np.arange(len(words) - gram + 1), gram)
    anchors = sliding_min(grams, window - gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (docs[1:] != docs[:-1])
    runs = np.flatnonzero(new)
    new |= (np.arange(len(new)) - np.repeat(runs, np.diff(np.append(runs, len(new))))) % LONG == 0
    at = np.flatnonzero(new)
    return anchors[at], docs[at], starts[at] - firsts[docs[at]], np.diff(np.append(at, len(starts)))


def piece_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each piece's words."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * c.powers(len(words)), out=sums[1:])
    return c.mixed((sums[starts + lengths] - sums[starts]) * c.powers(len(words), inverse=True)[starts] + lengths.astype(np.uint64))


def pieces(docs: DataFrame, key: str, text: str, window: int, gram: int) -> DataFrame:
    """One row for each piece of each document: anchor, piece, doc, first, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in c.blocks(batch, "text"):
                starts, ends, firsts = c.word_spans(data, offsets, c.NOT_SPACE)
                words = c.span_hashes(data, starts, ends)
                anchors, at, first, n = piece_runs(words, firsts, window, gram)
                hashes = piece_hashes(words, firsts[at] + first, n + window - 1) if len(at) else anchors
                columns = [pa.array(c.as_int64(anchors)), pa.array(c.as_int64(hashes)), rows.column("doc").take(pa.array(at)), pa.array(first, pa.int32()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "piece", "doc", "first", "n"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    return c.batched(rows, run, "anchor bigint, piece bigint, doc bigint, first int, n int")


def cut_pieces(docs: DataFrame, wanted: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """The words of each wanted piece, or for a hot anchor its windows' hashes.

    ``wanted``: doc, list of (anchor, piece, first, n, hot). Rows: anchor,
    piece, doc, words (null for a hot one), windows (null for others).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in c.blocks(batch, "text"):
                starts, ends, firsts = c.word_spans(data, offsets, c.NOT_SPACE)
                words = c.span_hashes(data, starts, ends)
                lists = rows.column("wanted")
                flat, counts = lists.flatten(), np.diff(np.asarray(lists.offsets))
                at = np.repeat(np.arange(rows.num_rows), counts)
                anchor, piece, first, n, hot = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("anchor", "piece", "first", "n", "hot"))
                begin, length = firsts[at] + first, n.astype(np.int64) + window - 1
                own = begin + length <= firsts[at + 1]
                own[own] = c.as_int64(piece_hashes(words, begin[own], length[own])) == piece[own]
                keep = np.flatnonzero(own)
                texts, grams = [], []
                for k in keep.tolist():
                    b, e = int(begin[k]), int(begin[k] + length[k])
                    if hot[k]:
                        texts.append(None)
                        grams.append(c.as_int64(c.gram_hashes(words[b:e], np.arange(n[k]), window)))
                    else:
                        texts.append(b" ".join(data[starts[b] : ends[e - 1]].tobytes().split()))
                        grams.append(None)
                columns = [pa.array(anchor[keep]), pa.array(piece[keep]), rows.column("doc").take(pa.array(at[keep])), pa.array(texts, pa.binary()), pa.array(grams, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "piece", "doc", "words", "windows"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).join(wanted, "doc")
    return c.batched(rows, run, "anchor bigint, piece bigint, doc bigint, words binary, windows array<bigint>")


class ShardIndex:
    """The FM-index of a shard's pieces, with the document of every row."""

    def __init__(self, texts: list[bytes], docs: np.ndarray, window: int) -> None:
        self.window = window
        data = np.frombuffer(b" ".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate([np.cumsum(sizes + 1) - sizes - 1, [len(data)]])
        starts, ends, firsts = c.word_spans(data, offsets, c.NOT_SPACE)
        hashes = c.span_hashes(data, starts, ends)
        vocabulary, symbols = np.unique(hashes, return_inverse=True)
        self.lengths = np.diff(firsts)
        closes = np.cumsum(self.lengths + 1)
        self.begins = closes - self.lengths - 1
        self.sequence = np.zeros(int(closes[-1]), np.int64)
        self.sequence[c.ranges(self.begins, self.lengths)] = symbols + 1
        self.index = FMIndex(self.sequence, len(vocabulary) + 1)
        order = self.index.order
        left = (np.repeat(closes - 1, self.lengths + 1) - np.arange(len(self.sequence)))[order]  # words before the piece ends
        self.short = self._groups(order, left, window - 1)
        self.owner = np.repeat(docs, self.lengths + 1)[order]
        self.index.compact()
        edges = np.flatnonzero(np.diff(self.short, prepend=-1))
        self.short_at = np.append(edges, len(order))

    def _groups(self, order: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
        """A number for each row, equal where rows share ``depth`` words (their LCP is that long)."""
        long = left >= depth
        sums = np.zeros(len(order) + 1, np.uint64)
        np.cumsum(c.mixed(self.sequence.astype(np.uint64)) * c.powers(len(order)), out=sums[1:])
        at = order[long]
        grams = np.zeros(len(order), np.uint64)
        grams[long] = c.mixed((sums[at + depth] - sums[at]) * c.powers(len(order), inverse=True)[at])
        same = np.zeros(len(order), bool)
        same[1:] = long[1:] & long[:-1] & (grams[1:] == grams[:-1])
        return np.cumsum(~same) - 1

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, offset and smallest document of every window, by matching statistics of all pieces."""
        windows = self.lengths - self.window + 1
        parts = -(-windows // STREAM)
        piece = np.repeat(np.arange(len(windows)), parts)
        start = (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)) * STREAM
        count = np.minimum(STREAM, windows[piece] - start)
        end = self.begins[piece] + start + count + self.window - 1
        lo, hi = np.zeros(len(piece), np.int64), np.full(len(piece), len(self.sequence), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        least, known = np.zeros(len(self.sequence), np.int64), np.zeros(len(self.sequence), bool)
        for k in range(1, int((count + self.window).max(initial=0))):
            live = np.flatnonzero(k <= count + self.window - 1)
            if k > self.window:  # keep the first window - 1 words of the match: its LCP interval
                g = self.short[lo[live]]
                lo[live], hi[live] = self.short_at[g], self.short_at[g + 1]
            lo[live], hi[live] = self.index.step(self.sequence[end[live] - k], lo[live], hi[live])
            if k >= self.window:
                # rows of different windows do not overlap: the documents of each interval are looked at once
                fresh = live[~known[lo[live]]]
                first, at = np.unique(lo[fresh], return_index=True)
                edges = np.stack([first, hi[fresh[at]]], axis=1).reshape(-1)
                least[first] = np.minimum.reduceat(np.append(self.owner, 0), edges)[::2] if len(edges) else 0
                known[first] = True
                found.append((piece[live], (end[live] - k) - self.begins[piece[live]], least[lo[live]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def window_spans(offsets: np.ndarray, window: int) -> list[dict[str, int]]:
    """Merged word spans of sorted window offsets."""
    cut = np.flatnonzero(np.diff(offsets) > window)
    firsts, lasts = offsets[np.append(0, cut + 1)], offsets[np.append(cut, len(offsets) - 1)] + window
    return [{"first": int(a), "last": int(b)} for a, b in zip(firsts, lasts, strict=True)]


SPANS = "array<struct<first:int,last:int>>"


def search_shard(texts: list[bytes], docs: list[int], window: int) -> dict[int, list[dict[str, int]]]:
    """The spans of each piece that stand in a smaller document, by position in ``texts``."""
    own = np.array(docs, np.int64)
    piece, offset, least = ShardIndex(texts, own, window).stream()
    hit = np.flatnonzero(least < own[piece])
    hit = hit[np.lexsort((offset[hit], piece[hit]))]
    out = {}
    for part in np.split(hit, np.flatnonzero(np.diff(piece[hit])) + 1):
        if len(part):
            out[int(piece[part[0]])] = window_spans(offset[part], window)
    return out


def shard_spans(cut: DataFrame, window: int, index_words: int) -> DataFrame:
    """Per piece with hits: anchor, piece and its spans, found in the shards' FM-indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            found = search_shard([r[3] for r in rows], [r[2] for r in rows], window) if rows else {}
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[k][0] for k in found], pa.int64()), pa.array([rows[k][1] for k in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], ["anchor", "piece", "spans"]
            )

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("anchor", "piece", "doc", "words")), strict=True):
                if size >= index_words and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += row[3].count(b" ") + 2
        yield flush(held)

    rows = cut.where("words IS NOT NULL").select("anchor", "piece", "doc", "words").repartition("anchor").sortWithinPartitions("anchor")
    return c.batched(rows, run, f"anchor bigint, piece bigint, spans {SPANS}")


def hot_spans(cut: DataFrame, window: int) -> DataFrame:
    """The same for hot anchors: the smallest document of each window, one by one."""
    each = cut.where("windows IS NOT NULL").select("anchor", "piece", "doc", F.posexplode("windows").alias("at", "gram"))
    least = each.groupBy("gram").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("gram", "least")
    hits = each.join(least, "gram").where("least < doc").groupBy("anchor", "piece").agg(F.array_sort(F.collect_set("at")).alias("at"))
    spans = F.aggregate(
        "at",
        F.expr(f"cast(array() as {SPANS})"),
        lambda done, k: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= k),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), (k + window).alias("last")))),
        ).otherwise(F.concat(done, F.array(F.struct(k.alias("first"), (k + window).alias("last"))))),
    )
    return hits.select("anchor", "piece", spans.alias("spans"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, index_words: int = INDEX_WORDS) -> DataFrame:
    """Per document with repeats: doc and a list of (first, n, piece, spans): the spans of words to remove, from the piece's first word."""
    every = c.stored(pieces(docs, key, text, window, gram), "pieces")
    shared = every.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n")
    shared = c.stored(shared.withColumnRenamed("n", "rows"), "anchors")
    held = c.stored(c.joined(every, shared, ["anchor"], "rows"), "shared-pieces")
    c.dropped(every)
    distinct = c.stored(held.groupBy("anchor", "piece").agg(F.min("doc").alias("least"), F.max("n").alias("n"), F.count("*").alias("rows")), "distinct-pieces")
    several = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + (window - 1)).alias("size")).where("kinds > 1")
    wanted = (
        held.join(distinct.select("anchor", "piece", F.col("least").alias("doc")), ["anchor", "piece", "doc"])
        .join(several, "anchor")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("anchor", "piece", "first", "n", ((F.col("kinds") > hot) | (F.col("size") > index_words)).alias("hot"))).alias("wanted"))
    )
    cut = c.stored(cut_pieces(docs, wanted, key, text, window), "cut-pieces")
    inner = shard_spans(cut, window, index_words).unionByName(hot_spans(cut, window))
    judged = c.stored(distinct.drop("n").join(inner, ["anchor", "piece"], "left"), "judged-pieces")
    c.dropped(cut)
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") + (window - 1)).alias("last")))
    # a piece has at most LONG windows, so its spans are bounded
    hits = c.joined(held, judged, ["anchor", "piece"], "rows").withColumn("spans", F.when(F.col("least") < F.col("doc"), whole).otherwise(F.col("spans"))).where("spans IS NOT NULL")
    found = c.stored(hits.groupBy("doc").agg(F.collect_list(F.struct("first", "n", "piece", "spans")).alias("found")), "repeats")
    for table in (shared, held, distinct, judged):
        c.dropped(table)
    return found


def removed_words(words: np.ndarray, firsts: np.ndarray, found: list, window: int) -> np.ndarray:
    """Which words go: the spans of those pieces that stand in the document as they were found."""
    depth = np.zeros(len(words) + 1, np.int64)
    for d, pieces_ in enumerate(found):
        if not pieces_:
            continue
        begin = np.array([p["first"] for p in pieces_], np.int64) + firsts[d]
        length = np.array([p["n"] for p in pieces_], np.int64) + window - 1
        own = begin + length <= firsts[d + 1]
        own[own] = c.as_int64(piece_hashes(words, begin[own], length[own])) == np.array([p["piece"] for p in pieces_], np.int64)[own]
        for k in np.flatnonzero(own).tolist():
            for s in pieces_[k]["spans"]:
                depth[begin[k] + s["first"]] += 1
                depth[begin[k] + s["last"]] -= 1
    return np.cumsum(depth)[: len(words)] > 0


def kept_bytes(data: np.ndarray, offsets: np.ndarray, window: int, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, removed words, and the kept words joined by one space, as bytes and offsets, of each document of a block."""
    starts, ends, firsts = c.word_spans(data, offsets, c.NOT_SPACE)
    gone = removed_words(c.span_hashes(data, starts, ends), firsts, found, window) if any(found) else np.zeros(len(starts), bool)
    kept = np.flatnonzero(~gone)
    doc = np.searchsorted(firsts, kept, "right") - 1
    follows = np.zeros(len(kept), bool)
    follows[:-1] = doc[1:] == doc[:-1]
    depth = np.zeros(len(data) + 2, np.int32)
    depth[starts[kept]] += 1
    np.subtract.at(depth, ends[kept] + follows, 1)
    mask = np.cumsum(depth)[: len(data)] > 0
    spaced = data.copy()
    spaced[ends[kept[follows]]] = 0x20
    sizes = np.concatenate([[0], np.cumsum(mask)])[offsets]
    counted = np.concatenate([[0], np.cumsum(gone)])
    return np.diff(firsts), np.diff(counted[firsts]), spaced[mask], sizes


def digest(docs: DataFrame, repeats: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: counts and the digest of the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in c.blocks(batch, "text"):
                n, gone, kept, at = kept_bytes(data, offsets, window, rows.column("found").to_pylist())
                raw = kept.tobytes()
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).join(repeats, "doc", "left")
    return c.batched(rows, run, "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string").withColumnRenamed("doc", key)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without repeated passages; rows of which no word is left go. White space between kept words stays."""
    found, own_key, columns = c.free_name(docs, "found"), c.free_name(docs, "_doc"), docs.columns
    repeats = find(docs, key, text, window).select(F.col("doc").alias(own_key), F.col("found").alias(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in c.blocks(batch, text):
                lists = rows.column(found).to_pylist()
                own = rows.select(columns)
                if not any(lists):
                    yield own
                    continue
                starts, ends, firsts = c.word_spans(data, offsets, c.NOT_SPACE)
                gone = removed_words(c.span_hashes(data, starts, ends), firsts, lists, window)
                texts, keep = own.column(text).to_pylist(), np.ones(own.num_rows, bool)
                for d in np.unique(np.searchsorted(firsts, np.flatnonzero(gone), "right") - 1).tolist():
                    flags, a, b = gone[firsts[d] : firsts[d + 1]], firsts[d], firsts[d + 1]
                    mask = np.ones(offsets[d + 1] - offsets[d], bool)
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
                    for first, last in zip(edges[::2] + a, edges[1::2] + a, strict=True):
                        mask[starts[first] - offsets[d] : (starts[last] if last < b else offsets[d + 1]) - offsets[d]] = False
                    texts[d] = data[offsets[d] : offsets[d + 1]][mask].tobytes().decode()
                    keep[d] = not flags.all()
                parts = {n: own.column(n) for n in columns}
                parts[text] = pa.array(texts, own.schema.field(text).type)
                if "n_chars" in parts:
                    changed = np.diff(np.concatenate([[0], np.cumsum(gone)])[firsts]) > 0
                    parts["n_chars"] = pa.array([len(t) if x else v for x, v, t in zip(changed.tolist(), parts["n_chars"].to_pylist(), texts, strict=True)], own.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(parts.values()), columns).filter(pa.array(keep))

    joined = docs.join(repeats, F.col(key).cast("bigint") == F.col(own_key), "left").drop(own_key)
    return joined.mapInArrow(run, docs.schema)


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The contract word by word, for tests (ids are distinct)."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first: dict[tuple[str, ...], int] = {}
    for d in sorted(words):
        for k in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][k : k + window]), d)
    out = {}
    for d, w in words.items():
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < d for p in range(k, k + window)}
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out
