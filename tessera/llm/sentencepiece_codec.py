"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut into chunks at blanks, where no piece of the vocabulary
can continue (checked when the model is read), and each chunk that is new to
the worker is indexed once: the chunks are concatenated, their suffixes are
sorted (as far as the longest piece reaches), and every piece is binary-searched
in this suffix array for the range of its occurrences. The resulting edges (start, end, piece) are sorted by position and
relaxed from left to right, all chunks side by side.

The public models are BPE, so relaxing is not a best-score search: the encoding
of a prefix is unique, and an edge extends it when its piece may stand after
the prefix's last piece, that is when merging the two pieces' text alone gives
back the two pieces. With that rule the result equals merging the whole text by
score, leftmost first; tests compare it with the library. Characters that no
piece has become their UTF-8 bytes' pieces.

Only identity-normalised BPE models with byte pieces are read; others are
refused. Defined results: a null text encodes to an empty list, as does an
empty one; U+2581 in a text counts as a blank, so it decodes to one; each row is
encoded by itself, so repeated rows have equal ids; a table without rows gives
none; a result whose name a column already has gets underscores in front.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

#: Where the driver finds the public vocabulary.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: When a worker remembers more chunks than this, or more characters of them, it starts anew with the next block.
REMEMBERED, REMEMBERED_CHARS = 200_000, 4 << 20


class Numbers(dict):
    """Numbers what it is asked for: 0, 1, 2 and so on."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class PairTable:
    """A hash table from pairs of pieces to yes or no, looked up for whole arrays."""

    SLOTS = 1 << 20

    def __init__(self) -> None:
        self.keys = np.full(self.SLOTS, -1, np.int64)
        self.values = np.zeros(self.SLOTS, bool)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (c.mixed(keys.astype(np.uint64)) & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and whether each key is there."""
        value, there = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        open_, slot = np.arange(len(keys)), self._slots(keys)
        while len(open_):
            have = self.keys[slot]
            hit = have == keys[open_]
            value[open_[hit]] = self.values[slot[hit]]
            there[open_[hit]] = True
            on = ~hit & (have >= 0)
            open_, slot = open_[on], (slot[on] + 1) % self.SLOTS
        return value, there

    def add(self, keys: list[int], values: list[bool]) -> None:
        """New keys; when the table is half full it starts anew."""
        if self.used + len(keys) > self.SLOTS // 2:
            self.__init__()
        for key, value, slot in zip(keys, values, self._slots(np.array(keys, np.int64)).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % self.SLOTS
            self.keys[slot], self.values[slot] = key, value
        self.used += len(keys)


class Pieces:
    """A vocabulary: pieces by id with their scores, and byte pieces."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]) -> None:
        self.pieces, self.scores, self.byte_ids = pieces, scores, byte_ids
        self.ids = {p: k for k, p in enumerate(pieces) if p}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece goes on after an inner blank")
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        self._ready = False

    @classmethod
    def read(cls, path: str = MODEL) -> "Pieces":
        """From a model file, on the driver; executors get it by broadcast."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        if sp.encode("Ａ  b") == sp.encode("A b") or sp.decode(sp.encode("Ａ  b")) != "Ａ  b":
            raise ValueError("the model normalises text")
        plain = [not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)) for k in range(n)]
        byte_ids = {int(sp.id_to_piece(k)[1:-1], 16): k for k in range(n) if sp.is_byte(k)}
        return cls([sp.id_to_piece(k) if plain[k] else "" for k in range(n)], [sp.get_score(k) for k in range(n)], [byte_ids[b] for b in sorted(byte_ids)])

    def __getstate__(self) -> tuple:
        return self.pieces, self.scores, self.byte_ids

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def ready(self) -> None:
        """What a worker needs beside the pieces, made once."""
        if self._ready:
            return
        order = sorted((p.encode(), k) for p, k in self.ids.items())
        self.width = -(-max(len(b) for b, _ in order) // 8)
        self.piece_bytes = np.zeros((len(order), 8 * self.width), np.uint8)
        for k, (b, _) in enumerate(order):
            self.piece_bytes[k, : len(b)] = np.frombuffer(b, np.uint8)
        self.key_ids = np.array([k for _, k in order], np.int64)
        self.key_sizes = np.array([len(b) for b, _ in order], np.int64)
        # the smallest and the largest words of eight bytes that a suffix with each piece in front can have
        self.low = self.piece_bytes.view(">u8").astype(np.uint64)
        filled = np.where(np.arange(8 * self.width) < self.key_sizes[:, None], self.piece_bytes, np.uint8(0xFF))
        self.high = np.ascontiguousarray(filled).view(">u8").astype(np.uint64)
        raw = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for b, k in enumerate(self.byte_ids):
            raw[k] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.array([len(b) for b in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.follows = PairTable()
        self.forget()
        self._ready = True

    def forget(self) -> None:
        """Drop the remembered chunks."""
        self.known, self.held = Numbers(), 0
        self.store, self.store_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: always the adjacent pair of highest score, the leftmost of equals."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = ids.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the piece ``right`` may stand after ``left`` (after nothing: left is -1)."""
        a, b = self.pieces[left] if left >= 0 else "", self.pieces[right]
        return self.merge(a + b) == ([a, b] if a else [b])

    def allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``may_follow`` of many pairs; each new pair is merged once."""
        n = len(self.pieces)
        keys = (left + 1) * n + right
        value, there = self.follows.find(keys)
        if not there.all():
            fresh, place = np.unique(keys[~there], return_inverse=True)
            found = [self.may_follow(k // n - 1, k % n) for k in fresh.tolist()]
            self.follows.add(fresh.tolist(), found)
            value[~there] = np.array(found)[place]
        return value

    def suffixes(self, eight: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The given places in the order of their suffixes; ``eight`` has the eight bytes from each place as a number."""
        place = begins[np.argsort(eight[begins])]
        new = np.diff(eight[place], prepend=eight[place[:1]] - np.uint64(1)) != 0
        for k in range(1, self.width):
            # those that are equal so far go on with their next eight bytes
            open_ = np.flatnonzero(~new | ~np.append(new[1:], True))
            if not len(open_):
                break
            group, key = np.cumsum(new)[open_], eight[place[open_] + 8 * k]
            order = np.lexsort((key, group))
            place[open_], key = place[open_[order]], key[order]
            new[open_[1:]] |= key[1:] != key[:-1]
        return place

    def edges(self, text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence in the concatenated text (0xFF closes each chunk)."""
        padded = np.concatenate([text, np.full(16 * self.width + 8, 0xFF, np.uint8)])
        eight = np.zeros(len(padded) - 7, np.uint64)
        for k in range(8):
            eight = eight << np.uint64(8) | padded[k : len(padded) - 7 + k]
        place = self.suffixes(eight, begins)
        array = eight[place]
        lo, hi = np.searchsorted(array, self.low[:, 0], "left"), np.searchsorted(array, self.high[:, 0], "right")
        for k in range(1, self.width):
            long = np.flatnonzero((self.key_sizes > 8 * k) & (lo < hi))
            first, last = lo[long], hi[long]
            lo[long] = bisected(eight, place, 8 * k, first, last, self.low[long, k], False)
            hi[long] = bisected(eight, place, 8 * k, first, last, self.high[long, k], True)
        counts = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(counts)), counts)
        start = place[c.ranges(lo, counts)]
        return start, start + self.key_sizes[which], self.key_ids[which]

    def relaxed(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after another, and how many each has."""
        raw = [x.encode() for x in chunks]
        text = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
        ends = np.cumsum([len(b) + 1 for b in raw]) - 1
        begins = ends - [len(b) for b in raw]
        lead = np.flatnonzero((text & 0xC0 != 0x80) & (text != 0xFF))
        start, end, piece = self.edges(text, lead)
        # characters that no piece has: edges of their own (-2), with which nothing merges
        size = np.diff(np.append(lead, len(text)))
        size -= text[np.minimum(lead + size, len(text)) - 1] == 0xFF
        single = np.zeros(len(text), bool)
        char_size = np.zeros(len(text), np.int64)
        char_size[lead] = size
        single[start[end - start == char_size[start]]] = True
        odd = ~single[lead]
        start, end, piece = (np.concatenate(x) for x in ((start, lead[odd]), (end, lead[odd] + size[odd]), (piece, np.full(int(odd.sum()), -2))))
        # by character in the chunk: all chunks are relaxed side by side
        number = np.zeros(len(text), np.int64)
        number[lead] = np.arange(len(lead))
        column = number[start] - np.repeat(number[begins], np.diff(np.append(begins, len(text))))[start]
        longest = int(column.max(initial=0))
        # small numbers are sorted by radix; the order within a column plays no part
        column = column.astype(np.uint16 if longest < 1 << 16 else np.int64)
        order = np.argsort(column, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=longest + 1))])
        last, back = np.full(len(text), -3, np.int64), np.zeros(len(text), np.int64)
        last[begins] = -1
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = last[s]
            ok = before != -3
            check = np.flatnonzero(ok & (p >= 0))
            ok[check] = self.allowed(np.maximum(before[check], -1), p[check])
            last[e[ok]], back[e[ok]] = p[ok], s[ok]
        found: list[tuple[np.ndarray, ...]] = []
        at, chunk, step = ends.copy(), np.arange(len(chunks)), 0
        while len(at):
            open_ = at > begins[chunk]
            at, chunk = at[open_], chunk[open_]
            found.append((chunk, np.full(len(at), step), last[at], back[at], at))
            at, step = back[at], step + 1
        chunk, step, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
        # found from the back: the place of each piece follows from its chunk's number of pieces
        place = np.cumsum(np.bincount(chunk, minlength=len(chunks)))[chunk] - 1 - step
        order = np.empty(len(place), np.int64)
        order[place] = np.arange(len(place))
        chunk = chunk[order]
        piece, start, end = (x[order] for x in rest)
        times = np.where(piece == -2, end - start, 1)
        out = np.repeat(piece, times)
        spelt = out == -2
        out[spelt] = np.array(self.byte_ids)[text[c.ranges(start[piece == -2], times[piece == -2])]]
        return out.astype(np.int32), np.bincount(np.repeat(chunk, times), minlength=len(chunks))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        self.ready()
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.forget()
        had, parts, sizes = len(self.known), [], []
        for text in texts:
            own = chunks_of(text or "")
            parts.extend(own)
            sizes.append(len(own))
        code = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        if len(self.known) > had:
            fresh = list(islice(self.known, had, None))
            self.held += sum(map(len, fresh))
            flat, lengths = self.relaxed(fresh)
            self.store = np.concatenate([self.store, flat])
            self.store_at = np.concatenate([self.store_at, self.store_at[-1] + np.cumsum(lengths)])
        n = self.store_at[code + 1] - self.store_at[code]
        ids = self.store[c.ranges(self.store_at[code], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of lists of ids: byte pieces are joined, the blank in front goes."""
        self.ready()
        sizes = self.raw_sizes[ids]
        data = self.raw[c.ranges(self.raw_at[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def bisected(eight: np.ndarray, place: np.ndarray, at: int, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, right: bool) -> np.ndarray:
    """Where each key belongs in its own range lo to hi of the suffix array, by the eight bytes at ``at``; after equal ones if ``right``."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        middle = (lo[open_] + hi[open_]) // 2
        have = eight[place[middle] + at]
        below = have <= key[open_] if right else have < key[open_]
        lo[open_[below]] = middle[below] + 1
        hi[open_[~below]] = middle[~below]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def chunks_of(text: str) -> list[str]:
    """The text with a blank in front, cut before every blank that follows something else."""
    if not text:
        return []
    parts = text.replace(BLANK, " ").split(" ")
    if "" not in parts:
        return [BLANK + x for x in parts]
    out, blanks = [], 0
    for x in parts:
        blanks += 1
        if x:
            out.append(BLANK * blanks + x)
            blanks = 0
    return [*out, BLANK * blanks] if blanks else out


@lru_cache(maxsize=2)
def read_pieces(path: str) -> Pieces:
    return Pieces.read(path)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", decoded_sha256: str | None = None, model: str = MODEL) -> DataFrame:
    """All columns and ``ids``, an array of int; with ``decoded_sha256`` also the digest of the ids decoded again."""
    ids = c.free_name(docs, ids)
    decoded_sha256 = decoded_sha256 and c.free_name(docs, decoded_sha256)
    sent = docs.sparkSession.sparkContext.broadcast(read_pieces(model))
    extra = f", {decoded_sha256} string" if decoded_sha256 else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        for batch in batches:
            for block, _, _ in c.blocks(batch, text):
                found, counts = pieces.encode(block.column(text).to_pylist())
                columns = [*block.columns, c.nested(pa.array(found, pa.int32()), counts)]
                if decoded_sha256:
                    columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in pieces.decode(found, counts)]))
                yield pa.RecordBatch.from_arrays(columns, [*block.schema.names, ids, *([decoded_sha256] if decoded_sha256 else [])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return c.batched(docs, run, f"{fields}, {ids} array<int>{extra}")


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """All columns and the text of ``ids``; null ids give an empty text."""
    text = c.free_name(df, text)
    sent = df.sparkSession.sparkContext.broadcast(read_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                block = batch.slice(first, 1000)
                lists = [np.array(x or [], np.int64) for x in block.column(ids).to_pylist()]
                flat = np.concatenate([*lists, np.zeros(0, np.int64)])
                found = sent.value.decode(flat, np.array([len(x) for x in lists], np.int64))
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found, pa.string())], [*block.schema.names, text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return c.batched(df, run, f"{fields}, {text} string")
