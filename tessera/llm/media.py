"""Media columns: interleaved document sequences.

An HTML document becomes an ordered list of parts, each with its position: text,
or a media reference with its caption. References name media by the digest of
their content. Media lie in a table of stored bytes keyed by that digest; parts
are joined to it by digest, so that a payload that many documents show is stored,
read and described once, and put back in the order of their positions.

The stored form here is an 8-bit grey PNG, 64 samples wide: any payload whose
length is a multiple of 64 is kept exactly.

Defined results: null or empty HTML has no parts; a reference without a digest,
or with one that the table does not have, stays in its place with null media
columns; equal references in one document are separate parts; a null text is an
empty text; rows with a null or repeated key are rows of their own; a table without
rows gives none; a result whose name a column already has gets underscores in front.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
PART = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
#: Elements that show media, and the attribute that names it.
MEDIA = {"img": "src", "audio": "src", "video": "src", "source": "src", "embed": "src", "object": "data"}
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset(["script", "style", "template", "noscript"])


# ---------------------------------------------------------------- stored form


def padded(raw: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey image with one 8-bit sample for each byte."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line opens with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image; checks every chunk's CRC."""
    if media[:8] != PNG:
        raise ValueError("no PNG")
    at, width, packed = 8, 0, []
    while at < len(media):
        (n,), kind, body = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8], media[at + 8 : at + 8 + struct.unpack(">I", media[at : at + 4])[0]]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            width, _, depth, colour, _, _, _ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, spread and entropy of the samples, and a 64-bit hash of which columns are brighter than the mean."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    n, values = len(samples), np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = (int((counts * values**2).sum()) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    bright = samples.reshape(-1, WIDTH).sum(axis=0, dtype=np.int64) * WIDTH > int((counts * values).sum())
    return f"{WIDTH}x{n // WIDTH} mean={mean:.4f} sd={spread:.4f} entropy={entropy + 0.0:.4f} columns={np.packbits(bright).tobytes().hex()}"


def stored_payloads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_bytes, digest of its payload, html that shows it, media (null where the task has stored that digest).

    The table in the shared folder is the media store.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for block, data, offsets in c.blocks(batch, "text"):
                raw, at = data.tobytes(), offsets.tolist()
                digests, media, html = [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    payload = padded(raw[a:b])
                    digest = hashlib.sha256(payload)
                    fresh = digest.digest() not in seen
                    if len(seen) > 200_000:  # a bounded memory; storing a payload twice is harmless
                        seen.clear()
                    seen.add(digest.digest())
                    digests.append(digest.hexdigest())
                    media.append(to_png(payload) if fresh else None)
                    html.append(f'<article><p>Text as samples.</p><figure><img src="sha256:{digests[-1]}"><figcaption>{b - a} bytes</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(np.diff(offsets), pa.int64()), pa.array(digests), pa.array(html), pa.array(media, pa.binary())], ["key", "n_bytes", "digest", "html", "media"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return c.stored(c.batched(rows, run, "key bigint, n_bytes bigint, digest string, html string, media binary"), "media")


def described(media: DataFrame) -> DataFrame:
    """Per digest, from the stored bytes read back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows = []
                for form in part.column("media").to_pylist():
                    payload = from_png(form)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("digest"), *columns], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.where("media IS NOT NULL").select("digest", "media")
    schema = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return c.batched(rows, run, schema).dropDuplicates(["digest"])


# ---------------------------------------------------------------- sequences


class _Sequence(HTMLParser):
    """Collects the parts of one document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def close_block(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.parts.append({"position": len(self.parts), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in HIDDEN
        if tag in BLOCKS and self.caption is None:
            self.close_block()
        if tag == "figure":
            self.figures.append(len(self.parts))
        elif tag == "figcaption":
            self.caption = []
        values = dict(attrs)
        if tag in MEDIA and values.get(MEDIA[tag]):
            self.close_block()
            found = re.fullmatch(r"sha256:([0-9a-fA-F]{64})", values[MEDIA[tag]].strip())
            self.parts.append({"position": len(self.parts), "kind": tag, "text": None, "digest": found[1].lower() if found else None, "caption": values.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in HIDDEN and self.hidden > 0
        if tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            media = [p for p in self.parts[self.figures[-1] if self.figures else 0 :] if p["kind"] != "text"]
            if media and self.figures:
                for p in media:
                    p["caption"] = text or p["caption"]
            elif text:
                self.parts.append({"position": len(self.parts), "kind": "text", "text": text, "digest": None, "caption": None})
        elif tag in BLOCKS and self.caption is None:
            self.close_block()
        if tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parts_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    if parser.caption:  # never closed
        parser.words, parser.caption = parser.caption, None
    parser.close_block()
    return parser.parts


def sequences(pages: DataFrame, html: str = "html", parts: str = "parts") -> DataFrame:
    """All columns and ``parts``, the ordered text and media references of ``html``."""
    parts = c.free_name(pages, parts)
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, _ in c.blocks(batch, html):
                found = pa.array([parts_of(x) for x in block.column(html).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*block.columns, found], [*block.schema.names, parts])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return c.batched(pages, run, f"{fields}, {parts} array<{PART}>")


def resolved(found: DataFrame, media: DataFrame, key: str | list[str], parts: str = "parts") -> DataFrame:
    """One row for each part, in place: key, position, kind, text, digest, caption and the columns of ``media`` (one row per digest, of bounded size).

    References to a digest that very many parts name do not all go to one task.
    """
    each = c.stored(found.select(*([key] if isinstance(key, str) else key), F.inline(parts)), "parts")
    named = each.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("_n"))
    known = c.stored(named.join(media, "digest", "left"), "described")
    return c.joined(each, known, ["digest"], "_n").unionByName(each.where("digest IS NULL"), allowMissingColumns=True)


def interleaved(each: DataFrame, key: str) -> DataFrame:
    """The parts of each document as one list again, in the order of their positions."""
    rest = [x for x in each.columns if x not in (key, "position")]
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias("parts"))
