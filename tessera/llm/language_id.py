"""Language identification by language-bitmask n-gram filters.

Fit: letter trigrams are counted for each language over a bounded sample of the
labelled documents. A language's filter takes the trigrams that make up at
least ``LEAST_RATE`` of its trigrams and at least ``LEAST_SHARE`` of the rate
that any language has, so a filter holds at most 1 / ``LEAST_RATE`` trigrams.
All languages' Bloom filters share their hash functions and lie side by side as
bit slices: slot s holds one bit for each language, so the AND of a trigram's
slots is the mask of all languages whose filter contains it.

Predict: the masks of all trigrams of the whole text give one popcount for each
language; a filter that is filled to a share p reports a foreign trigram with
probability p**hashes, and the counts are corrected for that. The largest count
decides, the score is its share of all languages' counts; among equal counts the
alphabetically first language wins.

Defined results: a null text or one without letters is ``und`` with score 0, as
is every text where nothing could be learned; a null id is never held out;
repeated rows are judged each by itself; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

#: At most so many documents of each language are learned from (fewer where there are fewer).
SAMPLE = 4000
LEAST_RATE = 2e-5
LEAST_SHARE = 0.2
HASHES = 4
SLOTS_EACH = 16
UNKNOWN = "und"
_U = np.uint64
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The packed letter trigrams of all texts, and offsets: lower case, each run of other characters as one blank."""
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in low], np.int64)
    points = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, 0).astype(_U)
    docs = np.repeat(np.arange(len(low)), sizes)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (docs[1:] != docs[:-1])
    points, docs = points[keep], docs[keep]
    if len(points) < 3:
        return np.zeros(0, _U), np.zeros(len(low) + 1, np.int64)
    inner = (points[1:-1] != 0) & (docs[2:] == docs[:-2])
    packed = (points[:-2] | points[1:-1] << _U(21) | points[2:] << _U(42))[inner]
    return packed, np.searchsorted(docs[1:-1][inner], np.arange(len(low) + 1))


class Filters:
    """The bit-sliced filters of all languages."""

    def __init__(self, rows: list[tuple[str, int]]) -> None:
        self.languages = sorted({lang for lang, _ in rows})
        number = {lang: k for k, lang in enumerate(self.languages)}
        most = max(np.bincount([number[lang] for lang, _ in rows]), default=1) if rows else 1
        self.slots = 1 << int(SLOTS_EACH * most - 1).bit_length()
        self.width = -(-len(self.languages) // 64) or 1
        self.bits = np.zeros((self.slots, self.width), _U)
        for k, lang in enumerate(self.languages):
            grams = np.array([g for name, g in rows if name == lang], np.int64).view(_U)
            for at in self._slots(grams):
                self.bits[at, k // 64] |= _U(1) << _U(k % 64)
        self.false = np.array([float(((self.bits[:, k // 64] >> _U(k % 64)) & _U(1)).mean()) ** HASHES for k in range(len(self.languages))])

    def _slots(self, grams: np.ndarray) -> list[np.ndarray]:
        h = c.mixed(grams + _U(0x9E3779B97F4A7C15))
        step = (c.mixed(h) | _U(1)) & _U(0xFFFFFFFF)
        return [((h + _U(k) * step) & _U(self.slots - 1)).astype(np.int64) for k in range(HASHES)]

    def counts(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Corrected number of trigrams of each document in each language's filter."""
        slots = self._slots(grams)
        n = np.diff(at)
        out = np.zeros((len(n), len(self.languages)))
        for w in range(self.width):
            mask = self.bits[slots[0], w]
            for s in slots[1:]:
                mask = mask & self.bits[s, w]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                ones = np.concatenate([[0], np.cumsum((mask >> _U(k % 64)) & _U(1))]).astype(np.int64)
                found = ones[at[1:]] - ones[at[:-1]]
                out[:, k] = np.maximum(0, (found - n * self.false[k]) / max(1e-9, 1 - self.false[k]))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        grams, at = trigrams(texts)
        n = np.diff(at)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), n
        counts = self.counts(grams, at)
        best = counts.argmax(axis=1)
        total = counts.sum(axis=1)
        score = np.where(total > 0, counts[np.arange(len(texts)), best] / np.maximum(total, 1e-9), 0.0)
        return [self.languages[b] if some else UNKNOWN for b, some in zip(best.tolist(), (n > 0).tolist(), strict=True)], np.where(n > 0, score, 0.0), n


def sampled(docs: DataFrame, key: str, lang: str, most: int) -> DataFrame:
    """About ``most`` documents of each language, picked by the hash of their ids."""
    sizes = {r[0]: r[1] for r in docs.groupBy(lang).count().collect()}
    share = F.lit(1.0)
    for name, n in sizes.items():
        if n > most:
            share = F.when(F.col(lang) == name, most / n).otherwise(share)
    return docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < share * (1 << 20))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> Filters:
    """Filters from the given documents; rows without a text or language teach nothing."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, _ in c.blocks(batch, "text"):
                grams, at = trigrams(block.column("text").to_pylist())
                names = np.array(block.column("lang").to_pylist(), object)
                owner = np.repeat(names, np.diff(at))
                for name in dict.fromkeys(names.tolist()):
                    found, often = np.unique(grams[owner == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(often, pa.int64())], ["lang", "gram", "n"])

    counted = c.batched(sampled(rows, "key", "lang", most).select("lang", "text"), run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = c.stored(counted, "trigrams")
    totals = {r.lang: r.total for r in counted.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    rate = F.lit(0.0)
    for name, total in totals.items():
        rate = F.when(F.col("lang") == name, F.col("n") / float(total)).otherwise(rate)
    rated = counted.withColumn("rate", rate).where(F.col("rate") >= LEAST_RATE)  # at most 1 / LEAST_RATE for each language
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rated.join(top, "gram").where(F.col("rate") >= LEAST_SHARE * F.col("top"))
    return Filters([(r.lang, r.gram) for r in kept.select("lang", "gram").toLocalIterator()])


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, lang_pred, score, n_grams."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, _ in c.blocks(batch, "text"):
                names, score, n = sent.value.predict(block.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(names), pa.array(score), pa.array(n, pa.int64())], ["key", "lang_pred", "score", "n_grams"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return c.batched(rows, run, "key bigint, lang_pred string, score double, n_grams bigint").withColumnRenamed("key", key)
