"""Quality classifier by compression.

Fit, on a bounded sample of labelled documents, each of them whole: one half of each class trains a
zstandard dictionary, the other half calibrates. A text is compressed with
either dictionary; its compressed sizes differ by how much more it shares with
good than with bad text. A text longer than ``SPAN`` bytes is compressed in pieces
of that size, each with the dictionaries anew, so that their part in the sizes does
not shrink with the length. The difference divided by the text's length (plus
``SOFT`` bytes, so that a few bytes of a short text do not decide) goes through
a logistic curve fitted on the second half, which makes it the probability of
label 1.

Defined results: a null text counts as empty, and an empty text gets the score
of difference 0; where a class has no labelled text the score is the share of
label 1 (0.5 without labels); a null id is never held out; repeated rows and
repeated labels of a document count once for each label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

#: Labelled documents of each class that are learned from at most, and their bytes together: documents are taken whole, in an order of hashes, and one that does not fit any more is passed over.
SAMPLE = 3000
SAMPLE_BYTES = 32 << 20
DICTIONARY = 64 << 10
PIECE = 1024
SPAN = 20_000
LEVEL = 3
SOFT = 60
THRESHOLD = 0.7


class Model:
    """Two dictionaries and the logistic curve."""

    def __init__(self, good: list[str], bad: list[str]) -> None:
        self.good = self.bad = b""
        self.a, self.b = 0.0, 0.0
        both = len(good) + len(bad)
        if len(good) > 1 and len(bad) > 1:
            self.good, self.bad = dictionary(good[::2]), dictionary(bad[::2])
            x = np.array([self.difference(t.encode()) for t in good[1::2] + bad[1::2]])
            y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
            self.a, self.b = logistic(x, y)
        elif both:
            share = min(0.99, max(0.01, len(good) / both))
            self.b = float(np.log(share / (1 - share)))

    def __getstate__(self) -> tuple:
        return self.good, self.bad, self.a, self.b

    def __setstate__(self, state: tuple) -> None:
        self.good, self.bad, self.a, self.b = state

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if "_made" not in self.__dict__:
            made = [zstandard.ZstdCompressionDict(d) for d in (self.good, self.bad)]
            for d in made:
                d.precompute_compress(level=LEVEL)
            self._made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in made]
        return self._made

    def difference(self, text: bytes) -> float:
        """How many bytes more the bad dictionary needs, for each byte of text."""
        if not self.good:
            return 0.0
        good, bad = self.compressors()
        parts = [text] if len(text) <= SPAN else [text[k : k + SPAN] for k in range(0, len(text), SPAN)]
        return sum(len(bad.compress(x)) - len(good.compress(x)) for x in parts) / (len(text) + SOFT)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-(self.a * self.difference(text) + self.b))))


def dictionary(texts: list[str]) -> bytes:
    """A dictionary from pieces of the texts; raw text where there is too little to train on."""
    pieces = [raw[k : k + PIECE] for t in texts for raw in [t.encode()] for k in range(0, len(raw), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, k=200, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:] or b" " * 8


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method with a weak pull to 0 on the standardised slope."""
    mean, spread = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mean) / spread, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    ridge = np.array([0.05, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge) + 1e-9 * np.eye(2), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, held_out: int | None = 2) -> Model:
    """A model from labelled documents, without those whose fold of 4 is ``held_out``."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if held_out is not None:
        own = own.where(c.fold(key, 4) != held_out)
    own = own.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    sized = texts.select("key", F.octet_length("text").alias("n"), F.xxhash64("text").alias("digest")).join(own, "key")
    picked = []
    for value in (1, 0):
        # at most ``sample`` rows of three numbers and a label
        found, left = sized.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key", "digest").limit(sample).collect(), SAMPLE_BYTES
        for place, r in enumerate(found):
            if r.n <= left:
                left -= r.n
                picked.append((place, r.key, r.digest, value))
    wanted = docs.sparkSession.createDataFrame(picked, f"place int, key {sized.schema['key'].dataType.simpleString()}, digest bigint, label int").dropDuplicates(["key", "digest", "label"])
    # at most 2 * ``sample`` names of texts, so the broadcast is bounded; documents stay where they are
    rows = texts.withColumn("digest", F.xxhash64("text")).join(F.broadcast(wanted), ["key", "digest"]).dropDuplicates(["key", "digest", "label"])
    by_label: dict[int, list[str]] = {value: [r.text for r in rows.where(F.col("label") == value).orderBy("place").select("text").collect()] for value in (1, 0)}
    return Model(by_label[1], by_label[0])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: key, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["key", "score", "predicted"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return c.batched(rows, run, "key bigint, score double, predicted int").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(t or b"") >= threshold for t in batch.column(text).cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
