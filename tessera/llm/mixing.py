"""Mixing sources to target weights: how often each document is taken, so that each source's words come to its target.

Targets are filled up like water: all words are shared by the sources' weights,
no source gets more than ``MOST`` times its own words, and what is too much is
shared again by weight. A document's expected copies are target / size of its
source; its whole part is taken as it is, its fraction is a probability that
pivotal rounding makes integral, weighted by words, so that what one document
gains others lose and the source's expected words stay as they were.

Documents of a source are dealt to blocks by hash. In a block the largest
undecided document is paired with the pool of all smaller ones, whose
probabilities move together: words pass at random from one to the other, with
chances that keep every document's expectation, until the document is taken or
left, or the pool is. So large documents are settled while there are small ones
to make up for them, and a block leaves at most one document with a fraction,
mostly its smallest. These residuals go up a reduction tree, ``FAN`` blocks of a
source at a step, in which they are paired one with another in the same way; the
one that is left at a source's root is rounded to the nearest. A source's words
thus miss their target by half a document at most.

Chances come from hashes of the document and its place in the block, not from the
order or partitions of the rows: reruns agree.

Defined results: a null text has no words; documents without words take none; a
null source is one source, the last; equal rows (id, source and text) are each a
document, dealt to blocks in equal parts; a null id is an id as any other; a table
without rows gives none; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c
from tessera.operators.state import numbered

#: Weights of the sources in order of their names, over and over.
WEIGHTS = (5, 2, 1)
#: No document, and so no source, is taken more often.
MOST = 3
#: Documents in a block, blocks that meet in a step of the tree, equal rows that stay together.
BLOCK, FAN, TOGETHER = 2048, 64, 256
SEED = 7
#: Closer to 0 or 1 is there.
NEAR = 1e-12
_KEY = ["source_key", "no_source"]


def sized(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``id``, ``source``, ``size`` (words between white space), ``digest`` (SHA-256 of the text) of each row."""
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.unhex(F.sha2(F.col(text), 256)).alias("digest"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in c.blocks(batch, "text"):
                _, _, firsts = c.word_spans(data, offsets, c.NOT_SPACE)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("source"), pa.array(np.diff(firsts)), part.column("digest")], names=["id", "source", "size", "digest"])

    return c.batched(rows, run, f"id {kind}, source string, size bigint, digest binary")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, words: int | None = None) -> DataFrame:
    """``sources`` (``source``, ``source_size``) with the weight, the ``target``, and the copies that it means: ``whole`` and ``fraction``.

    ``words`` of the mix: all words of the sources if not given. A round of sharing sends two sums to the driver.
    """
    keyed = sources.withColumns({"source_key": F.coalesce("source", F.lit("")), "no_source": F.col("source").isNull()})
    placed = numbered(keyed, "no_source", "source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    table = c.stored(placed.withColumn("weight", weight).drop("_place"), "mix-sources")
    whole = lambda x: F.lit(x).cast("decimal(38,0)") if isinstance(x, int) else F.col(x).cast("decimal(38,0)")
    wanted = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] if words is None else words

    level, before = None, None
    while True:
        if level is None:
            full, free = F.lit(False), F.lit(True)
        else:
            full = whole("weight") * level.numerator > whole("source_size") * (most * level.denominator)
            free = ~full
        sums = table.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0))).first()
        if tuple(sums) == before or sums[1] == 0:
            break
        before, level = tuple(sums), Fraction(wanted - most * int(sums[0]), int(sums[1]))
    if level is None:  # no rows
        level = Fraction(0)
    if sums[1] == 0 and before is not None:  # all are full
        full = F.lit(True)
    share, size = whole("weight") * level.numerator, whole("source_size") * level.denominator
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share.cast("double") / F.lit(float(level.denominator)))
    of = lambda x, y: F.when(full, F.lit(x)).when(F.col("source_size") == 0, F.lit(0)).otherwise(y)
    return table.withColumns({"target": target, "whole": of(most, F.call_function("div", share, F.greatest(size, F.lit(1)))).cast("bigint"), "fraction": of(0.0, (share % F.greatest(size, F.lit(1))).cast("double") / size.cast("double")).cast("double")})


def _chance(seeds: np.ndarray) -> list[float]:
    """A number below 1 for each place."""
    with np.errstate(over="ignore"):
        h = c.mixed(seeds.view(np.uint64) + np.arange(1, len(seeds) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(11)).astype(np.float64) / 2**53).tolist()


def rounded(sizes: list[int], p: float, chances: list[float]) -> tuple[list[int], int, float]:
    """Which of the documents of one block, in order of falling size and all with the probability p, are taken; the place and fraction of the one left over, or -1."""
    taken, rest = [0] * len(sizes), sum(sizes)
    for k, s in enumerate(sizes):
        if p <= NEAR or p >= 1 - NEAR or s == 0:
            break
        rest -= s
        if rest == 0:
            return taken, k, p
        to_take, to_leave = s * (1 - p), s * p
        up, down = min(to_take, p * rest), min(to_leave, (1 - p) * rest)
        if chances[k] * (up + down) < down:
            if up < to_take:
                return taken, k, p + up / s
            taken[k], p = 1, p - up / rest
        else:
            if down < to_leave:
                taken[k + 1 :] = [1] * (len(sizes) - k - 1)
                return taken, k, p - down / s
            p += down / rest
    else:
        return taken, -1, 0.0
    if p > 0.5:
        taken[k:] = [1] * (len(sizes) - k)
    return taken, -1, 0.0


def paired(sizes: list[int], fractions: list[float], chances: list[float]) -> tuple[list[int], int, float]:
    """Which of several residuals are taken, each paired with what the one before it left; the place and fraction of the last, or -1."""
    taken, left, p = [0] * len(sizes), -1, 0.0
    for k, (s, q) in enumerate(zip(sizes, fractions, strict=True)):
        if left >= 0:
            a, b = sizes[left], s
            up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
            gain = up if chances[k] * (up + down) < down else -down
            p, q = p + gain / a, q - gain / b
            if NEAR < p < 1 - NEAR:
                taken[k] = round(q)
                continue
            taken[left] = round(p)
        if NEAR < q < 1 - NEAR:
            left, p = k, q
        else:
            left, taken[k] = -1, round(q)
    return taken, left, p


_KEPT = ["id", "source", "source_key", "no_source", "size", "digest", "source_size", "target", "whole", "block", "seed"]


def _result(rows: pa.Table, n: np.ndarray, copies: np.ndarray, fraction: np.ndarray, at: np.ndarray) -> pa.Table:
    """Rows at ``at`` as ``n`` documents of so many copies, or as one with a fraction (null: settled)."""
    out = rows.select(_KEPT).take(pa.array(at))
    return out.append_column("n", pa.array(n, pa.int64())).append_column("copies", pa.array(copies, pa.int64())).append_column("fraction", pa.array(fraction, pa.float64(), from_pandas=True))


def _block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("size", "descending"), ("seed", "ascending")])
    n = rows.column("n").to_numpy()
    of = np.repeat(np.arange(rows.num_rows), n)
    sizes = rows.column("size").to_numpy()[of]
    p = rows.column("fraction")[0].as_py()
    taken, left, rest = rounded(sizes.tolist(), p, _chance(rows.column("seed").to_numpy()[of]))
    taken = np.array(taken, np.int64)
    settled = np.ones(len(of), bool)
    if left >= 0:
        settled[left] = False
    more, fewer = (np.bincount(of[settled & (taken == x)], minlength=rows.num_rows) for x in (1, 0))
    at = np.concatenate([np.flatnonzero(more), np.flatnonzero(fewer), of[~settled]])
    whole = rows.column("whole").to_numpy()[at]
    extra = np.concatenate([np.ones((more > 0).sum(), np.int64), np.zeros(len(at) - (more > 0).sum(), np.int64)])
    return _result(rows, np.concatenate([more[more > 0], fewer[fewer > 0], np.ones(len(at) - (more > 0).sum() - (fewer > 0).sum(), np.int64)]), whole + extra, np.where(np.arange(len(at)) < len(at) - (left >= 0), np.nan, rest), at)


def _meet(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("size", "descending"), ("seed", "ascending"), ("block", "ascending")])
    taken, left, rest = paired(rows.column("size").to_pylist(), rows.column("fraction").to_pylist(), _chance(rows.column("seed").to_numpy()))
    at = np.arange(rows.num_rows)
    return _result(rows, np.ones(len(at), np.int64), rows.column("whole").to_numpy() + np.array(taken), np.where(at == left, rest, np.nan), at)


def copies(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, words: int | None = None, seed: int = SEED) -> DataFrame:
    """``id``, ``source``, ``digest``, ``size``, ``source_size``, ``target``, ``n``, ``copies``: n equal documents are taken so many times each; equal documents may have several rows."""
    rows = sized(docs, id, source, text)
    folded = c.stored(rows.groupBy("id", F.col("source"), "size", "digest").agg(F.count("*").alias("n")).withColumns({"source_key": F.coalesce("source", F.lit("")), "no_source": F.col("source").isNull()}), "mix-sizes")
    sums = folded.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"), F.count("*").alias("n_rows"))
    shares = c.stored(targets(sums, weights, most, words).drop("source", "weight").withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK).cast("bigint")).drop("n_docs"), "mix-targets")
    met = c.joined(folded, shares, _KEY, "n_rows")
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {TOGETHER}")))
    dealt = met.withColumn("chunk", chunk).withColumn("n", F.least(F.lit(TOGETHER), F.col("n") - F.col("chunk") * TOGETHER).cast("bigint"))
    named = [F.col("id").cast("string"), F.col("digest"), F.col("chunk")]
    dealt = dealt.withColumns({"block": F.pmod(F.xxhash64(*named), F.col("blocks")), "seed": F.xxhash64(F.lit(seed), *named)})
    dealt = dealt.select(*_KEPT, "n", "fraction")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*_KEPT).schema) + ", n bigint, copies bigint, fraction double"
    now = c.stored(dealt.groupBy(*_KEY, "block").applyInArrow(_block, schema), "mix-level-0")
    settled = now.where("fraction IS NULL")
    n_blocks, level = shares.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0], 0
    c.dropped(folded)
    while n_blocks > 1:
        n_blocks, level = -(-n_blocks // FAN), level + 1
        left = now.where("fraction IS NOT NULL").withColumn("block", F.expr(f"block div {FAN}"))
        now = c.stored(left.groupBy(*_KEY, "block").applyInArrow(_meet, schema), f"mix-level-{level}")
        settled = settled.unionByName(now.where("fraction IS NULL"))
    root = now.where("fraction IS NOT NULL").withColumn("copies", F.col("whole") + F.when(F.col("fraction") >= 0.5, 1).otherwise(0))
    return settled.unionByName(root).select("id", "source", "digest", "size", "source_size", "target", "n", "copies")


def mixed(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix: each document as often as it is taken. Of equal rows (id, source and text) the first stands for all."""
    times = copies(docs, id, source, text, **options).groupBy(F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("digest").alias("_d")).agg(F.sum(F.col("n") * F.col("copies")).alias("_times")).where("_times > 0")
    names = {x: c.free_name(docs, x) for x in ("_digest",)}
    rows = docs.withColumn(names["_digest"], F.unhex(F.sha2(F.col(text), 256))).dropDuplicates([id, source, names["_digest"]])
    met = rows.join(times, F.col(id).eqNullSafe(F.col("_i")) & F.col(source).eqNullSafe(F.col("_s")) & F.col(names["_digest"]).eqNullSafe(F.col("_d")))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).select(*docs.columns)
