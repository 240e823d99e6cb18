"""Near-duplicate classes by DartMinHash and banded joining.

A document is a weighted set of word shingles. Its signature comes from darts
(Christiani, 2020): every element owns a region of the (weight, rank) plane, as
wide as its weight; a hash throws Poisson(1) darts into each unit cell of that
region, so two documents see the same darts wherever their regions overlap. Each
dart belongs to one of ``COORDINATES`` coordinates, and the earliest dart of a
coordinate, the one of lowest rank, is kept. Ranks are only looked at up to the
height that gives the darts needed to fill all coordinates, which costs time in
the number of elements plus darts, not their product; documents with an empty
coordinate get twice the height. Two signatures agree in a coordinate with the
probability of the (weighted) Jaccard similarity.

Classes: texts with equal shingle sets are one row first. Signatures are cut
into bands; in each bucket all members are paired with the bucket's smallest
member, pairs are verified on the whole shingle sets, and connected components
follow. Members that are still apart from their bucket's component are then
paired with a pivot, another member in each bucket, and what is apart after that
is paired with all others of the bucket and verified as well: no candidate link
between components is lost, while a large group of near copies, most of which
the centre or a pivot joins, never becomes all of its pairs. Before a pair is made, two bits of each coordinate are compared: a pair
of similarity 0.8 differs in 15 percent of them, and pairs that differ in over
``FAR`` standard deviations more are no candidates. At similarity 0.8 a pair
shares a bucket with probability 1 - (1 - 0.8**8)**60 and passes that test with
probability over 0.99998 each; above it, with more.

Defined results: a null or empty text has no shingles and is a class of its
own; a text of fewer than five words is one shingle; the class id is the
smallest id in the class; rows with the same id share a class, whatever their
texts; a null id has a null class; a table without rows gives none; extra columns
play no part. Of rows with one id ``keep_first`` keeps one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as c
from tessera.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 60, 8
COORDINATES = BANDS * ROWS
#: How many standard deviations beyond the mean a pair of just the wanted similarity may differ.
FAR = 4.2
#: Cells of the plane looked at together; bounds a worker's memory.
CELLS = 400_000
_U = np.uint64
#: Poisson(1) counts by the top 16 bits of a hash: shares of 1/e, 1/e, 1/2e, 1/6e, ...
_COUNTS = np.searchsorted(np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in order, how often each occurs, and offsets."""
    low = c.ASCII_LOWER[data]
    starts, ends, firsts = c.word_spans(low, offsets, c.NOT_SPACE)
    words = c.span_hashes(low, starts, ends)
    at, docs = c.within(firsts, size)
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    hashes = c.gram_hashes(words, at, size)
    for d in short.tolist():
        hashes = np.append(hashes, c.gram_hashes(words, firsts[d : d + 1], int(counts[d])))
    docs = np.append(docs, short)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    kept = np.flatnonzero(new)
    return hashes[kept], np.diff(np.append(kept, len(hashes))), np.searchsorted(docs[kept], np.arange(len(offsets)))


def darts(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, height: np.ndarray, best: np.ndarray) -> None:
    """Throw the darts of all elements up to their owners' heights; ``best[owner, coordinate]`` keeps the earliest."""
    k = best.shape[1]
    flat = best.reshape(-1)
    for level in range(int(np.log2(1 + weights.max(initial=0) - 1e-9)) + 1):
        # the part of each region with weights from 2**level - 1 to 2**(level + 1) - 1, in cells of area 1
        wide = np.flatnonzero(weights > (1 << level) - 1)
        cells = np.ceil(height[owner[wide]] * (1 << level)).astype(np.int64)
        done = 0
        sums = np.cumsum(cells)
        while done < len(wide):
            stop = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + CELLS, "right")))
            some, n = wide[done:stop], cells[done:stop]
            which = np.repeat(some, n)
            cell = c.ranges(np.zeros(len(n), np.int64), n)
            seed = c.mixed(elements[which] + (cell.astype(_U) * _U(64) + _U(level)) * _U(0xD1342543DE82EF95))
            count = _COUNTS[(seed >> _U(48)).astype(np.int64)]
            which, cell, seed = (np.repeat(x, count) for x in (which, cell, seed))
            dart = c.mixed(seed + (c.ranges(np.zeros(len(count), np.int64), count).astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
            rank = (cell + (dart & _U(0xFFFFFFFF)).astype(np.float64) / 2**32) / (1 << level)
            keep = rank < height[owner[which]]
            if level or weights.max() != 1:
                left = (c.mixed(dart) >> _U(11)).astype(np.float64) / 2**53
                keep &= (1 << level) - 1 + left * (1 << level) < weights[which]
            which, rank, dart = which[keep], rank[keep], dart[keep]
            place = owner[which] * k + ((dart >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
            # rank first, then bits of the dart that name it
            np.minimum.at(flat, place, (np.minimum(rank * 2**18, 2**44 - 1).astype(_U) << _U(20)) | (dart & _U(0xFFFFF)))
            done = stop


def signatures(elements: np.ndarray, weights: np.ndarray, at: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """A row of k kept darts for each document; documents without elements keep the largest number everywhere."""
    n = len(at) - 1
    best = np.full((n, k), np.iinfo(np.uint64).max, _U)
    total = np.add.reduceat(np.append(weights, 0).astype(np.float64), at[:-1]) if n else np.zeros(0)
    total[np.diff(at) == 0] = 0
    owner = np.repeat(np.arange(n), np.diff(at))
    height = np.where(total > 0, k * (log(k) + 2) / np.maximum(total, 1e-9), 0)
    open_ = np.flatnonzero(total > 0)
    while len(open_):
        mine = np.zeros(n, bool)
        mine[open_] = True
        pick = mine[owner]
        darts(elements[pick], weights[pick], owner[pick], height, best)
        open_ = open_[(best[open_] == np.iinfo(np.uint64).max).any(axis=1)]
        height[open_] *= 2
    return best


def wholes(hashes: np.ndarray, often: np.ndarray, at: np.ndarray, weighted: bool) -> np.ndarray:
    """A hash of each document's shingle set (with weights: of its multiset)."""
    sums = np.concatenate([[_U(0)], np.cumsum(c.mixed(hashes + often.astype(_U) * _U(weighted)))])
    return c.mixed(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(_U))


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One bucket for each band of each signature."""
    h = np.zeros((len(signature), bands), _U) + np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    cut = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        h = c.mixed(h + cut[:, :, r])
    return h


def two_bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to a number."""
    n, k = signature.shape
    bits = np.zeros((n, -(-k // 32) * 32), _U)
    bits[:, :k] = c.mixed(signature) & _U(3)
    return (bits.reshape(n, -1, 32) << (np.arange(32, dtype=_U) * _U(2))).sum(axis=2, dtype=_U)


def apart(coordinates: int, similarity: float) -> int:
    """In how many coordinates' two bits a candidate pair may differ at most."""
    share = (1 - similarity) * 3 / 4
    return int(coordinates * share + FAR * (coordinates * share * (1 - share)) ** 0.5)


def distance(a: str, b: str, numbers: int) -> F.Column:
    """In how many coordinates the two bits of arrays ``a`` and ``b`` differ."""
    out = F.lit(0)
    for k in range(numbers):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        out = out + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return out


def sketches(docs: DataFrame, key: str, text: str, bands: int, rows: int, weighted: bool) -> DataFrame:
    """Per document with shingles: doc, a hash of its shingle set, its buckets, two bits of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, offsets in c.blocks(batch, "text", 1 << 20):
                hashes, often, at = shingles(data, offsets)
                weights = often.astype(np.float64) if weighted else np.ones(len(often))
                kept = signatures(hashes, weights, at, bands * rows)
                buckets, bits = band_hashes(kept, bands, rows), two_bits(kept)
                whole = wholes(hashes, often, at, weighted)
                some = np.flatnonzero(np.diff(at) > 0)
                lists = [c.nested(pa.array(c.as_int64(x[some].reshape(-1))), np.full(len(some), x.shape[1])) for x in (buckets, bits)]
                yield pa.RecordBatch.from_arrays([block.column("doc").take(pa.array(some)), pa.array(c.as_int64(whole[some])), *lists], ["doc", "whole", "buckets", "bits"])

    picked = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    return c.batched(picked, run, "doc bigint, whole bigint, buckets array<bigint>, bits array<bigint>")


def shingle_sets(docs: DataFrame, weighted: bool) -> DataFrame:
    """Of rows (doc, whole, text) whose text has that hash: doc and its distinct shingles as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, offsets in c.blocks(batch, "text"):
                hashes, often, at = shingles(data, offsets)
                lists = c.nested(pa.array((hashes >> _U(32)).astype(np.uint32).view(np.int32)), np.diff(at))
                own = c.as_int64(wholes(hashes, often, at, weighted)) == block.column("whole").to_numpy()
                yield pa.RecordBatch.from_arrays([block.column("doc"), lists], ["doc", "grams"]).filter(pa.array(own))

    return c.batched(docs.select("doc", "whole", "text"), run, "doc bigint, grams array<int>").dropDuplicates(["doc"])


def with_sets(pairs: DataFrame, stored: DataFrame, sets: DataFrame, side: str, other: str, grams: str) -> DataFrame:
    """The pairs with the shingle sets of one side. A hot document's pairs (counted in ``stored``, a table of the same pairs) are dealt to several copies of its set, at most 2 / ``HOT_SHARE`` copies in all."""
    counts = c.stored(stored.groupBy(side).agg(F.count("*").alias("n")), "degrees")
    least = max(100, c.HOT_SHARE * (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    hot = F.broadcast(counts.where(F.col("n") >= least).select(side, F.ceil(F.col("n") / least).cast("int").alias("parts")))
    dealt = pairs.join(hot, side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = sets.select(F.col("doc").alias(side), F.col("grams").alias(grams)).join(hot, side, "left")
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies.hint("merge"), [side, "part"]).drop("part")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity; ``pairs`` is a stored table."""
    both = with_sets(with_sets(pairs, pairs, sets, "a", "b", "x"), pairs, sets, "b", "a", "y")
    shared = F.size(F.array_intersect("x", "y"))
    # at least `similarity`: shared / (|x| + |y| - shared), without dividing
    enough = shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9
    close = F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y")) - 1e-9
    return both.where(close).where(enough).select("a", "b")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """One row for each document: key, class_id (the smallest id of its class)."""
    made = c.stored(sketches(docs, key, text, bands, rows, weighted), "sketches")
    ids = c.stored(made.select("doc", "whole"), "ids")
    same = ids.groupBy("whole").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    # a distinct text goes by the first id that has it, so that it stands before its later copies; an id's further texts by their hashes
    owns = same.groupBy("first").agg(F.min("whole").alias("own"))
    same = c.stored(same.join(owns.hint("merge"), "first").select("whole", "first", "n", F.when(F.col("whole") == F.col("own"), F.col("first")).otherwise(F.col("whole")).alias("node")), "same")
    # both sides of these joins grow with the input at all sizes: no broadcast. From here on ``doc`` is a distinct text
    first = same.select("whole", F.col("first").alias("doc"), "node").hint("merge")
    texts = made.join(first, ["whole", "doc"]).dropDuplicates(["whole"]).select(F.col("node").alias("doc"), "buckets", "bits")
    texts = c.stored(texts, "texts")
    c.dropped(made)
    single = c.stored(texts.select("doc", F.explode("buckets").alias("bucket")), "buckets")
    least = single.groupBy("bucket").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("bucket", "least")
    members = c.stored(single.join(least.hint("merge"), "bucket").join(texts.select("doc", "bits").hint("merge"), "doc"), "members")
    c.dropped(single)
    wanted = members.select("doc").distinct().join(same.select(F.col("node").alias("doc"), "whole", F.col("first").alias("_first")), "doc")
    picked = docs.select(F.col(key).cast("bigint").alias("_first"), F.col(text).alias("text")).join(wanted.hint("merge"), "_first")
    sets = c.stored(shingle_sets(picked, weighted), "shingles")

    near = distance("bits", "bits_b", -(-bands * rows // 32)) <= apart(bands * rows, similarity)
    centres = members.where("doc = least").select("bucket", F.col("bits").alias("bits_b"))
    stars = members.where("doc != least").join(centres, "bucket").where(near).select(F.col("doc").alias("a"), F.col("least").alias("b")).distinct()
    stars = c.stored(stars, "stars")
    links = c.stored(verified(stars, sets, similarity), "verified")
    by_pivot = c.stored(pivot_pairs(named(members, components(links)), near).join(stars, ["a", "b"], "left_anti"), "by_pivot")
    links = c.stored(links.unionByName(verified(by_pivot, sets, similarity)), "verified")
    tried = stars.unionByName(by_pivot)
    crossed = c.stored(cross_pairs(named(members, components(links)), texts, tried, near), "crossed")
    links = links.unionByName(verified(crossed, sets, similarity))
    # of texts to documents: the first with each text, and its copies
    of = lambda x: same.select(F.col("node").alias(x), F.col("first").alias(f"{x}_doc")).hint("merge")
    near_links = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))
    copies = c.joined(ids, same.select("whole", "first", "n"), ["whole"]).where("doc != first").select(F.col("doc").alias("a"), F.col("first").alias("b"))
    final = components(near_links.unionByName(copies))
    own = docs.select(F.col(key))
    return own.join(final.select(F.col("id").alias(key), F.col("root")), key, "left").select(F.col(key), F.coalesce("root", F.col(key).cast("bigint")).alias("class_id"))


def named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets with their component's root, and whether it is another than that of the bucket's centre."""
    own = members.join(roots.withColumnRenamed("id", "doc"), "doc", "left").select("bucket", "doc", "least", "bits", F.coalesce("root", "doc").alias("root"))
    centre = roots.select(F.col("id").alias("least"), F.col("root").alias("centre"))
    return c.stored(own.join(centre, "least", "left").withColumn("out", F.col("root") != F.coalesce("centre", "least")), "named")


def pivot_pairs(members: DataFrame, near: F.Column) -> DataFrame:
    """Near pairs of each bucket's members with one pivot, another in each bucket, where their components differ."""
    pivots = members.groupBy("bucket").agg(F.max("out").alias("any"), F.min_by("doc", F.xxhash64("bucket", "doc")).alias("doc")).where("any").select("bucket", "doc")
    pivots = members.join(pivots, ["bucket", "doc"]).select("bucket", F.col("doc").alias("b"), F.col("root").alias("root_b"), F.col("bits").alias("bits_b"))
    pairs = members.select("bucket", F.col("doc").alias("a"), "root", "bits").join(pivots, "bucket").where("root != root_b").where(near)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def cross_pairs(members: DataFrame, texts: DataFrame, tried: DataFrame, near: F.Column) -> DataFrame:
    """Near pairs of one bucket whose members belong to different components and were not verified yet.

    A pair is made in the first bucket that its documents share, and in no other.
    """
    spots = members.where("out").select("bucket").distinct()
    lists = texts.select("doc", "buckets")
    live = members.join(spots.hint("merge"), "bucket", "left_semi").join(lists.hint("merge"), "doc").withColumn("band", F.expr("array_position(buckets, bucket)"))
    others = live.where("out").select("bucket", "band", F.col("doc").alias("a"), F.col("root").alias("root_a"), "bits", "buckets")
    every = live.select("bucket", F.col("doc").alias("b"), "root", "out", F.col("bits").alias("bits_b"), F.col("buckets").alias("buckets_b"))
    first_shared = F.expr("array_position(zip_with(buckets, buckets_b, (x, y) -> x = y), true) = band")
    pairs = others.join(every, "bucket").where("root_a != root AND (a > b OR NOT out)").where(near).where(first_shared)
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: the one whose id is the class id; of rows with that id one. Rows without an id stay."""
    name, own, n, rank = (c.free_name(docs, x) for x in ("class_id", "same_key", "n_rows", "rank"))
    found = classes(docs.where(F.col(key).isNotNull()), key, text)
    found = c.stored(found.groupBy(F.col(key).alias(own)).agg(F.first("class_id").alias(name), F.count("*").alias(n)), "classes")
    columns = [F.col(f"`{x}`") for x in docs.columns]
    joined = docs.join(found, F.col(key) == F.col(own), "left").where(F.col(key).isNull() | (F.col(name) == F.col(key)))
    kept = joined.where(F.coalesce(n, F.lit(1)) == 1).select(columns)
    if found.where((F.col(name) == F.col(own)) & (F.col(n) > 1)).isEmpty():
        return kept
    again = joined.where(F.col(n) > 1)
    first = F.row_number().over(Window.partitionBy(own).orderBy(text, F.xxhash64(*columns)))
    return kept.unionByName(again.withColumn(rank, first).where(F.col(rank) == 1).select(columns))


def brute_force(docs: list[tuple[int, str | None]], similarity: float = SIMILARITY) -> dict[int, int]:
    """All pairs, for tests."""
    sets = {}
    for d, t in docs:
        w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "").split()
        sets[d] = {tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    root = {d: d for d in sets}

    def top(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    return {d: top(d) for d in ids}
