"""Language-model scoring with Brown class-based bigrams.

Counts: every training text's words (and one end for each text) are counted,
all of them, by an aggregation with map-side combine. Every word seen in
training gets a class; the number of classes grows with the cube root of the
number of words. Words that make up at least ``BROADCAST_RATE`` of the tokens
(at most 1 / ``BROADCAST_RATE`` of them) are broadcast with their classes; the
classes of all others are a table that is joined to their tokens.

Clustering is the exchange algorithm in its distributed form (Uszkoreit and
Brants, 2008). Frequent words: a pass over all training texts counts, for each
word, the classes of its neighbours; then each word, independently of the
others, is moved to the class that raises the bigram likelihood most. Half of
the words may move in a round, so that two words do not swap past one another;
rounds go on until the words that move have less than ``FEW`` of the tokens, or
``ROUNDS`` are done. Then the rare words are placed in the same way, all of them in
each of ``RARE_ROUNDS`` rounds, by the classes of their frequent neighbours; until
they have settled, rare neighbours count as one class.

Score: P(word | previous) = MIX * P(class | previous class) * P(word | class) +
(1 - MIX) * P1(word), P1 the add-one unigram of the base score. An unseen word
has count 0 in P1 and is all of the class that no seen word is in. What a rare
word takes part in (its own term and the next word's) is added up after its
class and count are joined to its tokens.

Defined results: a null or empty text is one end; without training texts every
count is 0 and all words are unseen; rows with the same id are scored each by
its own text; a null id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

#: Words at least this frequent are broadcast (at most 1 / BROADCAST_RATE words).
BROADCAST_RATE = 1e-6
#: Classes at least; more by the cube root of the number of words.
CLASSES = 64
#: Rounds of frequent words go on while words with this share of the tokens move, and stop at ROUNDS; rare words have RARE_ROUNDS.
FEW = 0.01
ROUNDS, RARE_ROUNDS = 6, 2
#: Neighbours counted in one piece, cells of class likelihoods at once, and buckets that words are dealt to.
CODES, CELLS, BUCKETS = 4 << 20, 1 << 20, 256
#: Cells of at least so many neighbours add to the likelihood exactly.
HEAVY = 6
MIX = 0.95
ADD = 0.5
#: The end of a text, in place of a word's hash.
END = np.uint64(0xE17D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document, each document closed by END, and offsets."""
    low = c.ASCII_LOWER[data]
    starts, ends, firsts = c.word_spans(low, offsets, c.NOT_SPACE)
    words = c.span_hashes(low, starts, ends)
    n = len(offsets) - 1
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(firsts))] = words
    return out, firsts + np.arange(n + 1)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash as bigint), n: over all texts, ends among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            found, often = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(c.as_int64(found)), pa.array(often, pa.int64())], ["word", "n"])

        for batch in batches:
            for _, data, offsets in c.blocks(batch, "text"):
                held.append(tokens(data, offsets)[0])
                size += len(held[-1])
                if size >= CODES:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return c.batched(texts, run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The frequent words by hash; index ``size`` is any other word, ``size + 1`` the end."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.size = len(words)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.size, np.int64)
        if self.size:
            at = np.minimum(np.searchsorted(self.words, hashes), self.size - 1)
            out = np.where(self.words[at] == hashes, at, out)
        out[hashes == END] = self.size + 1
        return out


def encoded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """ids: the vocabulary's index of every token of a text, in order."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in c.blocks(batch, "text"):
                hashes, at = tokens(data, offsets)
                yield pa.RecordBatch.from_arrays([c.nested(pa.array(sent.value.index(hashes), pa.int32()), np.diff(at))], ["ids"])

    return c.batched(texts, run, "ids array<int>")


def moved(ids: DataFrame, vocabulary: Vocabulary, classes: np.ndarray, bigrams: np.ndarray, movable: int, part: int) -> np.ndarray:
    """One round: the words of this half, each moved to its best class.

    Each task counts the cells w * 2m + k (w has a word of class k to its right) and w * 2m + m + k (to its left) of its
    texts and sends them to the words' buckets, as a few long rows; a bucket adds them up and picks the classes.
    """
    m = len(bigrams)
    own = np.append(vocabulary.words % np.uint64(2) == part, [False, False])
    sent = ids.sparkSession.sparkContext.broadcast((classes, own, bigrams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_of, mine, _ = sent.value
        held, size = [], 0

        def dealt() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = cell // (2 * m) % BUCKETS
            order = np.argsort(bucket.astype(np.uint16), kind="stable")
            sizes = np.bincount(bucket, minlength=BUCKETS)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), c.nested(pa.array(cell[order]), sizes), c.nested(pa.array(n[order].astype(np.int32)), sizes)], ["bucket", "cells", "n"])

        for batch in batches:
            w = np.append(len(kinds_of) - 1, batch.column("ids").flatten().to_numpy()).astype(np.int64)
            kinds = kinds_of[w]
            right, left = np.flatnonzero(mine[w[:-1]]), np.flatnonzero(mine[w[1:]])
            held += [w[right] * (2 * m) + kinds[right + 1], w[left + 1] * (2 * m) + m + kinds[left]]
            size += len(right) + len(left)
            if size >= CODES:
                yield dealt()
                held, size = [], 0
        if size:
            yield dealt()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_of, _, matrix = sent.value
        cells, counts, held = [], [], 0
        total = np.zeros(0, np.int64), np.zeros(0)

        def summed() -> tuple[np.ndarray, np.ndarray]:
            cell, at = np.unique(np.concatenate([total[0], *cells]), return_inverse=True)
            return cell, np.bincount(at, weights=np.concatenate([total[1], *counts]), minlength=len(cell))

        for batch in batches:
            cells.append(batch.column("cells").flatten().to_numpy())
            counts.append(batch.column("n").flatten().to_numpy())
            held += len(cells[-1])
            if held >= CODES:
                total, cells, counts, held = summed(), [], [], 0
        cell, n = summed()
        words, of = np.unique(cell // (2 * m), return_inverse=True)
        best = best_classes(kinds_of[words], of, cell % (2 * m), n, matrix, movable)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(best, pa.int32())], ["w", "class"])

    dealt = c.batched(ids, count, "bucket int, cells array<bigint>, n array<int>").repartition("bucket")
    rows = c.batched(dealt, pick, "w bigint, class int").toArrow()
    out = classes.copy()
    out[rows["w"].to_numpy()] = rows["class"].to_numpy()
    return out


def _matrix(cells: DataFrame, n_classes: int) -> np.ndarray:
    """The n_classes**2 sums of rows (cell, n)."""
    out = np.zeros(n_classes * n_classes)
    for row in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row.cell] = row.n
    return out.reshape(n_classes, n_classes)


def class_bigrams(ids: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """The matrix of class bigrams: n_classes**2 numbers, summed by Spark."""
    sent = ids.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes * n_classes, np.int64)
        for batch in batches:
            kinds = sent.value[np.append(len(sent.value) - 1, batch.column("ids").flatten().to_numpy())]
            total += np.bincount(kinds[:-1] * n_classes + kinds[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return _matrix(c.batched(ids, run, "cell bigint, n bigint"), n_classes)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(own: np.ndarray | None, word: np.ndarray, slot: np.ndarray, n: np.ndarray, bigrams: np.ndarray, movable: int, words: int | None = None) -> np.ndarray:
    """The class in which each word raises the likelihood most; its own if none does better. Without ``own`` the words are in no class yet.

    Cells (word, slot, n), sorted by word: n words of class ``slot`` to its right, or of ``slot`` - m to its left.
    What a cell of under ``HEAVY`` adds is taken as linear in n, which makes it a product of matrices.
    """
    m = len(bigrams)
    words = len(own) if own is not None else words
    out = np.empty(words, np.int64)
    first = np.searchsorted(word, np.arange(words + 1))
    rows, columns = bigrams.sum(axis=1), bigrams.sum(axis=0)
    slope = np.log(bigrams + np.exp(-1)) + 1
    step = max(1, CELLS // m)
    for lo in range(0, words, step):
        hi = min(lo + step, words)
        part, w = slice(first[lo], first[hi]), word[first[lo] : first[hi]] - lo
        count = hi - lo
        dense = np.bincount(w * (2 * m) + slot[part], weights=n[part], minlength=count * 2 * m).reshape(count, 2, m)
        right, left = dense[:, 0], dense[:, 1]
        gain = right @ slope.T + left @ slope
        for side, table, linear in ((0, bigrams.T, slope.T), (1, bigrams, slope)):
            i, s = np.nonzero(dense[:, side] >= HEAVY)
            x = dense[i, side, s][:, None]
            if len(i):
                more = _f(table[s] + x) - _f(table[s]) - x * linear[s]
                at = np.flatnonzero(np.diff(i, prepend=-1))
                gain[i[at]] += np.add.reduceat(more, at)
        total = right.sum(axis=1)[:, None], left.sum(axis=1)[:, None]
        gain -= _f(rows + total[0]) - _f(rows) + _f(columns + total[1]) - _f(columns)
        best = gain[:, :movable].argmax(axis=1)
        if own is not None:
            # in its own class the word is taken out first
            mine, at = own[lo:hi], np.arange(count)
            kept = np.zeros(count)
            for base, x, sums in ((bigrams[mine], right, rows), (bigrams.T[mine], left, columns)):
                here = sums[mine]
                kept += (_f(base) - _f(np.maximum(base - x, 0))).sum(axis=1) - _f(here) + _f(np.maximum(here - x.sum(axis=1), 0))
            best = np.where(gain[at, best] > kept + 1e-9, best, mine)
        out[lo:hi] = best
    return out


def rare_contexts(texts: DataFrame, vocabulary: Vocabulary, classes: np.ndarray, n_classes: int) -> DataFrame:
    """word (hash), code (class to its right * m + class to its left), next (the word to its right, if that is rare too), n: of every rare word."""
    sent = texts.sparkSession.sparkContext.broadcast((vocabulary, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = sent.value
        for batch in batches:
            for _, data, offsets in c.blocks(batch, "text"):
                hashes = tokens(data, offsets)[0]
                ids = words.index(hashes)
                kinds = np.append(own[ids], n_classes - 1)
                at = np.flatnonzero(ids == words.size)
                # the last token is an end, so at + 1 is a token; before the first stands kinds[-1], an end
                code, both = kinds[at + 1] * n_classes + kinds[at - 1], ids[at + 1] == words.size
                follower = pa.array(c.as_int64(hashes[at + 1]), mask=~both)
                yield pa.RecordBatch.from_arrays([pa.array(c.as_int64(hashes[at])), pa.array(code, pa.int32()), follower], ["word", "code", "next"])

    return c.batched(texts, run, "word bigint, code int, next bigint")


def placed(contexts: DataFrame, bigrams: np.ndarray, movable: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """word, class, n of the rare words, exchanged among the classes; and the class bigrams then.

    Until they have settled, rare neighbours count as one class, ``movable``. The frequent words' bigrams place the rare
    ones first; each further round has the bigrams of where they then are.
    """
    m = len(bigrams)
    spark = contexts.sparkSession
    schema = "word bigint, class int, n bigint, codes array<int>"
    frequent = bigrams.copy()
    frequent[movable] = frequent[:, movable] = 0

    def passed(rows: DataFrame, matrix: np.ndarray, settled: bool, last: bool) -> tuple[DataFrame, np.ndarray, DataFrame]:
        """Every word in its best class; the bigrams of where they are; and the table of both."""
        sent = spark.sparkContext.broadcast(matrix)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(m * m, np.int64)
            for batch in batches:
                codes = batch.column("codes")
                sizes = codes.value_lengths().to_numpy().astype(np.int64)
                of, code = np.repeat(np.arange(len(sizes)), sizes), codes.flatten().to_numpy().astype(np.int64)
                right, left = code // m, code % m
                word, slot = np.repeat(of, 2), np.stack([right, left + m], axis=1).reshape(-1)
                own = batch.column("class").to_numpy(zero_copy_only=False).astype(np.int64) if settled else None
                found = best_classes(own, word, slot, np.ones(len(slot)), sent.value, movable, len(sizes))
                if own is None:
                    # words that stand where no class does are dealt out
                    dealt = c.mixed(batch.column("word").to_numpy().view(np.uint64)) % np.uint64(movable)
                    seen = (sent.value[:movable] > 0).any(axis=0)[right] | (sent.value[:, :movable] > 0).any(axis=1)[left]
                    known = np.logical_or.reduceat(seen, np.cumsum(sizes) - sizes)
                    found = np.where(known, found, dealt.astype(np.int64))
                now = found[of]
                total += np.bincount(now * m + right, minlength=m * m) + np.bincount(left * m + now, minlength=m * m)
                kept = pa.nulls(len(sizes), pa.list_(pa.int32())) if last else codes.cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found, pa.int32()), pa.array(sizes), kept], ["word", "class", "n", "codes"])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(total[at]), pa.nulls(len(at), pa.list_(pa.int32()))], ["word", "class", "n", "codes"])

        out = c.stored(c.batched(rows.select("word", "class", "codes"), run, schema), "rare")
        return out.where("word IS NOT NULL"), _matrix(out.where("word IS NULL").select(F.col("class").alias("cell"), "n"), m), out

    # a rare word has less than BROADCAST_RATE of all tokens, so no list is longer than that
    lists = contexts.groupBy("word").agg(F.collect_list("code").alias("codes")).withColumn("class", F.lit(None).cast("int"))
    rare, cells, held = passed(lists, frequent, False, rounds == 1)
    for k in range(1, rounds):
        before = held
        rare, cells, held = passed(rare, frequent + cells, True, k == rounds - 1)
        c.dropped(before)
    rare = rare.select("word", "class", "n")
    # bigrams of two rare words
    pairs = contexts.where("next IS NOT NULL").groupBy("word", "next").agg(F.count("*").alias("n"))
    of_pairs = pairs.join(rare.select("word", F.col("class").alias("a")), "word").join(rare.select(F.col("word").alias("next"), F.col("class").alias("b")), "next")
    cells[movable] = cells[:, movable] = 0
    return rare, frequent + cells + _matrix(of_pairs.select((F.col("a") * m + F.col("b")).alias("cell"), "n"), m)


class Model:
    """Classes, their bigrams and the counts of frequent words; class m - 2 is that of unseen words, m - 1 that of ends."""

    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray, bigrams: np.ndarray, total: int, distinct: int) -> None:
        m = len(bigrams)
        self.vocabulary, self.classes = vocabulary, classes
        self.total, self.distinct = total, distinct
        self.move = (bigrams + ADD) / (bigrams.sum(axis=1, keepdims=True) + ADD * m)
        #: tokens of each class; every token follows another, or the end before a text
        self.sizes = np.maximum(bigrams.sum(axis=0), 1)
        self.ends = float(bigrams.sum(axis=0)[m - 1])
        self.counts = np.append(vocabulary.counts, [0, self.ends]).astype(np.float64)
        self.emit = np.append(vocabulary.counts / self.sizes[classes[: vocabulary.size]], [0.0, 1.0])
        self.unigram = 1.0 / (total + distinct + 1)

    def chance(self, before: np.ndarray, kinds: np.ndarray, emit: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of P(word | previous)."""
        return np.log10(MIX * self.move[before, kinds] * emit + (1 - MIX) * self.unigram * (counts + 1))

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """Per document: tokens, frequent ones, base and score without what rare words take part in; the rare words
        (hash, class to the left and index to the right, -1 for a rare one) and how many each document has."""
        hashes, at = tokens(data, offsets)
        ids = self.vocabulary.index(hashes)
        rare = ids == self.vocabulary.size
        kinds, counts = self.classes[ids], self.counts[ids]
        before = np.concatenate([[len(self.move) - 1], kinds[:-1]])
        before[at[:-1]] = len(self.move) - 1
        after_rare = np.concatenate([[False], rare[:-1]])
        base = np.where(rare, 0.0, np.log10(self.unigram * (counts + 1)))
        full = np.where(rare | after_rare, 0.0, self.chance(before, kinds, self.emit[ids], counts))
        sums = lambda x: np.add.reduceat(np.append(x, 0), at[:-1]) if len(at) > 1 else np.zeros(0)  # noqa: E731  every document has a token
        places = np.flatnonzero(rare)
        left = np.where(after_rare[places], -1, before[places])
        right = np.where(rare[places + 1], -1, ids[places + 1])
        return np.diff(at), sums((~rare).astype(np.int64)), sums(base), sums(full), places, hashes[places], left, right, np.diff(np.searchsorted(places, at))

    def rare_parts(self, left: np.ndarray, right: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each rare word adds to base and score; words in the order of their documents."""
        before = np.where(left >= 0, left, np.concatenate([[0], kinds[:-1]]))
        unseen = kinds == len(self.move) - 2
        own = self.chance(before, kinds, np.where(unseen, 1.0, counts / self.sizes[kinds]), counts)
        after = self.chance(kinds, self.classes[right], self.emit[right], self.counts[right])
        return np.log10(self.unigram * (counts + 1)), own + np.where(right >= 0, after, 0.0)


def fit(texts: DataFrame, n_classes: int | None = None, rounds: int = ROUNDS, rate: float = BROADCAST_RATE) -> tuple[Model, DataFrame]:
    """A model from all rows of ``texts`` (column text), and the table of rare words: word, class, n."""
    counts = c.stored(word_counts(texts.select("text")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = counts.where((F.col("n") >= max(1.0, rate * total)) & (F.col("word") != int(END))).toArrow()
    vocabulary = Vocabulary(rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy())
    n_classes = n_classes or max(CLASSES, int(np.ceil(distinct ** (1 / 3))))
    m = n_classes + 2
    classes = np.empty(vocabulary.size + 2, np.int64)
    classes[np.argsort(-vocabulary.counts, kind="stable")] = np.arange(vocabulary.size) % n_classes
    classes[-2:] = n_classes, n_classes + 1
    ids = c.stored(encoded(texts.select("text"), vocabulary), "ids")
    changed = [total]
    for k in range(rounds):
        new = moved(ids, vocabulary, classes, class_bigrams(ids, classes, m), n_classes, k % 2)
        changed.append(int(vocabulary.counts[(new != classes)[: vocabulary.size]].sum()))
        classes = new
        # one round of either half
        if sum(changed[-2:]) < FEW * total:
            break
    bigrams = class_bigrams(ids, classes, m)
    c.dropped(ids)
    contexts = c.stored(rare_contexts(texts.select("text"), vocabulary, classes, m), "contexts")
    rare, bigrams = placed(contexts, bigrams, n_classes, RARE_ROUNDS)
    c.dropped(contexts)
    c.dropped(counts)
    return Model(vocabulary, classes, bigrams, int(total), int(distinct)), rare


def score(docs: DataFrame, model: Model, rare: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block, data, offsets in c.blocks(batch, "text"):
                n, known, base, full, places, words, left, right, often = sent.value.parts(data, offsets)
                each = pa.StructArray.from_arrays([pa.array(places, pa.int64()), pa.array(c.as_int64(words)), pa.array(left, pa.int32()), pa.array(right, pa.int32())], ["place", "word", "left", "right"])
                columns = [pa.array(np.arange(row, row + len(n))), block.column("key"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(full), c.nested(each, often)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "key", "n", "known", "base", "full", "rare"])
                row += len(n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column("rare")
            _, left, right, kinds, n = (x.to_numpy() for x in each.flatten().flatten())
            base, full = sent.value.rare_parts(left, right, kinds, n)
            first = np.concatenate([[0], np.cumsum(each.value_lengths().to_numpy())[:-1]]).astype(np.int64)
            sums = [pa.array(np.add.reduceat(x, first) if len(x) else x) for x in (base, full, (n > 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *sums], ["row", "more_base", "more", "found"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    # row numbers are made once and then read from the table
    schema = "row bigint, key bigint, n bigint, known bigint, base double, full double, rare array<struct<place:bigint,word:bigint,left:int,right:int>>"
    made = c.stored(c.batched(rows, run, schema), "scored")
    each = made.select("row", F.inline("rare")).join(rare, "word", "left")
    each = each.withColumns({"class": F.coalesce("class", F.lit(len(model.move) - 2)), "n": F.coalesce("n", F.lit(0))})
    lists = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "left", "right", "class", "n"))).alias("rare"))
    both = made.drop("rare").join(c.batched(lists, add, "row bigint, more_base double, more double, found bigint"), "row", "left")
    out = both.select(
        F.col("key").alias(key),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("full") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def class_words(texts: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """word, class, n: the words themselves, with their classes and counts."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in c.blocks(batch, "text"):
                low = c.ASCII_LOWER[data]
                starts, ends, _ = c.word_spans(low, offsets, c.NOT_SPACE)
                hashes, first = np.unique(c.span_hashes(low, starts, ends), return_index=True)
                ids = sent.value.vocabulary.index(hashes)
                frequent = ids < sent.value.vocabulary.size
                words = [low[starts[k] : ends[k]].tobytes().decode() for k in first.tolist()]
                columns = [pa.array(c.as_int64(hashes)), pa.array(words, pa.string()), pa.array(sent.value.classes[ids], pa.int32(), mask=~frequent), pa.array(sent.value.counts[ids].astype(np.int64), mask=~frequent)]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "word", "a", "m"])

    words = c.batched(texts.select("text"), run, "hash bigint, word string, a int, m bigint").distinct()
    known = words.join(rare.select(F.col("word").alias("hash"), "class", "n"), "hash", "left")
    return known.select("word", F.coalesce("a", "class").alias("class"), F.coalesce("m", "n").alias("n")).where("class IS NOT NULL")
