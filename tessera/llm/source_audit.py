"""How far the sources of a language differ in their use of words: source by source, and the words that mark each.

Words are counted a block of texts at a time and summed by (language, source,
word); words in few documents of their language go. What is left becomes tiles,
dense int64 matrices of sources by words: a tile holds about ``WORDS`` words of
one language, chosen by hash, and the sources of one or two classes of about
``SOURCES``, also by hash, so that no tile grows with the input and every pair of
sources meets in one tile for each class of words. A tile broadcasts each of its
sources against all others and sums over its words; the partial matrices of all
tiles are added. It also keeps each source's highest words; those heaps are
merged in a tree, cut to their length before and after the shuffle.

A source's share of a word is an integer: 1 + floor(``UNIT`` (count + 5) / (N + 5 V)),
N being all counts of the source and V the number of words. A word that a source
does not have still has a share there, the same for all such words: pairs are
summed as their differences from it, which is added V times.

Defined results: null texts, languages and sources are empty strings, which is a
language or source as any other; a text without words still makes its source
occur; each row is a document, so repeated rows count again; a language without
kept words has differences of 0 and no words; a table without rows gives none.
Equal values are in order of the UTF-8 bytes of the item. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as c

#: A word is kept in a language with so many documents of it; a report has so many words a source.
LEAST, TOP = 30, 50
SMOOTH, UNIT = 5, 1_000_000_000
#: About so many words and sources of a class in a tile: 64 x 128 numbers, twice as many sources where two classes meet.
WORDS, SOURCES = 128, 64
#: Text counted at once in a task.
COUNTED = 8 << 20
#: [^\x00-\x40\x5B-\x60\x7B-\x7F] of lower-cased text: letters and all beyond ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


def counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (documents with it), for each block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in c.blocks(batch, "text", COUNTED):
                low = c.ASCII_LOWER[data]
                starts, ends, firsts = c.word_spans(low, offsets, LETTER)
                if len(starts) == 0:
                    continue
                at = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(ends - starts, out=at[1:])
                words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low[LETTER[low]])).dictionary_encode()
                langs, sources = (part.column(k).dictionary_encode() for k in ("lang", "source"))
                n_terms, n_sources = len(words.dictionary), len(sources.dictionary)
                in_doc, n = np.unique(np.repeat(np.arange(part.num_rows), np.diff(firsts)) * n_terms + words.indices.to_numpy(), return_counts=True)
                group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
                cells, where = np.unique(group[in_doc // n_terms] * n_terms + in_doc % n_terms, return_inverse=True)
                total = np.zeros(len(cells), np.int64)
                np.add.at(total, where, n)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(cells // n_terms // n_sources)), sources.dictionary.take(pa.array(cells // n_terms % n_sources)), words.dictionary.take(pa.array(cells % n_terms)).cast(pa.string()), pa.array(total), pa.array(np.bincount(where, minlength=len(cells)))],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return c.batched(docs, run, "lang string, source string, term string, n bigint, docs bigint")


def _share(count: Column, total: Column, n_words: Column) -> Column:
    """Exact: the product is a decimal."""
    whole = lambda x: x.cast("decimal(20,0)")
    product = F.lit(UNIT).cast("decimal(10,0)") * whole(F.coalesce(count, F.lit(0)) + SMOOTH)
    return F.when(n_words > 0, F.call_function("div", product, whole(total + SMOOTH * n_words)) + 1)


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """One tile: rows without a term are its sources, the others its cells. Gives the pairs' partial sums and each source's highest words."""
    lang, words_class, a, b = (x.as_py() for x in key)
    is_cell = table.column("term").is_valid()
    head, cells = table.filter(pa.compute.invert(is_cell)), table.filter(is_cell)
    head = head.sort_by("source")
    sources, terms = head.column("source").combine_chunks(), cells.column("term").unique().sort()
    rare, side = (head.column(k).to_numpy() for k in ("p", "side"))
    row, column = pa.compute.index_in(cells.column("source"), sources).to_numpy(), pa.compute.index_in(cells.column("term"), terms).to_numpy()
    p, q = cells.column("p").to_numpy(), cells.column("q").to_numpy()
    shares = np.repeat(rare[:, None], len(terms), axis=1)
    shares[row, column] = p

    apart = np.abs(rare[:, None] - rare)
    sums = np.abs(shares[:, None] - shares).sum(axis=2) - len(terms) * apart
    if words_class == 0:
        sums += head.column("n_words")[0].as_py() * apart
    x, y = np.triu_indices(len(sources), 1)
    if a != b:
        both = side[x] != side[y]
        x, y = x[both], y[both]
    if words_class:
        has = sums[x, y] != 0
        x, y = x[has], y[has]
    found = [(pa.array(["pair"] * len(x), pa.string()), sources.take(pa.array(x)), sources.take(pa.array(y)), pa.array(sums[x, y], pa.int64()))]

    if a == b:
        marks = np.flatnonzero(p > q)
        order = marks[np.lexsort((column[marks], q[marks] - p[marks], row[marks]))]
        _, begins, n = np.unique(row[order], return_index=True, return_counts=True)
        order = order[c.ranges(begins, np.minimum(n, TOP))]
        found.append((pa.array(["term"] * len(order), pa.string()), sources.take(pa.array(row[order])), terms.take(pa.array(column[order])), pa.array(p[order] - q[order], pa.int64())))
    kind, source, item, value = (pa.concat_arrays([y.cast(t) for y in x]) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True))
    return pa.table({"part": kind, "lang": pa.array([lang] * len(kind), pa.string()), "source": source, "item": item, "value": value})


def _first(x: list, y: list) -> list:
    return list(islice(merge(x, y), TOP))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: for each source of a language all others (part ``pair``) and its first marking words (``term``)."""
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(y) for x, y in ((lang, "lang"), (source, "source"), (text, "text"))])
    totals = c.stored(counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = totals.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= LEAST).drop("docs")
    cells = c.stored(totals.drop("docs").join(kept, ["lang", "term"]), "kept-cells")

    # a row for each source of a language
    groups = docs.select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_words"), F.sum("n_lang").alias("total_lang"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(langs, "lang", "left")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_cells"))
    none = lambda k: F.coalesce(k, F.lit(0).cast("bigint")).alias(k)
    groups = c.stored(groups.join(langs, "lang").join(sums, ["lang", "source"], "left").select("lang", "source", "n_sources", *map(none, ("n_words", "total_lang", "total", "n_cells"))), "sources")

    met = c.joined(cells, groups, ["lang", "source"], "n_cells")
    word_classes, source_classes = (F.greatest(F.lit(1), F.ceil(F.col(k) / most)).cast("int") for k, most in (("n_words", WORDS), ("n_sources", SOURCES)))
    side = F.pmod(F.xxhash64("source"), source_classes).cast("int")
    cell_rows = met.select("lang", F.pmod(F.xxhash64("term"), word_classes).cast("int").alias("w"), "source", side.alias("side"), source_classes.alias("classes"), "n_words", "term", _share(F.col("n"), F.col("total"), F.col("n_words")).alias("p"), _share(F.col("n_lang"), F.col("total_lang"), F.col("n_words")).alias("q"))
    rare = F.coalesce(_share(F.lit(0), F.col("total"), F.col("n_words")), F.lit(0))
    head_rows = groups.select("lang", F.explode(F.sequence(F.lit(0), word_classes - 1)).alias("w"), "source", side.alias("side"), source_classes.alias("classes"), "n_words", F.lit(None).cast("string").alias("term"), rare.alias("p"), F.lit(None).cast("bigint").alias("q"))
    dealt = cell_rows.unionByName(head_rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("classes") - 1)))
    dealt = dealt.select("lang", "w", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "source", "side", "n_words", "term", "p", "q")
    found = c.stored(dealt.groupBy("lang", "w", "a", "b").applyInArrow(_tile, "part string, lang string, source string, item string, value bigint"), "tiles")
    for table in (totals, cells, groups):
        c.dropped(table)

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", turned.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    heaps = found.where("part = 'term'").select("lang", "source", "item", "value").rdd.map(lambda r: ((r.lang, r.source), [(-r.value, r.item)])).reduceByKey(_first)
    terms = spark.createDataFrame(heaps.flatMap(lambda x: [(*x[0], "term", item, -value, k) for k, (value, item) in enumerate(x[1], 1)]), pairs.schema)
    return pairs.unionByName(terms)
