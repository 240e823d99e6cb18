"""Removal of repeated items: exact keys, seen keys, and near-equal headlines of one day."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import tiles
from tessera.tables import dropped, stored

RATIO = 0.94


def unseen(items: DataFrame, seen: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Items whose key isn't in ``seen``; a null key is never seen."""
    return items.join(seen.select(key), key, "left_anti")


def first_arrivals(items: DataFrame, key: str = "event_key", order: str = "item_id") -> DataFrame:
    """The first row of each key, with what its copies add: ``n_copies``, and the other sources in order of arrival.

    A row for each key and source first, with partial aggregation before its shuffle, so that a key's rows never meet in one list:
    what is gathered is one entry for each source. The copies' links are rows, see ``duplicate_links``.
    """
    cols = [c for c in items.columns if c != key]
    each = items.groupBy(key, F.col("source_id").alias("_source")).agg(F.min(order).alias("_at"), F.min_by(F.struct(*cols), order).alias("_first"), F.count("*").alias("_n"))
    told = F.array_sort(F.collect_list(F.when(F.col("_source").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_source").alias("source")))))
    grouped = each.groupBy(key).agg(F.min_by("_first", "_at").alias("first"), F.sum("_n").alias("n_rows"), told.alias("told"))
    sources = F.array_compact(F.transform("told", lambda x: F.when(~x["source"].eqNullSafe(F.col("first.source_id")), x["source"])))
    return grouped.select(key, "first.*", (F.col("n_rows") - 1).alias("n_copies"), sources.alias("duplicate_sources"))


def duplicate_links(items: DataFrame, key: str = "event_key", order: str = "item_id", url: str = "url") -> DataFrame:
    """``key``, ``url``, ``arrived``: each other link of a key's copies, with the first of them that had it; ``arrived`` gives their order."""
    links = items.where(F.col(url).isNotNull()).groupBy(key, F.col(url).alias("url")).agg(F.min(order).alias("arrived"))
    first = items.groupBy(key).agg(F.min_by(url, order).alias("_own"))
    return links.join(first, key).where(~F.col("url").eqNullSafe(F.col("_own"))).select(key, "url", "arrived")


def near_titles(items: DataFrame, ratio: float = RATIO, order: str = "item_id") -> DataFrame:
    """Pairs (later, earlier) of one day whose headlines have at least this similarity ratio.

    Headlines count from six words and 30 characters. They meet in tiles of a day
    and a band of lengths (see ``tiles``), which a band spans by doubling; a headline
    whose length a shorter band's may come near to is dealt to that band as well.
    No join is left for the driver to broadcast: a pair is a row once it is near.
    """
    w = t.words(F.col("title"))
    base = items.select(F.col(order).alias("id"), F.to_date("published_at").alias("day"), F.concat_ws(" ", w).alias("norm"), F.size(w).alias("n"), F.length(F.concat_ws("", w)).alias("solid"))
    base = stored(base.where((F.col("n") >= 6) & (F.col("solid") >= 30)).select("id", "day", "norm"), "headlines")
    size = F.length("norm")
    band = lambda n: F.floor(F.log2(n)).cast("int")
    near = base.withColumn("own", band(size)).withColumn("band", F.explode(F.array_distinct(F.array("own", band(size * (ratio / (2 - ratio)) * (1 - 1e-9))))))
    return tiles.tiled(base.withColumn("band", band(size)), near, ["day", "band"], partial(_near_of_tile, ratio), "later bigint, earlier bigint")


def _trigrams(texts: list[str], places: int) -> np.ndarray:
    """How many trigrams of each text fall on each of so many places."""
    out = np.zeros((len(texts), places), dtype=np.int16)
    for k, x in enumerate(texts):
        c = np.frombuffer(x.encode(), dtype=np.uint8).astype(np.uint32)
        grams = ((c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]) * np.uint32(2654435761)
        out[k] = np.minimum(np.bincount((grams >> np.uint32(12)) & np.uint32(places - 1), minlength=places), 8000)
    return out


def _near_of_tile(ratio: float, key: tuple, a: pa.Table, b: pa.Table) -> Iterator[dict]:
    """Near pairs of two parts of a band, each pair of one band once.

    At that ratio at most (1 - r) of both lengths are inserted or deleted, each of
    which changes five trigrams at most: how trigrams fall on a few places, and
    then on more of them, tells most pairs apart before the ratio itself.
    """
    order = np.argsort(np.asarray([len(x) for x in b.column("norm").to_pylist()]), kind="stable")
    b = b.take(order)
    texts_a, texts_b = a.column("norm").to_pylist(), b.column("norm").to_pylist()
    ids_a, ids_b = a.column("id").to_numpy(), b.column("id").to_numpy()
    same = b.column("own").to_numpy() == key[1].as_py()
    sizes_b = np.asarray([len(x) for x in texts_b])
    places = int(min(4096, max(256, 1 << int(2 * max(map(len, texts_a))).bit_length())))
    fine_a, fine_b = _trigrams(texts_a, places), _trigrams(texts_b, places)
    coarse_a, coarse_b = (x.reshape(len(x), 4, places // 4).sum(1, dtype=np.int16) for x in (fine_a, fine_b))
    for i, x in enumerate(texts_a):
        lo, hi = np.searchsorted(sizes_b, [len(x) * ratio / (2 - ratio) - 1e-6, len(x) * (2 - ratio) / ratio + 1e-6], side="left")
        js = lo + np.flatnonzero(~same[lo:hi] | (ids_b[lo:hi] > ids_a[i]))
        most = 5 * ((1 - ratio) * (len(x) + sizes_b) + 1e-9)
        for mine, theirs in ((coarse_a[i], coarse_b), (fine_a[i], fine_b)):
            js = np.concatenate([part[np.abs(theirs[part] - mine).sum(1, dtype=np.int32) <= most[part]] for part in np.array_split(js, max(1, len(js) * places >> 22))])
        for j in js:
            one, two = sorted(((int(ids_a[i]), x), (int(ids_b[j]), texts_b[j])))
            if t.ratio(two[1], one[1], ratio) >= ratio:
                yield {"later": two[0], "earlier": one[0]}


def greedy(items: DataFrame, pairs: DataFrame, order: str = "item_id") -> DataFrame:
    """Each id, and whether it is kept when rows are taken in order and one near to a kept one goes.

    A row stays once all its earlier neighbours went, and goes once one of them
    stays; only rows with neighbours take part, and each round decides the
    first undecided row of every chain at least.
    """
    # states grow with the pairs: their joins are merged, so that none goes through the driver
    edges = stored(pairs, "near")
    nodes = stored(edges.select(F.col("later").alias("id")).union(edges.select("earlier")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "nodes")
    while True:
        known = edges.join(nodes.select(F.col("id").alias("earlier"), F.col("kept").alias("k")).hint("merge"), "earlier")
        said = known.groupBy(F.col("later").alias("id")).agg(F.max(F.coalesce("k", F.lit(False))).alias("hit"), F.max(F.col("k").isNull()).alias("open"))
        turn = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        last, nodes = nodes, stored(nodes.join(said.hint("merge"), "id", "left").select("id", turn.alias("kept")), "nodes")
        dropped(last)
        if nodes.where("kept IS NULL").isEmpty():
            dropped(edges)
            break
    return items.select(F.col(order).alias("id")).join(nodes.hint("merge"), "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def reconsidered(items: DataFrame, cards: DataFrame, fresh: DataFrame, gate: int, now: F.Column, hours: int = 72, days: int = 14) -> DataFrame:
    """Known items that now reach the gate and did not before: seen within ``hours``, not older than ``days``, not fresh themselves; the best first, of equal ones the latest."""
    before = cards.select("item_id", F.col("score").alias("score_before"), "last_seen")
    recent = F.unix_timestamp("last_seen") >= F.unix_timestamp(now) - hours * 3600
    young = F.coalesce(F.unix_timestamp("published_at") >= F.unix_timestamp(now) - days * 86400, F.lit(True))
    found = items.join(before, "item_id").where((F.col("score_before") < gate) & (F.col("score") >= gate) & recent & young)
    found = found.join(fresh.select("item_id"), "item_id", "left_anti").join(fresh.select("event_key").distinct(), "event_key", "left_anti")
    return found.orderBy(F.desc("score"), F.desc("published_at"), F.lower("title"), "item_id")


def newest(rows: DataFrame, n: int, order: str, tie: str, by: str | None = None) -> DataFrame:
    """The n newest rows of the table, or of each key; the tie column makes the order total."""
    if by is None:
        return rows.orderBy(F.desc(order), F.desc(tie)).limit(n)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie)))
    return rows.withColumn("_rank", rank).where(f"_rank <= {n}").drop("_rank")
