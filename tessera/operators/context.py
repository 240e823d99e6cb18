"""Background for an item: curated records whose aliases it names, few and of different topics; earlier events; theses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import phrases
from tessera.functions import text as t
from tessera.operators import tiles

#: Aliases are looked up by so many of their first words; of longer ones the rest is compared.
MOST = 4
#: Characters of aliases that go to every worker.
SENT = 4 << 20


def matches(items: DataFrame, records: DataFrame) -> DataFrame:
    """(item, record, score): an alias occurs as whole words in title or summary.

    Aliases of ``SENT`` characters at most go to the workers as one automaton, and a text is read once. More of them are met
    by an equi-join on word sequences: the item's distinct runs of one to four words, those that open an alias, meet the
    first words of the aliases; a longer alias must then stand in the item as a whole.
    """
    alias = records.select("record_id", "topic", "date", "priority", F.explode(F.array_distinct("aliases")).alias("alias"))
    alias = alias.withColumn("w", t.words(F.col("alias"))).where(F.size("w") > 0).withColumns({"key": F.concat_ws(" ", F.slice("w", 1, MOST)), "whole": F.concat_ws(" ", F.lit(""), "w", F.lit("")), "size": F.size("w")}).drop("alias")
    weight = F.when(F.col("size") >= 2, 3 + F.least(F.lit(2), F.col("size") - 2)).otherwise(2)
    alias = alias.withColumn("weight", weight).drop("w")
    size = alias.agg(F.coalesce(F.sum(F.char_length("whole")), F.lit(0))).first()[0]
    hit = _sent(items, alias) if size <= SENT else _met(items, alias)
    hit = hit.groupBy("item_id", "record_id", "topic", "date", "priority").agg(F.sum("weight").alias("alias_score"))
    year = F.expr("try_cast(substring(date, 1, 4) AS int)")
    recency = F.coalesce(F.least(F.lit(6), F.greatest(F.lit(0), year - 2020)), F.lit(0))
    return hit.select("item_id", "record_id", "topic", "date", (F.col("alias_score") * 4 + F.col("priority") * 3 + recency).cast("bigint").alias("score"))


def _sent(items: DataFrame, alias: DataFrame) -> DataFrame:
    terms = tuple(sorted(r.a for r in alias.select(F.trim("whole").alias("a")).distinct().collect()))
    said = items.select("item_id", phrases.phrase_hits(F.concat_ws(" ", t.words(F.concat_ws(" ", "title", "summary"))), terms).alias("hits"))
    return said.select("item_id", F.explode("hits").alias("a")).join(alias.withColumn("a", F.trim("whole")), "a")


def _met(items: DataFrame, alias: DataFrame) -> DataFrame:
    sizes = F.array(*[F.lit(k) for k in range(1, MOST + 1)])
    text = items.select("item_id", t.words(F.concat_ws(" ", "title", "summary")).alias("w"))
    opens = alias.select(F.substring_index("key", " ", 1).alias("first")).distinct()
    runs = text.select("item_id", "w", F.explode(sizes).alias("n")).where(F.size("w") >= F.col("n"))
    runs = runs.select("item_id", F.explode(F.array_distinct(F.expr("transform(sequence(1, size(w) - n + 1), k -> concat_ws(' ', slice(w, k, n)))"))).alias("key"))
    runs = runs.withColumn("first", F.substring_index("key", " ", 1)).join(opens, "first", "left_semi").drop("first")
    n = F.col("size")
    found = runs.join(alias, "key")
    whole = text.select("item_id", F.concat_ws(" ", F.lit(""), "w", F.lit("")).alias("said"))
    held = found.where(n > MOST).alias("f").join(whole.alias("t"), (F.col("f.item_id") == F.col("t.item_id")) & F.contains("said", "whole"), "left_semi")
    return found.where(n <= MOST).unionByName(held)


def select(items: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """``item_id``, ``rank``, ``record_id``: the picks for each item. A first record of its topic counts 5 more, each later one 5 less for every one before it.

    Within a topic that order is that of the scores, so a record's worth follows from its place there, and the picks are the records of most worth.
    """
    order = lambda score: [F.desc(score), F.desc("date"), F.desc("record_id")]
    place = F.row_number().over(Window.partitionBy("item_id", "topic").orderBy(*order("score"))) - 1
    worth = matches(items, records).withColumn("place", place).where(f"place < {most}").withColumn("worth", F.col("score") + F.when(F.col("place") == 0, 5).otherwise(-5 * F.col("place")))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order("worth")))
    return worth.withColumn("rank", rank).where(f"rank <= {most}").select("item_id", "rank", "record_id")


def prior_events(items: DataFrame, events: DataFrame, most: int = 3) -> DataFrame:
    """``item_id``, ``rank``, ``event_id``, ``score``: earlier events of an entity of the item that share two more words with it.

    Both tables have ``tokens`` and ``entities``; events have ``date``. Score: three for each entity, one for each word; ties to the older.
    They meet in tiles of an entity, and a tile gives an item its best ones there.
    """
    none = F.lit(None).cast("string").alias("source_id")

    def keyed(rows: DataFrame, key: str, *more: F.Column) -> DataFrame:
        return rows.where(F.size("tokens") >= 2).select(F.col(key).alias("id"), none, F.concat_ws(" ", F.array_sort("tokens")).alias("row"), F.col("entities").alias("high"), F.explode(F.array_distinct("entities")).alias("entity"), *more)

    # an event without a date comes before others of its score
    dated = keyed(events, "event_id", F.coalesce(F.unix_date("date"), F.lit(-(1 << 31))).alias("day"))
    kind = lambda rows, key: rows.schema[key].dataType.simpleString()
    found = tiles.tiled(keyed(items, "item_id"), dated, ["entity"], lambda key, a, b: _best(tiles.Tile(key[0].as_py(), a, b), most), f"item_id {kind(items, 'item_id')}, event_id {kind(events, 'event_id')}, score int, day int")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "day", "event_id"))
    return found.withColumn("rank", rank).where(f"rank <= {most}").select("item_id", "rank", "event_id", "score")


def _best(tile: tiles.Tile, most: int) -> Iterator[dict]:
    """For each row of the left the best events of a tile; words of the shared entities' names don't count as common."""
    day, order = tile.b.column("day").to_numpy(), np.unique(tile.ids_b, return_inverse=True)[1]
    of: dict[str, list[str]] = {}
    for name in tile.names.names:
        for w in re.findall("[a-z0-9]+", name.lower()):
            of.setdefault(w, []).append(name)
    bits = {w: tile.names.bits(names) for w, names in of.items()}
    for u, row in tile.rows(lambda us, common, jaccard: np.ones(common.shape, dtype=bool), apart=False):
        texts, own = tile.of_b[row.others], np.zeros(len(row.others), dtype=np.int64)
        for w in tile.words_a[u]:
            if w in bits and w in tile.postings:
                has = np.zeros(len(tile.said_b), dtype=bool)
                has[tile.postings[w]] = True
                own += has[texts] & (row.shared & bits[w][:, None]).any(axis=0)
        good = np.flatnonzero(row.common - own >= 2)
        score = np.bitwise_count(row.shared[:, good]).sum(axis=0, dtype=np.int64) * 3 + row.common[good]
        js = row.others[good]
        for k in np.lexsort((order[js], day[js], -score))[:most]:
            yield {"item_id": tile.ids_a[row.at], "event_id": tile.ids_b[js[k]], "score": int(score[k]), "day": int(day[js[k]])}


def theses_of(items: DataFrame, theses: DataFrame, most: int = 3) -> DataFrame:
    """``item_id``, ``rank``, ``thesis_id``: theses of the item's entities; supported before mixed before weakened, then the latest.

    An entity has few theses (one a theme), so only the best ``most`` of each are repeated for its items.
    """
    order = [F.desc(F.when(F.col("status") == "supported", 2).when(F.col("status") == "mixed", 1).otherwise(0)), F.desc("updated_at"), F.desc("thesis_id")]
    best = theses.withColumn("_r", F.row_number().over(Window.partitionBy("entity").orderBy(*order))).where(f"_r <= {most}").drop("_r")
    found = items.select("item_id", F.explode("entities").alias("entity")).join(best, "entity")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return found.withColumn("rank", rank).where(f"rank <= {most}").select("item_id", "rank", "thesis_id")
