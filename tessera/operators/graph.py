"""Graphs of links: connected components, clusters of items, projections, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.tables import dropped, stored


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``root``: the smallest id that links lead to. Labels go to neighbours and then to the root's root until none changes."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    now = last = stored(nodes.select("id", F.col("id").alias("root")).distinct(), "labels")
    while True:
        heard = both.join(now.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("heard"))
        step = now.join(heard, "id", "left").select("id", "root", F.least("root", F.coalesce("heard", "root")).alias("next"))
        jump = now.select(F.col("id").alias("next"), F.col("root").alias("far"))
        step = stored(step.join(jump, "next", "left").select("id", F.col("root").alias("was"), F.least("next", F.coalesce("far", "next")).alias("root")), "labels")
        done = step.where("was != root").isEmpty()
        dropped(last)
        now, last = step.select("id", "root"), step
        if done:
            dropped(both)
            return now


def clusters(items: DataFrame, roots: DataFrame) -> DataFrame:
    """Per component: an id made of all its members, the members in order of time, source and URL, size, best score and the representative: highest score, then earliest, then smallest id."""
    named = items.join(roots.withColumnRenamed("id", "item_id"), "item_id")
    best = F.max_by("item_id", F.struct("score", -F.unix_timestamp("published_at"), -F.col("item_id")))
    ids = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
    members = F.transform(F.array_sort(F.collect_list(F.struct("published_at", F.coalesce("source_id", F.lit("")).alias("s"), F.coalesce("url", F.lit("")).alias("u"), "item_id"))), lambda x: x["item_id"])
    made = named.groupBy("root").agg(F.count("*").alias("n_members"), F.count_distinct("source_id").alias("n_sources"), F.max("score").alias("best_score"), best.alias("representative"), F.array_join(ids, "|").alias("_ids"), members.alias("members"))
    return made.withColumn("cluster_id", t.short_id("cluster-", 24, F.col("_ids"))).drop("_ids")


def projection(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of events: entity to event, source to event, and each claim (where there is a column ``claims``) to its event."""
    event = F.concat(F.lit("event:"), F.col("item_id").cast("string"))
    mention = events.select(F.explode("entities").alias("e"), event.alias("dst")).select(F.concat(F.lit("entity:"), F.lower(F.trim("e"))).alias("src"), "dst", F.lit("mentioned_in").alias("kind"))
    report = events.where("trim(coalesce(source_id, '')) != ''").select(F.concat(F.lit("source:"), F.trim("source_id")).alias("src"), event.alias("dst"), F.lit("reports").alias("kind"))
    edges = mention.unionByName(report)
    if "claims" in events.columns:
        each = events.select(event.alias("dst"), "item_id", F.posexplode("claims").alias("k", "claim"))
        edges = edges.unionByName(each.select(F.concat_ws(":", F.lit("claim"), F.col("item_id").cast("string"), F.col("k").cast("string")).alias("src"), "dst", F.lit("claimed_of").alias("kind")))
    edges = edges.distinct()
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(events.select(event)).distinct()
    return nodes.withColumn("type", F.split_part("id", F.lit(":"), F.lit(1))), edges


def chain_ends(replaces: DataFrame) -> DataFrame:
    """``old``, ``new``: who replaces whom. Returns each old id with the end of its chain; pointers double in each round, so a cycle ends as well (at the id it started from)."""
    now = last = stored(replaces.select("old", "new").where("old != new"), "chain")
    for _ in range(64):
        on = now.select(F.col("old").alias("new"), F.col("new").alias("far"))
        step = stored(now.join(on, "new", "left").select("old", F.col("new").alias("was"), F.when(F.col("far") == F.col("old"), F.col("new")).otherwise(F.coalesce("far", "new")).alias("new")), "chain")
        dropped(last)
        now, last = step.select("old", "new"), step
        if step.where("was != new").isEmpty():
            break
    return now
