"""Enrichment by a text model under checks of evidence.

A provider (any callable from question to JSON text) answers in Arrow batches, and every answer is held to the evidence it cites
(``grounding``). What fails is a row with its error, never a lost batch; the provider being away ends the task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import grounding
from tessera.tables import stored

ATTEMPTS = 3


class Unavailable(RuntimeError):
    """The provider can't be reached."""


def select(items: DataFrame, k: int, gate: int, specificity: F.Column) -> DataFrame:
    """The k items to analyse: highest score, then most specific, latest, title, id."""
    return items.where(F.col("score") >= gate).orderBy(F.desc("score"), specificity, F.desc("published_at"), F.lower("title"), "item_id").limit(k)


def near_misses(items: DataFrame, k: int, gate: int) -> DataFrame:
    return items.where(F.col("score") < gate).orderBy(F.desc("score"), F.desc("published_at"), F.lower("title"), "item_id").limit(k)


def released(seen: DataFrame, selected: DataFrame, failed: DataFrame) -> DataFrame:
    """The seen keys without those of selected items whose analysis failed: they come again."""
    retry = selected.join(failed.select("item_id"), "item_id", "left_semi").select("fingerprint")
    return seen.join(retry, "fingerprint", "left_anti")


def evidence(items: DataFrame) -> DataFrame:
    """Per cluster its sources in order, each once: label, publisher, title, summary."""
    one = items.groupBy("cluster_id", "source_id", "url").agg(F.min_by(F.struct("item_id", "title", "summary"), "item_id").alias("r"))
    return one.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(F.col("r.item_id").alias("item_id"), F.col("source_id").alias("publisher"), F.col("r.title").alias("title"), F.col("r.summary").alias("summary")))).alias("sources"))


def enrich(clusters: DataFrame, provider: Callable[[str], str], rules: grounding.Rules = grounding.Rules(), attempts: int = ATTEMPTS) -> DataFrame:
    """One row for each cluster of ``evidence`` (``history`` may stand beside it): the analysis, whether it holds, its error and the attempts.

    A round asks about all clusters that are open; a refused answer is asked again with its error, until ``attempts`` are used
    or the error is the same twice. A round is a table, so that a lost executor repeats the questions of its own task only.
    """

    def answer(asked: str) -> str | None:
        try:
            return provider(asked)
        except ValueError:
            return None

    ask = F.pandas_udf(lambda asked: asked.map(answer), "string").asNondeterministic()
    history = F.col("history") if "history" in clusters.columns else F.lit("")
    rows = clusters.select("cluster_id", "sources", history.alias("history"), F.lit("").alias("asked_for"))
    closed = []
    for n in range(1, attempts + 1):
        asked = F.concat(grounding.question(F.col("sources"), F.col("history")), F.when(F.col("asked_for") == "", "").otherwise(grounding.correction(F.col("asked_for"), F.lit(n == attempts))))
        judged = stored(grounding.checked(rows.withColumn("answer", ask(asked)), rules).drop("answer"), "answers")
        over = F.col("ok") | F.lit(n == attempts) | (F.col("error") == F.col("asked_for"))
        closed.append(judged.where(over).withColumn("attempts", F.lit(n)).select("cluster_id", "ok", "error", "attempts", *grounding.FOUND))
        rows = judged.where(~over).select("cluster_id", "sources", "history", F.col("error").alias("asked_for"))
        if n == attempts or rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, closed)


def evaluated(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case whether its answer matches all wanted patterns and none of the unwanted."""
    both = cases.join(answers.select("cluster_id", F.lower("summary").alias("said")), "cluster_id", "left")
    good = F.forall("must_match", lambda p: F.regexp_like(F.coalesce("said", F.lit("")), p)) & ~F.exists("must_not_match", lambda p: F.regexp_like(F.coalesce("said", F.lit("")), p))
    return both.select("cluster_id", (good & F.col("said").isNotNull()).alias("passed"))


def evaluation_counts(judged: DataFrame) -> DataFrame:
    """How many cases passed, and how many did not."""
    return judged.groupBy("passed").agg(F.count("*").alias("n_cases"))
