"""Messages, and a sink that delivers each queued row once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t


# The hidden lines of a message, the columns they are made of and their lengths.
LINES = {"_title_line": ("title", 220), "_summary_line": ("summary", 360)}


def with_lines(items: DataFrame) -> DataFrame:
    """Title and summary as lines of a message, their character references decoded, as hidden columns for ``messages``.

    They come before entities: an Arrow UDF above the lexicon's hits has the optimizer repeat these for each entity. Each step is a column of its own, so that it runs once a row.
    """
    if all(c in items.columns for c in LINES):
        return items
    steps = (
        lambda c, n: t.opening(F.col(LINES[c][0]), n),
        lambda c, n: t.unescaped(F.col(c)),
        lambda c, n: t.squeezed(t.escaped(F.col(c))),
        lambda c, n: t.clipped_lines(F.col(c), n),
    )
    return reduce(lambda made, step: made.withColumns({c: step(c, n) for c, (_, n) in LINES.items()}), steps, items)


def messages(items: DataFrame) -> DataFrame:
    """``message``: title, summary (both with character references decoded), source with date and up to four entities, link."""
    title = F.coalesce(F.nullif(F.col("_title_line"), F.lit("")), F.lit("Untitled source item"))
    summary = F.col("_summary_line")
    names = F.concat_ws(", ", F.slice("entities", 1, 4))
    meta = F.concat(F.coalesce(F.col("source_id"), F.lit("Unknown source")), F.lit(" · "), F.date_format("published_at", "yyyy-MM-dd"), F.when(names != "", F.concat(F.lit(" · "), names)).otherwise(""))
    link = F.when(F.col("url").rlike(r"^https://[^ \t\n\r\f]+$"), F.concat(F.lit("Source: "), F.col("url")))
    return with_lines(items).withColumn("message", F.concat_ws("\n", F.concat(F.lit("**"), title, F.lit("**")), F.nullif(summary, F.lit("")), F.concat(F.lit("*"), meta, F.lit("*")), link)).drop(*LINES)


# How many claims, conflicts, open questions, sources, names and later events a message shows, and its length.
CAPS = {"claims": 4, "conflicts": 3, "uncertainties": 3, "evidence": 4, "entities": 6, "updated_by": 3}
LONGEST = 2000


def event_messages(events: DataFrame) -> DataFrame:
    """``message`` of an event, section by section, each with its own cap; empty sections are left out.

    ``events``: event_type, summary, significance, status, entities, claims (text, certainty), conflicts, uncertainties,
    evidence (title, source, source_quality, published_at as text, url), updated_by.
    """
    plain = lambda x: F.regexp_replace(t.squeezed(x), r"([\\*_~`|>])", r"\\$1")
    say = lambda x, n: t.clipped(F.replace(plain(x), F.lit("@"), F.lit("@\u200b")), n)
    some = lambda c: F.slice(F.coalesce(c, F.array().cast("array<string>")) if c in ("conflicts", "uncertainties") else F.col(c), 1, CAPS[c])
    point = lambda x: F.concat(F.lit("• "), x)

    def section(head: str, lines: F.Column) -> F.Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"**{head}:**\n"), F.array_join(lines, "\n")))

    names = F.array_sort(F.array_distinct(F.filter(F.transform("entities", lambda x: F.trim(x)), lambda x: x != "")), lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0))
    certain = lambda c: F.lower(F.trim(F.coalesce(c["certainty"], F.lit(""))))
    claim = lambda c: point(F.concat(F.when(certain(c).isin("", "unknown"), "").otherwise(F.concat(F.lit("*"), say(certain(c), 20), F.lit("* — "))), say(c["text"], 240)))
    kind = lambda e: F.when(F.lower(e["source_quality"]) == "primary", "Primary source").when(F.lower(e["source_quality"]) == "high_signal", "Independent reporting").otherwise("Source")
    label = lambda e: F.coalesce(F.nullif(say(e["title"], 130), F.lit("")), say(e["source"], 80))
    day = lambda e: F.nullif(F.substring(F.trim(e["published_at"]), 1, 10), F.lit(""))
    link = lambda e: F.when(e["url"].rlike(r"^https://[^ \t\n\r\f]+$"), F.concat(F.lit("\n  "), e["url"])).otherwise("")
    source = lambda e: point(F.concat(F.concat_ws(" · ", kind(e), label(e), day(e)), link(e)))
    why = F.when(F.col("event_type") == "partnership", "Strategic read-through").otherwise("Why it matters")
    parts = [
        F.concat(F.lit("**"), say(F.initcap(F.replace("event_type", F.lit("_"), F.lit(" "))), 70), F.lit("**")),
        say(F.col("summary"), 420),
        F.when(F.trim(F.coalesce("significance", F.lit(""))) != "", F.concat(F.lit("**"), why, F.lit(":** "), say(F.col("significance"), 700))),
        F.concat(F.lit("**Status:** "), say(F.col("status"), 32)),
        F.when(F.size(names) > 0, F.concat(F.lit("**Key entities:** "), say(F.array_join(F.slice(names, 1, CAPS["entities"]), ", "), 180))),
        section("Grounded updates", F.transform(some("claims"), claim)),
        section("Conflicting reports", F.transform(some("conflicts"), lambda x: point(say(x, 220)))),
        section("Still unclear", F.transform(some("uncertainties"), lambda x: point(say(x, 220)))),
        section("Sources", F.transform(some("evidence"), source)),
        F.when(F.size("updated_by") > 0, F.concat(F.lit("**Updated by:** "), say(F.array_join(F.slice("updated_by", 1, CAPS["updated_by"]), ", "), 140))),
    ]
    return events.withColumn("message", F.substring(F.concat_ws("\n", *parts), 1, LONGEST))


def deliver(queue: DataFrame, send: Callable[[str], bool], key: str = "key", message: str = "message") -> DataFrame:
    """Send every row where it lies: ``key``, ``sent``. After two failures in a row a task sends no more; write the result to the ledger before rows leave the queue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for b in batches:
            sent = []
            for m in b[message]:
                ok = failed < 2 and bool(send(m))
                failed = 0 if ok else failed + 1
                sent.append(ok)
            yield pd.DataFrame({key: b[key], "sent": sent})

    return queue.select(key, message).mapInPandas(run, f"{key} {queue.schema[key].dataType.simpleString()}, sent boolean")


def digest_text(posts: DataFrame, events: DataFrame, most: int = 2000) -> DataFrame:
    """One row, ``text``: the number of posts, their five most frequent sources, the first twelve posts and five events of a window.

    ``posts``: title, source_id, published_at, item_id; ``events``: summary, newest, event_id. Each part is a top-k before it is gathered.
    """
    count = posts.agg(F.count("*").alias("n"))
    top = posts.groupBy("source_id").agg(F.count("*").alias("n"), F.min(F.struct("published_at", "item_id")).alias("first")).orderBy(F.desc("n"), "first").limit(5)
    sources = top.agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "source_id", "n"))), lambda x: F.concat(x["source_id"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))).alias("sources"))
    shown = posts.orderBy("published_at", "item_id").limit(12).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("published_at", "item_id", "title"))), lambda x: F.concat(F.lit("- "), x["title"]))).alias("items"))
    told = events.orderBy(F.desc("newest"), "event_id").limit(5).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("newest")).alias("m"), "event_id", "summary"))), lambda x: F.concat(F.lit("* "), x["summary"]))).alias("events"))
    one = count.crossJoin(sources).crossJoin(shown).crossJoin(told)  # four rows of one
    return one.select(t.clipped_lines(F.concat_ws("\n", F.concat(F.col("n").cast("string"), F.lit(" items in the last week")), F.concat(F.lit("Sources: "), F.col("sources")), "items", F.nullif("events", F.lit(""))), most).alias("text"))
