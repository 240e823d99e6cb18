"""Roll-ups over events: theses by theme and entity, freshness, evidence, digest, health of queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.lexicon import GENERIC_TITLES, Lexicon
from tessera.operators import scoring


def with_themes(events: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``themes``: those one of whose terms an event names."""
    found = scoring.with_hits(events, lexicon)
    hits = F.array_compact(F.array(*[F.when(scoring.hit(th.terms), F.lit(th.name)) for th in lexicon.themes]))
    return found.withColumn("themes", hits).drop(scoring.HITS, scoring.TITLE_HITS)


def themed(events: DataFrame) -> DataFrame:
    """Events once for each of their themes and entities. ``events`` is a stored table: the filter that an explode implies would repeat what makes the themes."""
    return events.withColumn("theme", F.explode("themes")).withColumn("entity", F.explode("entities"))


def revised(old: DataFrame, new: DataFrame, content: list[str]) -> DataFrame:
    """Theses with their revision: 1 when new, one more when any column of ``content`` has changed; first_seen stays, and theses without news stay as they are."""
    o = old.select("thesis_id", F.struct(*content).alias("was"), F.col("revision").alias("r"), F.col("first_seen").alias("seen"), F.col("updated_at").alias("at"))
    n = new.select("thesis_id", F.struct(*content).alias("is"), F.col("updated_at").alias("now"))
    both = o.join(n, "thesis_id", "full_outer")
    fresh = F.col("is").isNotNull()
    moved = (fresh & ~F.col("was").eqNullSafe(F.col("is"))).cast("int")
    return both.select("thesis_id", F.when(F.col("was").isNull(), 1).otherwise(F.col("r") + moved).alias("revision"), F.coalesce("seen", "now").alias("first_seen"), F.coalesce("now", "at").alias("updated_at"), F.coalesce("is", "was").alias("content")).select("thesis_id", "revision", "first_seen", "updated_at", "content.*")


def theses(rows: DataFrame) -> DataFrame:
    """Per (theme, entity) with two events and two sources at least: counts, status, strength and its label.

    ``rows`` has event_id, source_id, is_primary, is_negative; distinct counts are of partial sums, so a hot theme is pre-aggregated.
    """
    per_event = rows.groupBy("theme", "entity", "event_id", "source_id").agg(F.max("is_primary").alias("p"), F.max("is_negative").alias("n"))
    g = per_event.groupBy("theme", "entity").agg(
        F.count_distinct("event_id").alias("n_events"), F.count_distinct("source_id").alias("n_sources"),
        F.count_distinct(F.when(F.col("p"), F.col("source_id"))).alias("n_primary"), F.count_distinct(F.when(F.col("n"), F.col("event_id"))).alias("n_negative"),
    ).where("n_events >= 2 AND n_sources >= 2")
    raw = 35 + 7 * F.least("n_events", F.lit(5)) + 4 * F.least("n_sources", F.lit(5)) + 3 * F.least("n_primary", F.lit(3)) - 8 * F.col("n_negative")
    raw = F.least(F.lit(90), raw)
    status = F.when(F.col("n_negative") > F.col("n_events") / 2, "weakened").when(F.col("n_negative") > 0, "mixed").otherwise("supported")
    label = F.when(raw >= 70, "high").when(raw >= 50, "moderate").otherwise("early")
    return g.withColumns({"status": status, "strength": F.greatest(F.lit(0), raw).cast("bigint"), "label": label, "thesis_id": t.short_id("thesis-", 20, F.col("theme"), F.lower("entity"))})


def freshness(evidence: DataFrame, by: str, now: F.Column, days: int = 30) -> DataFrame:
    """Per event: undated (no date at all), future (any date beyond now and 24 h), stale (all before the cutoff), or fresh."""
    at = F.unix_timestamp("published_at")
    g = evidence.groupBy(by).agg(F.max(at).alias("newest"), F.count("*").alias("n_evidence"))
    n = F.unix_timestamp(now)
    kind = F.when(F.col("newest").isNull(), "undated").when(F.col("newest") > n + 86400, "future").when(F.col("newest") < n - days * 86400, "stale").otherwise("fresh")
    return g.select(by, "n_evidence", kind.alias("freshness"))


def evidence_lists(rows: DataFrame, by: str, n: int = 12) -> DataFrame:
    """Per event its distinct URLs, newest first, n of them at most (what a message shows)."""
    one = rows.groupBy(by, "url").agg(F.max("published_at").alias("published_at"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("published_at"), F.desc("url")))
    kept = one.withColumn("r", rank).where(f"r <= {n}")
    return kept.groupBy(by).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("r", "url"))), lambda x: x["url"])).alias("urls"), F.count("*").alias("n_urls"))


def digest_sources(posts: DataFrame, since: F.Column, until: F.Column, k: int = 5) -> DataFrame:
    """The most frequent sources of a closed window, ties to the one that came first."""
    window = posts.where((F.col("published_at") >= since) & (F.col("published_at") <= until))
    g = window.groupBy("source_id").agg(F.count("*").alias("n_posts"), F.min(F.struct("published_at", "item_id")).alias("first"))
    return g.orderBy(F.desc("n_posts"), "first").limit(k).select("source_id", "n_posts")


def queue_health(queue: DataFrame, now: F.Column) -> DataFrame:
    age = (F.unix_timestamp(now) - F.unix_timestamp("published_at"))
    return queue.agg(F.count("*").alias("n_rows"), F.min(age).cast("bigint").alias("youngest_s"), F.max(age).cast("bigint").alias("oldest_s"))


def says_nothing(titles: F.Column) -> F.Column:
    """Whether an event has evidence and all its titles are blank or of the kind that says nothing."""
    return (F.size(titles) > 0) & F.forall(titles, lambda x: F.trim(t.folded_ascii(x)).isin("", *GENERIC_TITLES))


def dated_links(evidence: F.Column, now: F.Column, days: int = 30) -> F.Column:
    """The evidence (url, published_at) with a web address and a time of the last ``days``, or at most a day ahead."""
    at = lambda x: F.unix_timestamp(x["published_at"])
    n = F.unix_timestamp(now)
    good = lambda x: x["url"].rlike(r"^(?i:https?)://[^/?#\s]+") & (at(x) >= n - days * 86400) & (at(x) <= n + 86400)
    return F.filter(evidence, lambda x: F.coalesce(good(x), F.lit(False)))


def action(freshness: F.Column, says_nothing: F.Column) -> F.Column:
    """What an editor is to do with a queued event."""
    return F.when(freshness == "future", "hold: dated in the future").when(freshness == "undated", "hold: no valid date").when(freshness == "stale", "quarantine: stale").when(says_nothing, "quarantine: titles say nothing").otherwise("review")


def has_progress(pagination: F.Column, keys: tuple[str, ...]) -> F.Column:
    """Whether a map of counters has one of the keys that are a place to go on from."""
    return F.coalesce(F.arrays_overlap(F.map_keys(pagination), t.listed(keys)), F.lit(False))


def worth_saving(status: F.Column, n_rows: F.Column, progress: F.Column) -> F.Column:
    """A run that failed saves nothing; an empty one, or one with rows or progress, does."""
    return status.isin("success", "empty", "partial") & ((n_rows > 0) | (status == "empty") | progress)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each state table has."""
    each = [df.agg(F.lit(name).alias("state"), F.count("*").alias("n_rows")) for name, df in tables.items()]
    out = each[0]
    for other in each[1:]:
        out = out.unionByName(other)
    return out


def newest_of(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n last rows in an order, the last first, with their ``rank``."""
    top = rows.orderBy(*[F.desc(x) for x in order]).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*[F.desc(x) for x in order])))


def products(spark, **lists: list) -> DataFrame:
    """Every combination of the values of small lists of parameters, as rows."""
    out = spark.range(1).select()
    for name, values in lists.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out
