"""State tables: keyed merges, change detection, streaks, revisions, queues with bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import stored

FAILED, EMPTY = "failed", ("empty", "partial")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key; columns in ``keep`` stay as they first were."""
    o, n = old.alias("o"), new.alias("n")
    there = F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep or c == key else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[pick(c).alias(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """First write wins."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Each key as new, changed, unchanged or gone, by its digest."""
    both = old.select(key, F.col(digest).alias("was")).join(new.select(key, F.col(digest).alias("is")), key, "full_outer")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") == F.col("is"), "unchanged").otherwise("changed")
    return both.select(key, kind.alias("change"))


def streaks(attempts: DataFrame, key: str, at: str, tie: str, status: str, chunk: str = "day") -> DataFrame:
    """Per attempt: how many of its source failed, or came back empty, in a row up to here, and since when a bad status has lasted.

    Gaps and islands in two levels: within each source's ``chunk`` of time, and
    over the chunks' summaries, whose streaks are carried on into the next. No
    task sorts all attempts of a source.
    """
    names = [F.col(c) for c in attempts.columns]
    failed, empty = F.col(status) == FAILED, F.col(status).isin(*EMPTY)
    part = [key, "_c"]
    w = Window.partitionBy(*part).orderBy(at, tie)
    same = F.coalesce((failed | empty) & (F.lag(status).over(w) == F.col(status)), F.lit(False))
    total = lambda hit: F.sum(F.when(hit, 1).otherwise(0)).over(w)
    cut = attempts.withColumn("_c", F.date_trunc(chunk, at)).withColumns({"_n": F.row_number().over(w), "_f": total(~failed), "_e": total(~empty), "_s": total(~same)})
    run = lambda group, hit: F.sum(F.when(hit, 1).otherwise(0)).over(Window.partitionBy(*part, group).orderBy(at, tie))
    began = F.min(at).over(Window.partitionBy(*part, "_s").orderBy(at, tie))
    rows = cut.withColumns({"_nf": run("_f", failed), "_ne": run("_e", empty), "_began": began})

    first, last = F.min_by(F.struct(F.col(status).alias("s"), "_s"), "_n"), F.max_by(F.struct(F.col(status).alias("s"), "_s", "_nf", "_ne", "_began"), "_n")
    ends = rows.groupBy(*part).agg(F.count("*").alias("n"), first.alias("a"), last.alias("z"))
    v = Window.partitionBy(key).orderBy("_c")
    joins = (F.col("z._s") == F.col("a._s")) & F.col("z.s").isin(FAILED, *EMPTY) & (F.lag("z.s").over(v) == F.col("a.s"))
    ends = ends.withColumns({g: F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(v) for g, goes_on in (("gf", F.col("z._nf") == F.col("n")), ("ge", F.col("z._ne") == F.col("n")), ("gs", joins))})
    of = lambda g: Window.partitionBy(key, g).orderBy("_c")
    ends = ends.withColumns({"af": F.sum("z._nf").over(of("gf")), "ae": F.sum("z._ne").over(of("ge")), "ab": F.min("z._began").over(of("gs"))})
    carried = ends.select(F.col(key).alias("_k"), F.col("_c").alias("_d"), *[F.lag(x).over(v).alias(y) for x, y in (("af", "_cf"), ("ae", "_ce"), ("ab", "_cb"), ("z.s", "_cs"))], F.col("a._s").alias("_s1"))
    met = rows.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_c").eqNullSafe(F.col("_d")))
    more = lambda n, carry: (F.col(n) + F.when(F.col(n) == F.col("_n"), F.coalesce(carry, F.lit(0))).otherwise(0)).cast("bigint")
    lasting = (F.col("_s") == F.col("_s1")) & (failed | empty) & (F.col(status) == F.col("_cs"))
    return met.select(*names, more("_nf", F.col("_cf")).alias("consecutive_failures"), more("_ne", F.col("_ce")).alias("consecutive_empty"), F.when(lasting, F.col("_cb")).otherwise(F.col("_began")).alias("status_started_at"))


def warnings(health: DataFrame, at: str, hours: int = 24) -> DataFrame:
    """Attempts whose bad status has lasted that long."""
    lasting = F.unix_timestamp(at) - F.unix_timestamp("status_started_at") >= hours * 3600
    return health.where(F.col("status").isin(FAILED, *EMPTY) & lasting)


def revisions(rows: DataFrame, key: str, at: str, tie: str, digest: str, most: int = 10) -> DataFrame:
    """Per key the number of its revisions (rows whose digest differs from the one before) and the last ``most`` digests."""
    w = Window.partitionBy(key).orderBy(at, tie)
    made = rows.withColumn("_new", ~F.col(digest).eqNullSafe(F.lag(digest).over(w))).where("_new")
    numbered = made.withColumn("revision", F.row_number().over(w)).withColumn("_last", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))))
    last = F.when(F.col("_last") <= most, F.struct("revision", F.col(digest).alias("d")))
    grouped = numbered.groupBy(key).agg(F.max("revision").alias("n_revisions"), F.array_sort(F.collect_list(last)).alias("h"))
    return grouped.select(key, "n_revisions", F.transform("h", lambda x: x["d"]).alias("history"))


def refuse_overflow(queue: DataFrame, most: int) -> DataFrame:
    """A queue of what is not yet delivered is never cut: too many rows are an error, raised when the table is used."""
    n = queue.agg(F.count("*").alias("_n"))
    fits = F.assert_true(F.col("_n") <= most, F.lit(f"the queue holds more than {most} rows")).isNull()
    return queue.crossJoin(F.broadcast(n)).where(fits).drop("_n")


def without_delivered(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose id isn't in the ledger (rows of ``event_id`` and ``signature``, either may be null) and none of whose signatures is."""
    by_id = events.join(ledger.where("event_id IS NOT NULL").select("event_id").distinct(), "event_id", "left_anti")
    said = by_id.select("event_id", F.explode("signatures").alias("signature")).join(ledger.select("signature").distinct(), "signature", "left_semi").select("event_id").distinct()
    return by_id.join(said, "event_id", "left_anti")


def seen_tail(old: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """``place``, ``fingerprint``: the keys of ``old`` in their places, then new ones in their own order; the last ``most``."""
    added = numbered(new.select("fingerprint").distinct().join(old.select("fingerprint"), "fingerprint", "left_anti"), "fingerprint")
    end = old.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("_end"))
    every = old.select("place", "fingerprint").unionByName(added.crossJoin(F.broadcast(end)).select((F.col("_end") + 1 + F.col("_place")).alias("place"), "fingerprint"))
    return every.orderBy(F.desc("place")).limit(most)


def undelivered(queue: DataFrame, ledger: DataFrame) -> DataFrame:
    """Queued rows whose key isn't in the ledger, nor their URL (a closing slash apart)."""
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    by_key = queue.join(ledger.select("key"), "key", "left_anti")
    return by_key.withColumn("_u", bare("url")).join(ledger.select(bare("url").alias("_u")), "_u", "left_anti").drop("_u")


def collisions(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that both tables have with different content; must be empty before a move."""
    return a.select(key, F.col(digest).alias("x")).join(b.select(key, F.col(digest).alias("y")), key).where("x != y").select(key)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their place in the order, from 0, in ``_place``: sorted by range, counted by partition, no task sorts all."""
    made = stored(rows.sort(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", 33)
    sizes = made.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = made.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn("_place", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def rotated(rows: DataFrame, order: str, start: int, k: int) -> DataFrame:
    """k of n rows in their order, beginning after ``start`` and around the end."""
    n = rows.agg(F.count("*").alias("_n"))
    return numbered(rows, order).crossJoin(F.broadcast(n)).where(F.pmod(F.col("_place") - start, F.col("_n")) < k).drop("_place", "_n")


def frontiers(listing: DataFrame, saved: DataFrame) -> DataFrame:
    """What each source's listing says of its saved frontier: source, found_page, found_place, first_id, last_page, last_id, status.

    ``listing``: source, page (0: newest), place, native_id, of the pages that were read; ``saved``: source, boundary_id, hint.
    initial: nothing was saved; found: the boundary stands in the listing; missing: it does not; unread: nothing was read.
    """
    at = F.struct("page", "place")
    met = listing.join(saved, "source", "left")
    of = met.groupBy("source").agg(F.min(F.when(F.col("native_id") == F.col("boundary_id"), at)).alias("found"), F.min_by("native_id", at).alias("first_id"), F.max(F.when(F.col("page") == 0, F.struct("place", "native_id"))).alias("last"), F.max("page").alias("last_page"))
    both = saved.join(of, "source", "full_outer")
    status = F.when(F.col("last_page").isNull(), "unread").when(F.col("boundary_id").isNull(), "initial").when(F.col("found").isNull(), "missing").otherwise("found")
    return both.select("source", "boundary_id", "hint", F.col("found.page").alias("found_page"), F.col("found.place").alias("found_place"), "first_id", F.col("last.native_id").alias("last_id"), "last_page", status.alias("status"))


def beyond(listing: DataFrame, found: DataFrame) -> DataFrame:
    """The rows to take: of an initial listing the first page, else what stands before the boundary; nothing while it is missing."""
    met = listing.join(found.select("source", "status", "found_page", "found_place"), "source")
    newer = (F.col("page") < F.col("found_page")) | ((F.col("page") == F.col("found_page")) & (F.col("place") < F.col("found_place")))
    return met.where(((F.col("status") == "initial") & (F.col("page") == 0)) | ((F.col("status") == "found") & newer)).select(*listing.columns)


def advanced(listing: DataFrame, found: DataFrame) -> DataFrame:
    """The frontier to save for each source: the oldest row that was taken is its boundary, the page after it the hint; a missing boundary stays, and the hint moves on."""
    at = F.struct("page", "place")
    last = beyond(listing, found).groupBy("source").agg(F.max_by("native_id", at).alias("taken"))
    both = found.join(last, "source", "left")
    hint = F.when(F.col("status") == "initial", F.lit(1)).when((F.col("status") == "found") & F.col("taken").isNotNull(), F.col("found_page") + 1).when((F.col("status") == "missing") & (F.col("last_page") > 0), F.col("last_page") + 1).otherwise(F.col("hint"))
    return both.select("source", F.coalesce("taken", "boundary_id").alias("boundary_id"), hint.cast("int").alias("hint"), "status")


def term_frontiers(rows: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows newer than the saved (published_at, native_id) of their term, and each term's new frontier; a term without news keeps its own."""
    at = F.struct("published_at", "native_id")
    met = rows.join(saved.select("term", F.struct(F.col("published_at").alias("p"), F.col("native_id").alias("i")).alias("frontier")), "term", "left")
    fresh = met.where(F.col("frontier").isNull() | (F.col("published_at") > F.col("frontier.p")) | ((F.col("published_at") == F.col("frontier.p")) & (F.col("native_id") > F.col("frontier.i")))).drop("frontier")
    every = saved.select("term", at.alias("f")).unionByName(fresh.select("term", at.alias("f")))
    return fresh, every.groupBy("term").agg(F.max("f").alias("f")).select("term", "f.published_at", "f.native_id")


def retained(rows: DataFrame, at: str, now: F.Column, hours: int, most: int, order: str, tie: str) -> DataFrame:
    """A memory (not a queue): rows of the last ``hours``, and of those the newest ``most``."""
    return rows.where(F.unix_timestamp(at) >= F.unix_timestamp(now) - hours * 3600).orderBy(F.desc(order), F.desc(tie)).limit(most)


def payload_hash(columns: list[str]) -> F.Column:
    """Of the content alone: columns in order of name, nulls told from empty texts."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def merged_branches(branches: DataFrame, closed: DataFrame, opened: DataFrame, default: str, now: F.Column, days: int) -> DataFrame:
    """Branches whose tip was merged ``days`` ago or more, that no open request uses, and that are neither protected nor the default."""
    old = closed.where(F.unix_timestamp("merged_at") <= F.unix_timestamp(now) - days * 86400).select("name", "sha")
    free = branches.where((F.col("name") != default) & ~F.coalesce("protected", F.lit(False)))
    return free.join(old, ["name", "sha"], "left_semi").join(opened.select("name"), "name", "left_anti")


def first_in(queue: DataFrame, n: int, at: str, key: str) -> DataFrame:
    """The n rows that have waited longest."""
    return queue.orderBy(at, key).limit(n)
