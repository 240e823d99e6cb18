"""Reading paged listings under a budget of pages, with a frontier for each source that moves on from run to run.

A frontier is the oldest row that was taken (its id and date) and the page where
older ones are looked for (the hint). A run reads the shallow pages of every
source, finds its boundary again, there or from the hint on, and goes on to older
pages while its budget lasts. All sources are read together, round by round: a
round is one join of the pages that are asked for with what ``read`` returns, so
a run has as many rounds as a source may have pages, whatever the number of sources.

Outcomes: ``initial`` (nothing was saved: the shallow pages are taken), ``active``
(the boundary was found; it moves to the oldest row behind it, if any was read),
``missing`` (it was not; it stays, and the hint moves on unless the listing ended),
``expired`` (the boundary is older than the window; it stays), ``failed`` and
``partial`` (the first, or a later page could not be read; the frontier stays) and
``refused`` (what was saved is no frontier; nothing is asked for, and nothing reset).
A source that is saved twice is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.tables import dropped, stored

FRONTIER = "source string, boundary_id string, boundary_date date, hint int"


def unusable(most_pages: int = 1_000_000) -> dict[str, Column]:
    """Why a saved frontier is none."""
    return {
        "no source": F.col("source").isNull(),
        "no hint, or one that is no page": ~F.coalesce(F.col("hint").between(1, most_pages), F.lit(False)),
        "an id without a date, or a date without an id": F.col("boundary_id").isNull() != F.col("boundary_date").isNull(),
        "a hint without a boundary": F.col("boundary_id").isNull() & (F.col("hint") != 1),
    }


def scan(read: Callable[[DataFrame], DataFrame], sources: DataFrame, saved: DataFrame, since: Column, shallow: int = 1, budget: int = 3) -> tuple[DataFrame, DataFrame]:
    """The rows that were read, once by id, and each source's ``outcome``, ``problem``, ``n_pages`` and frontier to save.

    ``read`` takes (source, page) and gives source, page, place, native_id, published_at and what else the listing has; a page with
    ``failure`` (in a row without an id) could not be read; one without rows is behind the end. ``since``: the first day of the window.
    """
    if not 1 <= shallow <= budget:
        raise ValueError("the shallow pages must fit into the budget")
    reasons = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in unusable().items()])
    twice = saved.groupBy("source").agg(F.count("*").alias("_n")).where("_n > 1").select("source", F.lit(True).alias("_twice"))
    one = saved.select("source", "boundary_id", "boundary_date", "hint", F.lit(True).alias("_saved")).dropDuplicates(["source"]).join(twice, "source", "left")
    known = sources.select("source").distinct().join(one, "source", "left")
    problem = F.when(F.col("_twice"), "saved twice").otherwise(F.when(F.col("_saved"), reasons))
    state = known.select("source", "boundary_id", "boundary_date", "hint", problem.alias("problem"))
    state = state.withColumns({"outcome": F.when(F.col("problem").isNotNull(), "refused"), "found_page": F.lit(None).cast("int"), "ask": F.lit(0), "n_pages": F.lit(0), "last_page": F.lit(-1), "ended": F.lit(False)})
    state = stored(state, "scan-state")

    parts: list[DataFrame] = []
    for n in range(budget - shallow + 1):
        width = shallow if n == 0 else 1
        asked = state.where("outcome IS NULL").select("source", F.explode(F.sequence(F.col("ask"), F.col("ask") + width - 1)).alias("page"))
        rows = stored(read(asked), f"scan-{n}")
        parts.append(rows)
        mine = rows.join(state.select("source", "boundary_id"), "source")
        of = mine.groupBy("source").agg(
            F.min(F.when(F.col("native_id") == F.col("boundary_id"), F.col("page"))).alias("_met"), F.max(F.when(F.col("native_id").isNotNull(), F.col("page"))).alias("_full"), F.min(F.when(F.col("failure").isNotNull(), F.col("page"))).alias("_failed"),
        )
        both = state.join(of, "source", "left")
        open_ = F.col("outcome").isNull()
        end = F.col("ask") + width - 1
        found = F.coalesce("found_page", F.when(open_, F.col("_met")))
        empty = F.coalesce(F.col("_full"), F.lit(-1)) < end
        if n == 0:
            stop = F.when(F.col("boundary_id").isNull(), "initial").when(F.col("boundary_date") < since, "expired")
            ahead = F.when(F.col("_met").isNotNull(), F.lit(shallow)).otherwise(F.greatest(F.col("hint"), F.lit(shallow)))
        else:
            stop = F.when(empty, F.when(found.isNotNull(), "active").otherwise("missing"))
            ahead = F.col("ask") + 1
        broke = F.when(F.col("_failed") == 0, "failed").when(F.col("_failed").isNotNull(), "partial")
        keep = lambda now, name: F.when(open_, now).otherwise(F.col(name)).alias(name)
        last, state = state, stored(
            both.select(
                "source", "boundary_id", "boundary_date", "hint", "problem", keep(F.coalesce(broke, stop), "outcome"), found.alias("found_page"), keep(ahead, "ask"),
                keep(F.col("n_pages") + width, "n_pages"), keep(end, "last_page"), keep(empty, "ended"),
            ),
            "scan-state",
        )
        dropped(last)

    every = reduce(DataFrame.unionByName, parts).where("native_id IS NOT NULL")
    at = F.struct("page", "place")
    outcome = F.coalesce("outcome", F.when(F.col("found_page").isNotNull(), "active").otherwise("missing"))
    state = state.withColumn("outcome", outcome)
    placed = every.join(state.select("source", "outcome", "boundary_id", "found_page"), "source")
    mark = placed.where("outcome = 'active' AND native_id = boundary_id").groupBy("source").agg(F.min(at).alias("_mark"))
    behind = placed.join(mark, "source", "left").where((F.col("outcome") == "initial") | ((F.col("outcome") == "active") & (at > F.col("_mark"))))
    last = behind.groupBy("source").agg(F.max(F.struct("page", "place", "native_id", F.to_date("published_at").alias("date"))).alias("_last"))
    both = state.join(last, "source", "left")
    moved = F.col("_last").isNotNull()
    hint = (
        F.when(F.col("outcome") == "initial", F.lit(1))
        .when(F.col("outcome") == "active", F.when(moved, F.col("_last.page") + 1).otherwise(F.col("found_page") + 1))
        .when((F.col("outcome") == "missing") & ~F.col("ended") & (F.col("last_page") >= F.col("hint")), F.col("last_page") + 1)
        .otherwise(F.col("hint"))
    )
    states = both.select("source", "outcome", "problem", "n_pages", F.when(moved, F.col("_last.native_id")).otherwise(F.col("boundary_id")).alias("boundary_id"), F.when(moved, F.col("_last.date")).otherwise(F.col("boundary_date")).alias("boundary_date"), hint.cast("int").alias("hint"))
    taken = every.drop("failure")
    others = [c for c in taken.columns if c not in ("source", "native_id")]
    first = taken.groupBy("source", "native_id").agg(F.min_by(F.struct(*others), at).alias("r")).select("source", "native_id", "r.*")
    return first, stored(states, "scan-states")


def stored_reader(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``read`` over recorded pages."""
    rows = pages if "failure" in pages.columns else pages.withColumn("failure", F.lit(None).cast("string"))
    return lambda asked: rows.join(asked, ["source", "page"])
