"""Streams of items and attempts: deduplication, windows, health streaks, and a batch driver.

All run with ``availableNow`` for scheduled runs or with an interval; state and
offsets live in the query's checkpoint, in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import times
from tessera.operators import snapshots

STREAK = "source_id bigint, n_attempts bigint, last_status string, consecutive_failures int, consecutive_empty int, status_started_at timestamp"


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(items: DataFrame, key: str = "event_key", at: str = "published_at", delay: str = "72 hours") -> DataFrame:
    """Each key once within the watermark; its state goes when the watermark has passed."""
    return items.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def split_by_time(items: DataFrame, now: F.Column, at: str = "published_at", days: int = 14) -> DataFrame:
    """Late and future rows are marked, not dropped: ``disposition`` is future, stale or current."""
    t = F.col(at)
    return items.withColumn("disposition", F.when(times.is_future(t, now), "future").when(times.is_stale(t, now, days), "stale").otherwise("current"))


def daily_counts(events: DataFrame, by: str, at: str = "ts", delay: str = "1 day") -> DataFrame:
    return events.withWatermark(at, delay).groupBy(F.window(at, "1 day"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), by, "n")


def _streak(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, last, failures, empty, began = state.get if state.exists else (0, None, 0, 0, None)
    rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
    for at, status in zip(rows["at"], rows["status"], strict=True):
        failures = failures + 1 if status == "failed" else 0
        empty = empty + 1 if status in ("empty", "partial") else 0
        if status not in ("failed", "empty", "partial") or status != last or began is None:
            began = at
        n, last = n + 1, status
    state.update((n, last, failures, empty, began))
    yield pd.DataFrame([(key[0], n, last, failures, empty, began)], columns=["source_id", "n_attempts", "last_status", "consecutive_failures", "consecutive_empty", "status_started_at"])


def health(attempts: DataFrame) -> DataFrame:
    """The streaks of each source after each batch, kept in state; a batch's attempts of a source are taken in order of time."""
    kept = "n bigint, last string, failures int, empty int, began timestamp"
    return attempts.select("source_id", "event_id", "at", "status").groupBy("source_id").applyInPandasWithState(_streak, STREAK, kept, "update", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None, mode: str = "append"):
    """Call ``work(batch, id)`` for every micro-batch: a batch may come again after a crash, so work writes by key or by batch id."""
    writer = stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def with_cards(stream: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Each row of a stream with the cards of its key, as the card table is when the batch starts."""
    return stream.join(cards, key)


def appended(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there, its rows written to ``path`` exactly once; the table of them."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def latest_by_key(stream: DataFrame, key: str, at: str, tie: str, path: str, checkpoint: str, keep: int = 2) -> DataFrame:
    """Run a stream over all that is there into a table of the last row of each key; a late row replaces nothing newer.

    The table is kept in versions, ``keep`` of them: each batch writes the next one with its own number, and a batch that comes
    again, which the newest version already has, writes nothing. A run without new rows leaves the table as it was.
    """
    spark, rows = stream.sparkSession, F.struct(*stream.columns)
    kind = snapshots.Kind(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema), (key,))

    def work(batch: DataFrame, number: int) -> None:
        table = snapshots.Table(batch.sparkSession, path, kind)
        newest = table.manifest()
        if newest is not None and int(newest["note"]) >= number:
            return
        every = batch.unionByName(table.read())
        table.write(every.groupBy(key).agg(F.max_by(rows, F.struct(at, tie)).alias("r")).select("r.*"), note=str(number))
        table.expire(keep)

    each_batch(stream, work, checkpoint).awaitTermination()
    return snapshots.Table(spark, path, kind).read()
