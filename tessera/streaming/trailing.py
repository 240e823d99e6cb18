"""State that lasts for a trailing time: what was seen of a key, for so long and no longer.

Cards and signatures last 72 hours, ledgers 35 days, observations 90: each is one
``transformWithState`` on RocksDB. A key's state is the last digest and its time.
A timer of event time removes it once the watermark has passed its end, so what
is kept is bounded by the keys of the trailing time; what the state says never
depends on when the timer runs, as times are compared as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Seen(StatefulProcessor):
    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us bigint, digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_us", "id"])
        before = self.last.get() if self.last.exists() else None
        start, out = before, []
        for id_, at, digest in zip(batch["id"].tolist(), batch["at_us"].tolist(), batch["digest"].tolist(), strict=True):
            digest = None if pd.isna(digest) else digest
            if before is None or at - before[0] > self.seconds * 1_000_000:
                change = "new"
            else:
                change = "same" if digest == before[1] else "changed"
            out.append((*key, id_, change, None if change == "new" else before[1]))
            before = (max(at, before[0]), digest) if before is not None else (at, digest)
        if start is not None:
            self.handle.deleteTimer(self._end(start[0]))
        self.last.update(before)
        self.handle.registerTimer(self._end(before[0]))
        yield pd.DataFrame(out, columns=["key", "id", "change", "before"], dtype="object")

    def _end(self, at_us: int) -> int:
        return at_us // 1000 + self.seconds * 1000 + 1

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self._end(self.last.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: str, id: str, at: str, digest: str, hours: int, delay: str = "1 day") -> DataFrame:
    """Each row as ``new`` (its key was not seen in the hours before), ``changed`` or ``same`` by its digest: ``key``, ``id``, ``change``, ``before``.

    A batch's rows of a key are taken in order of time and id; a late row is compared with the newest that came before it. Rows later than the watermark go.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(id).alias("id"), F.col(at).alias("at"), F.unix_micros(F.col(at)).alias("at_us"), F.col(digest).cast("string").alias("digest"))
    schema = f"key string, id {rows.schema['id'].dataType.simpleString()}, change string, before string"
    return rows.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(_Seen(hours * 3600), schema, "append", "EventTime")
