"""Sessions with expiry: state by key that a timer ends, without a further row of the key.

State lives in Spark's state store, which must be RocksDB's for this operator
(spark.sql.streaming.stateStore.providerClass), and goes on from the checkpoint after a restart. Rows are taken
one by one, so a key of many rows holds no more than its state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "generation long, value long, last long"
OUT = "key long, generation long, value long, code string"


class Sessions(StatefulProcessor):
    """See `sessions`. last is the session's last time in milliseconds; a timer always stands at last + ttl."""

    def __init__(self, ttl: int):
        self.ttl = ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", SESSION)

    def put(self, generation: int, value: int | None, last: int, before: int | None) -> None:
        self.state.update((generation, value, last))
        if before != last:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl)
            self.handle.registerTimer(last + self.ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.put(initialState.generation, initialState.value, initialState.last, None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = tuple(self.state.get()) if self.state.exists() else None
        before = now and now[2]
        for r in rows:
            generation, value, last = now or (0, None, r.millis)
            if r.base is not None and r.base != generation:
                yield Row(key=key[0], generation=generation, value=r.value, code="stale")
                continue
            now = (generation + 1, r.value, max(last, r.millis))
            yield Row(key=key[0], generation=now[0], value=r.value, code="saved")
        if now:
            self.put(*now, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        generation, value, _ = self.state.get()
        self.state.clear()
        yield Row(key=key[0], generation=generation, value=value, code="expired")

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, ttl: int, delay: int = 0, initial: DataFrame | None = None) -> DataFrame:
    """stream: key, at (timestamp), base, value. Rows (key, generation, value, code) of what became of each save, and of each session that ended.

    A save whose base is its session's generation, or null, is saved and makes the next generation; others are
    stale (the generation given is the session's). A key without a session has generation 0. A session ends
    (expired, with its last generation and value) when the stream's watermark, `delay` seconds behind the
    latest time seen, passes its last save by `ttl` seconds; the next save begins anew. Saves of
    one batch are taken as they come. Rows behind the watermark, and those without a time or key, are dropped.
    initial (key, generation, value, last in milliseconds) are sessions to begin with, one a key.
    """
    rows = stream.where("at is not null and key is not null").withWatermark("at", f"{delay} seconds")
    rows = rows.select("at", F.col("key").cast("long").alias("key"), F.col("base").cast("long").alias("base"), F.col("value").cast("long").alias("value"), F.unix_millis("at").alias("millis"))
    begin = initial.select("key", "generation", "value", "last").groupBy("key") if initial is not None else None
    return rows.groupBy("key").transformWithState(Sessions(ttl), OUT, "Append", "EventTime", begin)
