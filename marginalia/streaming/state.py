"""Streams over the edit log: versions and generations, never event time, decide what is stale.

Each function takes a streaming DataFrame (or, for tests, a batch one where
noted) and gives a streaming one; state is kept by key in Spark's state store,
so a lost executor's state is restored from the checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value: how long a receipt may be redeemed, in seconds.
TTL = 300


def first_of_each_command(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose command hasn't been seen; a retried command is dropped."""
    return stream.dropDuplicates(keys)


def newest_generation(stream: DataFrame) -> DataFrame:
    """stream: key, generation, result. A result is accepted when its generation is above all that its key has had."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values("generation", kind="stable")
        before = rows["generation"].cummax().shift(fill_value=best).clip(lower=best)
        state.update((max(best, int(rows["generation"].max())),))
        yield pd.DataFrame({"key": key[0], "generation": rows["generation"], "result": rows["result"], "accepted": rows["generation"] > before})

    return stream.select("key", "generation", "result").groupBy("key").applyInPandasWithState(step, "key long, generation long, result long, accepted boolean", "best long", "append", GroupStateTimeout.NoTimeout)


def redeem_receipts(stream: DataFrame, ttl: int = TTL) -> DataFrame:
    """stream: key, at (seconds), action (issue or redeem), id. A receipt is redeemed once, within ttl of its issue.

    Rows of one key in a batch are taken in order of (at, id). Code: issued, ok,
    expired, spent or unknown. The state is the last issue and whether it's spent.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        issued, spent = state.get if state.exists else (None, False)
        codes = []
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        for at, action in zip(rows["at"], rows["action"]):
            if action == "issue":
                issued, spent, code = int(at), False, "issued"
            elif issued is None:
                code = "unknown"
            elif spent:
                code = "spent"
            elif at - issued > ttl:
                code = "expired"
            else:
                spent, code = True, "ok"
            codes.append(code)
        state.update((issued, spent))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "code": codes})

    return stream.select("key", "at", "action", "id").groupBy("key").applyInPandasWithState(step, "key long, id long, code string", "issued long, spent boolean", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives on what is there now, written in the shared folder and read again."""
    spark = stream.sparkSession
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    done = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
