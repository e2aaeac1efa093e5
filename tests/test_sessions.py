"""Sessions: compare-and-swap of generations, expiry without a further row, restart, initial state."""

import datetime as dt

import pytest

from marginalia.streaming import sessions

SCHEMA = "key long, at timestamp, base long, value long"


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


@pytest.fixture
def rocks(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKS)
    return s


def test_sessions(rocks, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    initial = rocks.createDataFrame([(4, 7, 70, int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))], "key long, generation long, value long, last long")
    seen = []

    def step(rows):
        rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = sessions.sessions(rocks.readStream.schema(SCHEMA).parquet(source), ttl=60, initial=initial)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        now = sorted(tuple(r) for r in rocks.read.schema(sessions.OUT).parquet(out).collect())
        new = [r for r in now if r not in seen]
        seen.extend(new)
        return new

    assert step([(1, at(0), 0, 10), (2, at(5), None, 20), (None, at(5), None, 1), (3, None, None, 1), (4, at(6), 7, 71)]) == [(1, 1, 10, "saved"), (2, 1, 20, "saved"), (4, 8, 71, "saved")]
    # after a restart: a save against an old generation is stale, one against the present one is saved
    assert step([(1, at(50), 0, 11), (2, at(50), 1, 21)]) == [(1, 1, 11, "stale"), (2, 2, 21, "saved")]
    # only key 9 has a row, but keys 1 (last saved at 0) and 4 end; key 2 lives on, having been saved at 50
    assert sorted(step([(9, at(100), None, 90)])) == [(1, 1, 10, "expired"), (4, 8, 71, "expired"), (9, 1, 90, "saved")]
    # key 1 begins anew
    assert step([(1, at(101), 1, 12), (1, at(102), 0, 13)]) == [(1, 0, 12, "stale"), (1, 1, 13, "saved")]
