"""Commits to a store: retries, races, chains, and a restart."""

from marginalia.streaming import commits


def chain(doc, base, n, start=1, tag="h"):
    name = lambda r: None if r == 0 else f"{tag}{r}"
    return [(doc, start + k, None if base + k == 0 else base + k, name(base + k), base + k + 1, name(base + k + 1)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, commits.COMMIT)


def heads_of(spark, store):
    return {r["document"]: (r["revision"], r["after"]) for r in commits.heads(spark, store).collect()}


def codes_of(spark, store):
    return sorted((r["document"], r["id"], r["code"]) for r in commits.records(spark, store).collect())


def test_a_batch_written_twice_is_written_once(spark, tmp_path):
    store = str(tmp_path / "s")
    first = frame(spark, chain(1, 0, 3) + chain(2, 0, 1) + [(2, 9, None, None, 1, "other"), (None, 1, None, None, 1, "x")])
    assert commits.commit(first, store, "a", 0)["version"] == 1
    assert commits.commit(first, store, "a", 0)["version"] == 1
    assert heads_of(spark, store) == {1: (3, "h3"), 2: (1, "h1")}
    assert {(r["document"], r["id"]) for r in commits.records(spark, store).where("code = 'conflict'").collect()} == {(2, 9), (None, 1)}
    # another writer's retry of the same commit changes no head
    assert commits.commit(frame(spark, chain(1, 2, 1, start=3)), store, "b", 0)["version"] == 2
    assert commits.records(spark, store).where("code = 'retry'").count() == 1
    assert heads_of(spark, store) == {1: (3, "h3"), 2: (1, "h1")}


def test_of_two_writers_of_one_base_one_wins(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    commits.commit(frame(spark, chain(1, 0, 1)), store, "a", 0)
    put = commits.put
    raced = []

    def late(s, where, entry):
        if not raced:
            raced.append(entry)
            commits.commit(frame(spark, [(1, 50, 1, "h1", 2, "theirs")]), store, "b", 0)
        return put(s, where, entry)

    monkeypatch.setattr(commits, "put", late)
    made = commits.commit(frame(spark, [(1, 60, 1, "h1", 2, "mine"), (3, 61, None, None, 1, "new")]), store, "a", 1)
    assert made["version"] == 3 and heads_of(spark, store) == {1: (2, "theirs"), 3: (1, "new")}
    assert codes_of(spark, store) == [(1, 1, "ok"), (1, 50, "ok"), (1, 60, "conflict"), (3, 61, "ok")]
    # the lost try left nothing behind
    assert len(list((tmp_path / "s" / "records").iterdir())) == 3
    assert sorted(f.name for f in (tmp_path / "s" / "log").iterdir() if not f.name.endswith(".crc")) == [f"{v:012d}.json" for v in (1, 2, 3)]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    store, source = str(tmp_path / "s"), str(tmp_path / "in")
    for part in (chain(1, 0, 2) + chain(2, 0, 1), chain(1, 2, 2) + [(2, 7, 4, "h4", 5, "h5")]):
        frame(spark, part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(commits.COMMIT).parquet(source)
        commits.commit_stream(stream, store, str(tmp_path / "c"), "w").awaitTermination()
    assert heads_of(spark, store) == {1: (4, "h4"), 2: (1, "h1")} and commits.latest(spark, store)["writers"] == {"w": 1}
    # the checkpoint is lost and all batches come again
    stream = spark.readStream.schema(commits.COMMIT).parquet(source)
    commits.commit_stream(stream, store, str(tmp_path / "d"), "w").awaitTermination()
    assert heads_of(spark, store) == {1: (4, "h4"), 2: (1, "h1")} and commits.latest(spark, store)["version"] == 2
