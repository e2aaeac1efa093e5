"""Commits, inverses, undo and redo, snapshots and recovery."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marginalia.operators import replay

TYPES = ["text", "text", "insert", "remove", "move", "kind", "split", "merge"]


def blocks(n, rng):
    return [{"node": f"n{i}", "kind": rng.choice(["heading", "paragraph"]), "text": rng.choice(["", "déjà 😀", "plain text"])} for i in range(n)]


def command(rng, i, kinds=TYPES):
    return {"type": rng.choice(kinds), "place": rng.randrange(3), "start": rng.randrange(4), "length": rng.randrange(3), "to": rng.randrange(5), "kind": rng.choice(["heading", "paragraph", "quote"]), "text": rng.choice(["", "né", "xy"]), "node": f"c{i}"}


@pytest.mark.parametrize("seed", range(40))
def test_every_operation_has_its_inverse(seed):
    rng = random.Random(seed)
    document = replay.Document(blocks(rng.randrange(1, 6), rng))
    states, done = [document.blocks()], []
    for i in range(60):
        try:
            op = document.derive(command(rng, i))
            document.apply(op)
        except replay.Refused:
            assert document.blocks() == states[-1]
            continue
        assert replay.inverted(replay.inverted(op)) == op
        done.append(op)
        states.append(document.blocks())
        assert document.hash() == replay.Document(document.blocks()).hash()
    assert len(done) > 3
    for op in reversed(done):
        states.pop()
        document.apply(replay.inverted(op))
        assert document.blocks() == states[-1]


def test_a_transaction_is_done_whole_or_not_at_all():
    document = replay.Document([{"node": "a", "kind": "paragraph", "text": "abc"}])
    ops = [document.derive({"type": "text", "place": 0, "start": 1, "length": 1, "text": "XY"}), {"type": "remove", "node": "zz", "other": "paragraph", "place": 0, "to": None, "before": "", "after": None}]
    before = document.hash()
    with pytest.raises(replay.Refused):
        document.apply_all(ops)
    assert document.hash() == before


@pytest.fixture(scope="module")
def made(spark):
    """Documents with histories of commits, batches, undos and redos; and what a list of states says that they lead to."""
    rng = random.Random(9)
    docs, commands, ends = [], [], {}
    for d in range(12):
        start = blocks(rng.randrange(1, 5), rng)
        docs.append((d, start))
        states, at, revision = [start], 0, 0
        for request in range(rng.randrange(0, 60)):
            kind = rng.choice(["commit", "commit", "batch", "undo", "redo"])
            if kind in ("undo", "redo"):
                commands.append((d, request, 0, kind, *[None] * 7))
                to = at + (1 if kind == "redo" else -1)
                if 0 <= to < len(states):
                    at, revision = to, revision + 1
                continue
            cs = [command(rng, f"{request}-{k}") for k in range(3 if kind == "batch" else 1)]
            commands += [(d, request, k, *[c[x] for x in replay.COMMAND]) for k, c in enumerate(cs)]
            document = replay.Document(states[at])
            try:
                for c in cs:
                    document.apply(document.derive(c))
            except replay.Refused:
                continue
            states[at + 1 :] = [document.blocks()]
            at, revision = at + 1, revision + 1
        ends[d] = states[at], revision, at, len(states) - 1 - at
    documents = spark.createDataFrame(docs, f"doc_id long, blocks array<{replay.BLOCK}>")
    rows = spark.createDataFrame(commands, "doc_id long, request long, seq long, type string, place long, start long, length long, to long, kind string, text string, node string").repartition(3)
    return documents, rows, ends


def heads(found):
    return {r["doc_id"]: ([b.asDict() for b in r["blocks"]], r["revision"], r["applied"], r["redoable"]) for r in found.where("code is null").collect()}


@pytest.mark.parametrize("every", [0, 1, 5])
def test_recovery_is_replay_whatever_the_snapshots(made, every):
    documents, commands, ends = made
    done = replay.commit(documents, commands, every).cache()
    snapshots, log = replay.snapshots_of(done), replay.log_of(done)
    assert heads(replay.recover(snapshots, log)) == ends
    # transactions twice over are the same ones
    assert heads(replay.recover(snapshots, log.union(log))) == ends
    if every:
        # a newest snapshot that doesn't hold is passed over
        broken = snapshots.withColumn("hash", F.when(F.col("revision") > 7, "broken").otherwise(F.col("hash")))
        found = replay.recover(broken, log)
        assert heads(found) == ends
        assert found.agg(F.max("base")).first()[0] <= 7
    done.unpersist()


def test_inverses_as_columns(made):
    documents, commands, _ = made
    done = replay.commit(documents, commands).where("effect = 'undo' and code is null").select("doc_id", "entry", F.col("forward").alias("undone"))
    entries = replay.commit(documents, commands).where("effect = 'commit' and code is null").select("doc_id", "entry", replay.inverses(F.col("forward")).alias("wanted"))
    both = done.join(entries, ["doc_id", "entry"])
    assert both.count() == done.count() > 20
    assert both.where("undone <> wanted").isEmpty()


def test_what_is_wrong_stops_its_document_alone(made):
    documents, commands, ends = made
    done = replay.commit(documents, commands).cache()
    snapshots, log = replay.snapshots_of(done), replay.log_of(done)
    long = sorted(d for d, e in ends.items() if e[1] >= 6)[:6]
    gap, conflict, chained, tampered, target, none = long
    later = F.col("revision") == 4
    of = lambda d: (F.col("doc_id") == d) & later
    other = log.where(of(conflict)).withColumn("after_hash", F.lit("other"))
    wrong = log.where(~of(gap)).union(other)
    wrong = wrong.withColumn("before_hash", F.when(of(chained), "other").otherwise(F.col("before_hash"))).withColumn("after_hash", F.when(of(tampered), "other").otherwise(F.col("after_hash")))
    lost = F.transform("forward", lambda op: op.withField("node", F.lit("nowhere")).withField("type", F.lit("kind")))
    wrong = wrong.withColumn("forward", F.when(of(target), lost).otherwise(F.col("forward"))).withColumn("effect", F.when(of(target), "commit").otherwise(F.col("effect")))
    found = replay.recover(snapshots.where(F.col("doc_id") != none), wrong)
    codes = {r["doc_id"]: (r["code"], r["revision"], r["blocks"]) for r in found.where("code is not null").collect()}
    assert codes.pop(gap) == ("revision_gap", 3, None)
    assert codes.pop(conflict)[0] in ("revision_conflict", "hash_mismatch")
    assert codes.pop(chained) == ("hash_conflict", 3, None)
    assert codes.pop(tampered) == ("hash_mismatch", 3, None)
    assert codes.pop(target) == ("invalid_target", 3, None)
    assert codes.pop(none)[0] == "no_snapshot"
    assert not codes
    assert heads(found) == {d: e for d, e in ends.items() if d not in long}
    # an undo that isn't the history's next
    undone = log.where("effect = 'undo'").groupBy("doc_id").agg(F.min("revision").alias("r"))
    wrong = log.join(undone, "doc_id", "left").withColumn("entry", F.when(F.col("revision") == F.col("r"), -5).otherwise(F.col("entry"))).drop("r")
    assert {r["code"] for r in replay.recover(snapshots, wrong).where("code is not null").collect()} == {"history_conflict"}
    done.unpersist()


def test_empty_tables_and_unknown_documents(made):
    documents, commands, ends = made
    done = replay.commit(documents, commands.where("false"))
    assert heads(replay.recover(replay.snapshots_of(done), replay.log_of(done))) == {r["doc_id"]: ([b.asDict() for b in r["blocks"]], 0, 0, 0) for r in documents.collect()}
    assert replay.commit(documents.where("false"), commands).count() == 0
    twice = documents.withColumn("blocks", F.concat("blocks", "blocks"))
    assert {r["code"] for r in replay.commit(twice, commands).collect()} == {"duplicate_node"}


def test_documents_and_commands_that_were_dealt_before(spark):
    """Both sides grouped by document already, in different numbers of partitions: commands still meet their document."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a").alias("node"), F.lit("paragraph").alias("kind"), F.lit("").alias("text"))
    documents = docs.groupBy("doc_id").agg(F.collect_list(F.struct("node", "kind", "text")).alias("blocks"))
    asked = spark.range(40_000).groupBy((F.col("id") % 400).alias("doc_id"), F.floor(F.col("id") / 400).alias("request")).agg(F.count("*").alias("n"))
    commands = asked.select("doc_id", "request", F.lit(0).alias("seq"), F.lit("text").alias("type"), F.lit(0).alias("place"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).alias("to"), F.lit("").alias("kind"), F.lit("x").alias("text"), F.lit("").alias("node"))
    done = replay.commit(documents.repartition(3, "doc_id"), commands.repartition(7, "doc_id"))
    assert done.where("code is null").groupBy("doc_id").agg(F.max("revision").alias("r")).where("r = 100").count() == 400


def test_histories_that_only_the_log_has(made):
    documents, commands, ends = made
    done = replay.commit(documents, commands, 5, histories=False).cache()
    snapshots, log = replay.snapshots_of(done), replay.log_of(done)
    assert snapshots.where("entries is not null").isEmpty()
    assert heads(replay.recover(snapshots, log.union(log))) == ends
    codes = lambda log: {r["code"] for r in replay.recover(snapshots.where("revision > 0"), log).where("code is not null").collect()} - {"no_snapshot"}
    assert codes(log) == set() and codes(log.where("revision > 2")) == {"revision_gap"} and codes(log.where("revision > 5")) == {"revision_gap"}
    done.unpersist()


@pytest.mark.parametrize("name", ["recover_blocks", "undo_blocks"])
def test_commands_are_carried_out_once(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
