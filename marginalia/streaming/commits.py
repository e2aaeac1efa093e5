"""Commits that write: batches of a stream against a manifest of heads that is replaced by compare-and-swap.

A store is a folder on a file system whose rename doesn't overwrite, as HDFS's. In log/ each version is one small
file, made whole elsewhere and renamed into place, so of two writers of one version one wins. It names where the
heads of each bucket of documents lie, this version's records, and each writer's last batch. A batch that lost decides
again against the new heads; one that was written before is passed over. Files of a writer that failed between
are named by no version and so aren't part of the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.replay import fold

#: Heads are rewritten bucket by bucket; only those that a batch touches.
BUCKETS = 64
TRIES = 20
COMMIT = "document long, id long, base long, before string, revision long, after string"
HEAD = "document long, revision long, after string"


def path_of(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def system(spark: SparkSession, path: str):
    return path_of(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, store: str) -> dict:
    """The store's last version; version 0 is the empty store."""
    fs, log = system(spark, store), path_of(spark, f"{store}/log")
    names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
    name = max((n for n in names if n.endswith(".json")), default=None)
    if name is None:
        return {"version": 0, "writers": {}, "heads": {}, "records": None}
    stream = fs.open(path_of(spark, f"{store}/log/{name}"))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def put(spark: SparkSession, store: str, entry: dict) -> bool:
    """Whether this entry became its version; another one's may have."""
    fs, made = system(spark, store), path_of(spark, f"{store}/log/.{uuid.uuid4().hex}")
    out = fs.create(made, True)
    out.write(json.dumps(entry, sort_keys=True).encode())
    out.close()
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(fs.makeQualified(made), fs.makeQualified(path_of(spark, f"{store}/log/{entry['version']:012d}.json")), none)
        return True
    except Py4JJavaError as e:
        fs.delete(made, False)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise


def heads(spark: SparkSession, store: str, entry: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Each document's head (revision, after), in all buckets or some."""
    found = (entry or latest(spark, store))["heads"]
    paths = [f"{store}/{folder}/bucket={b}" for b, folder in found.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(HEAD).parquet(*paths) if paths else spark.createDataFrame([], HEAD)


def records(spark: SparkSession, store: str) -> DataFrame:
    """What became of each commit of the store's versions."""
    if not latest(spark, store)["version"]:
        return spark.createDataFrame([], f"{COMMIT}, code string")
    folders = [r[0] for r in spark.read.schema("records string").json(f"{store}/log/*.json").collect()]
    return spark.read.schema(f"{COMMIT}, code string").parquet(*(f"{store}/{f}" for f in folders))


def decide(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """commits with code: ok, where the head is what the commit says it extends; retry, where it is already what the
    commit makes; conflict. One document's commits are taken in order of (revision, id), each against the head that the last left.

    A first commit has a null base and before, and revision 1. Null documents are in conflict.
    """
    asked = heads.join(commits.select("document"), "document", "left_semi")
    now = asked.select("document", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("base"), F.lit(None).cast("string").alias("before"), "revision", "after", F.lit(0).alias("kind"))
    rows = now.unionByName(commits.select(*(c.split(" ")[0] for c in COMMIT.split(", ")), F.lit(1).alias("kind")))

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        head = (None, None)
        for r in rows:
            made = (r["revision"], r["after"])
            if r.pop("kind") == 0:
                head = made
                continue
            if r["document"] is None or r["revision"] is None or r["after"] is None:
                r["code"] = "conflict"
            elif made == head:
                r["code"] = "retry"
            elif head == (r["base"], r["before"]) and r["revision"] == (r["base"] or 0) + 1:
                r["code"], head = "ok", made
            else:
                r["code"] = "conflict"
            yield r

    return fold(rows, "document", ["kind", "revision", "id"], step, f"{COMMIT}, code string")


def commit(batch: DataFrame, store: str, writer: str, batch_id: int) -> dict:
    """Write a batch of commits; the version that has it. Called again with the same batch_id, or a lower one, it does nothing."""
    spark = batch.sparkSession
    for _ in range(TRIES):
        last = latest(spark, store)
        if last["writers"].get(writer, -1) >= batch_id:
            return last
        name = f"{last['version'] + 1:012d}-{uuid.uuid4().hex}"
        decide(batch, heads(spark, store, last)).write.parquet(f"{store}/records/{name}")
        done = spark.read.schema(f"{COMMIT}, code string").parquet(f"{store}/records/{name}")
        bucket = F.pmod(F.xxhash64("document"), F.lit(BUCKETS)).cast("int")
        new = done.where("code = 'ok'").groupBy("document").agg(F.max(F.struct("revision", "after")).alias("h")).select("document", "h.*").withColumn("bucket", bucket)
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # BUCKETS numbers at most
        if touched:
            old = heads(spark, store, last, touched).join(new, "document", "left_anti").withColumn("bucket", bucket)
            old.unionByName(new).repartition("bucket").write.partitionBy("bucket").parquet(f"{store}/heads/{name}")
        entry = {
            "version": last["version"] + 1,
            "writers": {**last["writers"], writer: batch_id},
            "heads": {**last["heads"], **{str(b): f"heads/{name}" for b in touched}},
            "records": f"records/{name}",
        }
        if put(spark, store, entry):
            return entry
        for folder in ("records", "heads"):
            system(spark, store).delete(path_of(spark, f"{store}/{folder}/{name}"), True)
    raise RuntimeError(f"{store} was changed by others {TRIES} times while a batch was written")


def commit_stream(stream: DataFrame, store: str, checkpoint: str, writer: str):
    """A started query that writes each micro-batch of commits to the store once, whatever is retried; it ends with what is there now."""
    return stream.writeStream.foreachBatch(lambda batch, i: commit(batch, store, writer, i) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
