"""Streaming queries, drained over the events that are there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, read
from ..streaming import commits, sessions, state


def folder(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Only a local session may go without; it gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return where or spark.sparkContext._jvm.System.getProperty("java.io.tmpdir") + "/marginalia-checkpoints"


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT user_id, event_type || ':' || (event_id % 50)::VARCHAR AS command FROM events GROUP BY ALL")
def stream_command_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_of(spark, sf_dir).select("user_id", F.concat_ws(":", "event_type", F.col("event_id") % 50).alias("command"))
    return state.drained(state.first_of_each_command(rows, ["user_id", "command"]), folder(spark))


@query("SELECT user_id AS key, max(event_id) AS generation FROM events GROUP BY 1")
def stream_newest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last accepted generation of each key."""
    rows = events_of(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("generation"), F.col("event_id").alias("result"))
    return state.drained(state.newest_generation(rows), folder(spark)).where("accepted").groupBy("key").agg(F.max("generation").alias("generation"))


@query(
    """
WITH e AS (SELECT user_id AS key, event_id AS id, epoch(ts)::BIGINT AS sec, event_type IN ('signup', 'view') AS issue FROM events),
i AS (SELECT *, max(CASE WHEN issue THEN sec END) OVER w AS issued, sum(CASE WHEN issue THEN 1 ELSE 0 END) OVER w AS n FROM e WINDOW w AS (PARTITION BY key ORDER BY sec, id)),
r AS (SELECT *, sum(CASE WHEN NOT issue AND n > 0 AND sec - issued <= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY key, n ORDER BY sec, id) AS used FROM i)
SELECT key, id, CASE WHEN issue THEN 'issued' WHEN n = 0 THEN 'unknown' WHEN used > 1 OR (used = 1 AND sec - issued > 300) THEN 'spent' WHEN sec - issued > 300 THEN 'expired' ELSE 'ok' END AS code FROM r"""
)
def stream_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type").isin("signup", "view"), "issue").otherwise("redeem")
    rows = events_of(spark, sf_dir).select(F.col("user_id").alias("key"), F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"), action.alias("action"), F.col("event_id").alias("id"))
    return state.drained(state.redeem_receipts(rows), folder(spark))


@query(
    """
WITH e AS (SELECT user_id AS document, event_id AS id, row_number() OVER w AS n, min(CASE WHEN event_id % 13 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT document, count(*) AS offered, count(*) FILTER (bad IS NULL OR id < bad) AS written, max(CASE WHEN bad IS NULL OR id < bad THEN n END)::BIGINT AS revision, sha256(document || ':' || max(CASE WHEN bad IS NULL OR id < bad THEN n END)) AS after FROM e GROUP BY document"""
)
def stream_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as commits, each extending the last one's; one that extends something else ends its document's chain. Heads and what was written, as the store has them after the stream came twice."""
    where = f"{folder(spark)}/commits-{uuid.uuid4().hex}"
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    h = lambda n: F.sha2(F.concat_ws(":", "user_id", n), 256)
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), n.alias("n"))
    before = F.when(F.col("id") % 13 == 0, F.lit("another")).when(F.col("n") > 1, h(F.col("n") - 1))
    rows.select(F.col("user_id").alias("document"), "id", F.when(F.col("n") > 1, F.col("n") - 1).alias("base"), before.alias("before"), F.col("n").alias("revision"), h(F.col("n")).alias("after")).write.parquet(f"{where}/in")
    for again in ("once", "twice"):
        stream = spark.readStream.schema(commits.COMMIT).parquet(f"{where}/in")
        commits.commit_stream(stream, f"{where}/store", f"{where}/{again}", "events").awaitTermination()
    written = commits.records(spark, f"{where}/store").groupBy("document").agg(F.count("*").alias("offered"), F.count_if(F.col("code") == "ok").alias("written"))
    return written.join(commits.heads(spark, f"{where}/store"), "document", "left")


@query("SELECT user_id AS key, count(*) AS generation FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 1 HOUR < (SELECT max(ts) FROM events)")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose session ended an hour after their last event, with the number of events in it."""
    rocks = spark.newSession()  # the store's provider is a session's setting, and the caller's is left alone
    rocks.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKS)
    rows = events_of(rocks, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.lit(None).cast("long").alias("base"), F.col("event_id").alias("value"))
    found = state.drained(sessions.sessions(rows, ttl=3600), folder(spark))
    return found.where("code = 'expired'").select("key", "generation")
