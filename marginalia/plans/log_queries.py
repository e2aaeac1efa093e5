"""Queries over the edit log. A user's events stand for a document's transactions: the place by time is the revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import identity, log
from ..registry import query, read

LOG = """
WITH log AS (SELECT user_id, event_id, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events)"""


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "props", F.row_number().over(w).cast("long").alias("revision"))


def cents():
    return F.round(F.col("value") * 100).cast("long")


@query(
    LOG
    + """,
r AS (SELECT user_id, revision - revision // 40 AS rev, CASE WHEN event_id % 19 = 0 THEN -1 ELSE revision - 1 END AS b, revision AS a FROM log WHERE event_id % 23 <> 0),
l AS (SELECT *, lag(rev) OVER w AS pr, lag(a) OVER w AS pa FROM r WINDOW w AS (PARTITION BY user_id ORDER BY rev, a))
SELECT user_id, count(*) AS revisions, count(*) FILTER (rev - pr > 1) AS gaps, count(*) FILTER (rev = pr) AS repeats, count(*) FILTER (rev - pr = 1 AND b IS DISTINCT FROM pa) AS breaks,
min(CASE WHEN rev - pr > 1 OR (rev - pr = 1 AND b IS DISTINCT FROM pa) THEN rev END) AS first_bad FROM l GROUP BY user_id"""
)
def revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity of logs with rows missing, revisions repeated and hashes changed."""
    rows = log_of(spark, sf_dir).where("event_id % 23 <> 0")
    rows = rows.select("user_id", F.expr("revision - revision div 40").alias("rev"), F.when(F.col("event_id") % 19 == 0, -1).otherwise(F.col("revision") - 1).alias("b"), F.col("revision").alias("a"))
    # repeats are put in order by what they leave
    w = Window.partitionBy("user_id").orderBy("rev", "a")
    gap, broken = F.col("rev") - F.col("pr") > 1, (F.col("rev") - F.col("pr") == 1) & ~F.col("b").eqNullSafe(F.col("pa"))
    rows = rows.withColumn("pr", F.lag("rev").over(w)).withColumn("pa", F.lag("a").over(w))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("revisions"), F.count_if(gap).alias("gaps"), F.count_if(F.col("rev") == F.col("pr")).alias("repeats"), F.count_if(broken).alias("breaks"), F.min(F.when(gap | broken, F.col("rev"))).alias("first_bad")
    )


@query(
    LOG
    + """, r AS (SELECT *, lag(revision) OVER w AS pr, lag(event_id) OVER w AS pa, CASE WHEN event_id % 19 = 0 THEN NULL ELSE lag(event_id) OVER w END AS b FROM log WINDOW w AS (PARTITION BY user_id ORDER BY revision))
SELECT user_id, count(*) AS revisions, 0::BIGINT AS gaps, 0::BIGINT AS repeats, count(*) FILTER (revision - pr = 1 AND b IS DISTINCT FROM pa) AS breaks, min(CASE WHEN revision - pr = 1 AND b IS DISTINCT FROM pa THEN revision END) AS first_bad FROM r GROUP BY user_id"""
)
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before-hashes against the after-hash of the row before, some of them lost."""
    rows = log_of(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("revision")
    rows = rows.withColumn("before", F.when(F.col("event_id") % 19 != 0, F.lag("event_id").over(w)))
    return log.chain(rows, "user_id", "revision", F.col("before"), F.col("event_id"))


@query(
    """
SELECT user_id, event_type, count(*) AS records, count(DISTINCT props) AS contents, CASE WHEN count(DISTINCT props) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'idempotent' ELSE 'single' END AS status
FROM events GROUP BY user_id, event_type"""
)
def reconcile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.reconcile(read(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("props"))


@query(
    """
WITH g AS (SELECT sha256(text) AS h, count(*) AS n, count(DISTINCT lang) AS c, min(lang) AS lang FROM documents GROUP BY 1)
SELECT 'kept' AS part, h AS content_hash, lang FROM g WHERE c = 1 UNION ALL SELECT 'conflict', h, NULL FROM g WHERE c > 1"""
)
def dedupe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by content hash: copies collapse where they agree on the language, and are an error where not."""
    docs = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "lang")
    good, bad = identity.dedupe(docs, ["content_hash"], F.col("lang"))
    return good.select(F.lit("kept").alias("part"), "content_hash", "lang").unionByName(bad.select(F.lit("conflict").alias("part"), "content_hash", F.lit(None).cast("string").alias("lang")))


@query(
    """
WITH d AS (SELECT doc_id % 500 AS slot, sha256(text) AS h FROM documents), a AS (SELECT * FROM d WHERE slot % 3 <> 0), b AS (SELECT * FROM d WHERE slot % 3 = 0 OR slot % 2 = 0),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT slot, count(*) AS records, count(DISTINCT h) AS contents, CASE WHEN count(DISTINCT h) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'idempotent' ELSE 'single' END AS status FROM u GROUP BY slot"""
)
def guarded_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping sides that together are all documents."""
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("slot"), F.sha2("text", 256).alias("h"))
    return identity.reconcile(docs.where("slot % 3 <> 0").unionByName(docs.where("slot % 3 = 0 or slot % 2 = 0")), ["slot"], F.col("h"))


@query(
    """
SELECT user_id, count(*) AS records, sum(octet_length(encode(props)))::BIGINT AS bytes, CASE WHEN count(*) > 60 THEN 'record_limit' WHEN sum(octet_length(encode(props))) > 1500 THEN 'byte_limit' END AS code FROM events GROUP BY user_id"""
)
def record_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.budget(read(spark, sf_dir, "events"), ["user_id"], F.octet_length("props"), 60, 1500)


@query(
    """
WITH e AS (SELECT source, sha256(text) AS h, octet_length(encode(text)) AS n FROM documents), u AS (SELECT DISTINCT source, h, n FROM e)
SELECT source, count(*) AS records, sum(n)::BIGINT AS bytes, CASE WHEN count(*) > 10000 THEN 'record_limit' WHEN sum(n) > 67108864 THEN 'byte_limit' END AS code FROM u GROUP BY source"""
)
def commit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("n"))
    old, new = (rows.where(F.col("doc_id") % 2 == k).drop("doc_id") for k in (0, 1))
    return identity.commit_budget(old, new, ["source"], "h", F.col("n"))


@query(
    """
WITH r AS (SELECT DISTINCT source, doc_id FROM documents), d AS (SELECT DISTINCT source, doc_id FROM documents JOIN labels USING (doc_id)), f AS (SELECT coalesce(r.source, d.source) AS source, r.doc_id AS a, d.doc_id AS b FROM r FULL JOIN d ON r.source = d.source AND r.doc_id = d.doc_id)
SELECT source, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS extra, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS equal FROM f GROUP BY source"""
)
def required_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that need a decision against those that have one, by source."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id")
    return identity.same_set(docs, docs.join(read(spark, sf_dir, "labels"), "doc_id"), ["source"], "doc_id")


@query(
    """
WITH a AS (SELECT doc_id AS asset_id, sha256(text) AS content_hash, length(text)::BIGINT + CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END AS size FROM documents),
r AS (SELECT sha256(text) AS content_hash, length(text)::BIGINT AS size FROM documents WHERE doc_id % 17 <> 0), g AS (SELECT content_hash, count(*) AS n, min(size) AS lo, max(size) AS hi FROM r GROUP BY 1)
SELECT asset_id, CASE WHEN n IS NULL THEN 'missing' WHEN lo <> hi THEN 'divergent' WHEN lo <> size THEN 'size_mismatch' ELSE 'ok' END AS code FROM a LEFT JOIN g USING (content_hash)"""
)
def asset_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    size = F.length("text").cast("long")
    descriptors = docs.select(F.col("doc_id").alias("asset_id"), F.sha2("text", 256).alias("content_hash"), (size + F.when(F.col("doc_id") % 31 == 0, 1).otherwise(0)).alias("size"))
    records = docs.where("doc_id % 17 <> 0").select(F.sha2("text", 256).alias("content_hash"), size.alias("size"))
    return identity.completeness(descriptors, records, "content_hash", "size").select("asset_id", "code")


@query(
    """
WITH h AS (SELECT o_custkey AS k, max(o_orderkey) AS head FROM orders GROUP BY 1), q AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE head - (c_custkey % 4) + 1 END AS expected, CASE WHEN c_custkey % 5 = 0 THEN head ELSE c_custkey END AS proposed FROM customer LEFT JOIN h ON k = c_custkey)
SELECT q.k AS document, CASE WHEN head IS NULL AND expected IS NULL THEN 'create' WHEN head = proposed THEN 'retry' WHEN head = expected THEN 'extend' ELSE 'conflict' END AS code FROM q LEFT JOIN h ON q.k = h.k"""
)
def head_compare_and_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document")).agg(F.max("o_orderkey").alias("head"))
    c = F.col("document")
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document")).join(heads, "document", "left")
    asked = asked.select("document", F.when(c % 4 != 0, F.col("head") - c % 4 + 1).alias("expected"), F.when(c % 5 == 0, F.col("head")).otherwise(c).alias("proposed"))
    return identity.compare_and_swap(asked, heads, "document").select("document", "code")


@query(
    """
WITH t AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 11 <> 0), a AS (SELECT event_id, user_id, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE event_type END AS event_type FROM events WHERE event_id % 7 <> 0)
SELECT coalesce(t.event_id, a.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'unaudited' WHEN t.event_id IS NULL THEN 'orphan' WHEN t.user_id = a.user_id AND t.event_type = a.event_type THEN 'bound' ELSE 'mismatch' END AS code
FROM t FULL JOIN a ON t.event_id = a.event_id"""
)
def audit_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    audits = events.where("event_id % 7 <> 0").withColumn("event_type", F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.col("event_type")))
    return log.bind_audits(events.where("event_id % 11 <> 0"), audits, "event_id", ["user_id", "event_type"])


@query(LOG + " SELECT event_id, user_id, revision FROM log l WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM log a WHERE a.user_id = l.user_id AND a.revision = l.revision AND (a.revision % 10 = 0 OR a.event_id % 3 = 0))")
def audit_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits whose revision is a snapshot's or a transaction's."""
    rows = log_of(spark, sf_dir)
    found = log.anchored(rows.where("event_type = 'click'"), [rows.where("revision % 10 = 0"), rows.where("event_id % 3 = 0")], ["user_id", "revision"])
    return found.select("event_id", "user_id", "revision")


@query(
    LOG
    + """, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY revision DESC) - 1 AS passed_over FROM log WHERE revision % 5 = 0),
v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY passed_over) AS n FROM s WHERE event_id % 4 <> 0)
SELECT user_id, revision, passed_over FROM v WHERE n = 1"""
)
def newest_valid_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = log_of(spark, sf_dir).where("revision % 5 = 0")
    return log.newest_valid(snapshots, "user_id", [F.desc("revision")], F.col("event_id") % 4 != 0).select("user_id", "revision", F.col("passed_over").cast("long").alias("passed_over"))


@query(
    LOG
    + """, c AS (SELECT *, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY revision) AS state, max(CASE WHEN revision % 5 = 0 AND event_id % 4 <> 0 THEN revision END) OVER (PARTITION BY user_id) AS base FROM log)
SELECT user_id, max(revision) AS revision, (max(revision) - any_value(base))::BIGINT AS replayed, arg_max(state, revision)::BIGINT AS state FROM c WHERE base IS NOT NULL GROUP BY user_id"""
)
def recover_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest valid snapshot of each document and the log after it: the head, as if all had been replayed."""
    rows = log_of(spark, sf_dir).withColumn("cents", cents())
    w = Window.partitionBy("user_id").orderBy("revision").rowsBetween(Window.unboundedPreceding, 0)
    snapshots = log.newest_valid(rows.withColumn("state", F.sum("cents").over(w)).where("revision % 5 = 0"), "user_id", [F.desc("revision")], F.col("event_id") % 4 != 0)
    return log.recover(rows, snapshots.select("user_id", F.col("revision").alias("base_revision"), "state"), "user_id", "revision", F.col("cents"))


@query(
    LOG
    + """, c AS (SELECT *, octet_length(encode(props)) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY revision) AS part FROM log),
d AS (SELECT user_id, revision, event_type, row_number() OVER (PARTITION BY user_id, part ORDER BY revision) - CASE WHEN part > 0 THEN 1 ELSE 0 END AS since_records,
sum(n) OVER (PARTITION BY user_id, part ORDER BY revision) - CASE WHEN part > 0 THEN first_value(n) OVER (PARTITION BY user_id, part ORDER BY revision) ELSE 0 END AS since_bytes FROM c)
SELECT user_id, revision, since_records::BIGINT AS since_records, since_bytes::BIGINT AS since_bytes, since_records >= 100 OR since_bytes >= 4194304 AS due FROM d"""
)
def checkpoint_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases force a checkpoint."""
    return log.checkpoint_due(log_of(spark, sf_dir), "user_id", "revision", F.octet_length("props"), F.col("event_type") == "purchase").select("user_id", "revision", "since_records", "since_bytes", "due")


UNDO, REDO = "kind = 'undo'", "kind = 'redo'"


@query(
    "WITH RECURSIVE "
    + LOG.strip().removeprefix("WITH ")
    + f""", k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY revision) AS i, CASE WHEN event_id % 4 = 1 THEN 'undo' WHEN event_id % 9 = 2 THEN 'redo' ELSE 'commit' END AS kind FROM log),
f AS (SELECT user_id, 0::BIGINT AS i, []::BIGINT[] AS stack, 0::BIGINT AS n, 0::BIGINT AS ignored FROM (SELECT DISTINCT user_id FROM k)
UNION ALL SELECT f.user_id, k.i, CASE WHEN {UNDO} OR {REDO} THEN stack ELSE list_append(stack[1:n], event_id) END,
CASE WHEN {UNDO} THEN greatest(n - 1, 0) WHEN {REDO} THEN least(n + 1, len(stack)) ELSE n + 1 END, ignored + CASE WHEN {UNDO} AND n = 0 OR {REDO} AND n = len(stack) THEN 1 ELSE 0 END
FROM f JOIN k ON k.user_id = f.user_id AND k.i = f.i + 1), e AS (SELECT user_id, arg_max(stack, i) AS stack, arg_max(n, i) AS n, arg_max(ignored, i) AS ignored FROM f GROUP BY user_id)
SELECT user_id, n AS applied, len(stack) - n AS redoable, ignored, CASE WHEN n > 0 THEN stack[n] END AS top FROM e"""
)
def undo_redo_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is applied after a log of commits, undos and redos, and what redo could bring back: a fold in order."""
    kind = F.when(F.col("event_id") % 4 == 1, "undo").when(F.col("event_id") % 9 == 2, "redo").otherwise("commit")
    return log.undo_redo(log_of(spark, sf_dir).withColumn("kind", kind), "user_id", "revision", "kind", "event_id")


@query(LOG + ", h AS (SELECT user_id, max(revision) AS head FROM log GROUP BY 1) SELECT event_id, revision = head AS accepted FROM log JOIN h USING (user_id) WHERE event_type = 'view'")
def stale_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_of(spark, sf_dir)
    return log.stale(rows.where("event_type = 'view'"), rows.groupBy("user_id").agg(F.max("revision").alias("revision")), "user_id", ["revision"]).select("event_id", "accepted")


@query(
    LOG
    + """, f AS (SELECT user_id, command, min(revision) AS first FROM (SELECT user_id, revision, event_type || ':' || (event_id % 50)::VARCHAR AS command FROM log) GROUP BY ALL)
SELECT user_id, command, first AS revision FROM f"""
)
def command_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each command identifier."""
    rows = log_of(spark, sf_dir).withColumn("command", F.concat_ws(":", "event_type", F.col("event_id") % 50))
    return rows.groupBy("user_id", "command").agg(F.min("revision").alias("revision"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id)::BIGINT AS place FROM events")
def audit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_type", "event_id")
    return read(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("place"))
