"""Queries over replayed documents. A user's events are commands for the document of that number, whose lines are its blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replay
from ..registry import query, read
from ..sources.shared import keep
from .log_queries import LOG, log_of
from .tree_queries import BLOCKS

TYPES = ("text", "text", "insert", "remove", "move", "kind", "split", "merge")


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of a document in one row; a document is a row of the input to begin with."""
    node = lambda i: F.substring(F.sha2(F.concat_ws(":", "doc_id", i), 256), 1, 12)
    block = lambda t, i: F.struct(i.alias("ordinal"), node(i).alias("node"), F.when(i % 5 == 0, "heading").otherwise("paragraph").alias("kind"), t.alias("text"))
    rows = read(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.transform(F.split("text", "\n"), block).alias("b"))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("b"))).alias("b"))
    return rows.select("doc_id", F.transform("b", lambda x: F.struct(x["node"].alias("node"), x["kind"].alias("kind"), x["text"].alias("text"))).alias("blocks"))


def commands_of(spark: SparkSession, sf_dir: str, history: bool) -> DataFrame:
    """One command a request; with history, some are undo and redo."""
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (e % 8 + 1).cast("int"))
    if history:
        kind = F.when(e % 5 == 2, "undo").when(e % 11 == 3, "redo").otherwise(kind)
    return log_of(spark, sf_dir).select(
        F.col("user_id").alias("doc_id"), F.col("revision").alias("request"), F.lit(0).alias("seq"), kind.alias("type"), (e % 7).alias("place"),
        F.when(e % 8 == 1, 0).otherwise(e % 9).alias("start"), F.when(e % 8 == 1, 3).otherwise(0).alias("length"), F.floor(e / 8).cast("long").alias("to0"),
        F.when(e % 8 == 5, F.when(e % 3 == 0, "heading").otherwise("paragraph")).otherwise("paragraph").alias("kind"),
        F.when(e % 8 == 1, "").otherwise(F.col("props")).alias("text"), F.concat(F.lit("e"), e.cast("string")).alias("node"),
    ).withColumn("to", F.pmod("to0", F.lit(5)))


STATE = """, docs AS (SELECT doc_id, list(struct_pack(node := node, kind := kind, text := text) ORDER BY ordinal) AS b FROM blocks WHERE doc_id IN (SELECT user_id FROM events) GROUP BY doc_id)"""
#: The list of blocks b after event e: u has the block x at place p, and the next one y.
NEXT = """CASE WHEN p >= n + CASE WHEN t = 2 THEN 1 ELSE 0 END THEN b
WHEN t = 0 AND o <= length(x.text) THEN list_concat(list_append(b[1:p], struct_pack(node := x.node, kind := x.kind, text := left(x.text, o) || props || substr(x.text, o + 1))), b[p + 2:])
WHEN t = 1 AND length(x.text) >= 3 THEN list_concat(list_append(b[1:p], struct_pack(node := x.node, kind := x.kind, text := substr(x.text, 4))), b[p + 2:])
WHEN t = 2 THEN list_concat(list_append(b[1:p], struct_pack(node := 'e' || event_id, kind := 'paragraph', text := props)), b[p + 1:])
WHEN t = 3 AND n > 1 THEN list_concat(b[1:p], b[p + 2:])
WHEN t = 4 AND q < n AND q < p THEN list_concat(list_append(b[1:q], x), list_concat(b[q + 1:p], b[p + 2:]))
WHEN t = 4 AND q < n AND q > p THEN list_concat(list_append(list_concat(b[1:p], b[p + 2:q + 1]), x), b[q + 2:])
WHEN t = 5 THEN list_concat(list_append(b[1:p], struct_pack(node := x.node, kind := CASE WHEN event_id % 3 = 0 THEN 'heading' ELSE 'paragraph' END, text := x.text)), b[p + 2:])
WHEN t = 6 AND o <= length(x.text) THEN list_concat(list_append(list_append(b[1:p], struct_pack(node := x.node, kind := x.kind, text := left(x.text, o))),
  struct_pack(node := 'e' || event_id, kind := CASE WHEN x.kind = 'heading' AND o = length(x.text) THEN 'paragraph' ELSE x.kind END, text := substr(x.text, o + 1))), b[p + 2:])
WHEN t = 7 AND p + 1 < n AND x.kind = y.kind THEN list_concat(list_append(b[1:p], struct_pack(node := x.node, kind := x.kind, text := x.text || y.text)), b[p + 3:])
ELSE b END"""
EVENT = "event_id, props, event_id % 8 AS t, event_id % 7 AS p, event_id % 9 AS o, (event_id // 8) % 5 AS q"
AT = "f.b[event_id % 7 + 1] AS x, f.b[event_id % 7 + 2] AS y, len(f.b) AS n"
#: State after state of each document: i is the revision, b the blocks; h and c are the states gone through and the place among them.
START = BLOCKS.replace("WITH ", "WITH RECURSIVE ", 1) + STATE + ", " + LOG.strip().removeprefix("WITH ")
ENDS = """, e AS (SELECT doc_id, arg_max(b, i) AS b FROM f GROUP BY doc_id), o AS (SELECT doc_id, unnest(range(len(b))) AS ordinal, unnest(b) AS x FROM e)
SELECT doc_id, ordinal, x.node AS node, x.kind AS kind, sha256(x.text)[1:12] AS text FROM o
UNION ALL SELECT doc_id, ordinal, node, kind, sha256(text)[1:12] FROM blocks WHERE doc_id NOT IN (SELECT user_id FROM events)"""
REPLAY = START + f""", f AS (SELECT doc_id, 0::BIGINT AS i, b FROM docs
UNION ALL SELECT doc_id, i, {NEXT} AS b FROM (SELECT f.doc_id, revision AS i, f.b, {EVENT}, {AT} FROM f JOIN log ON log.user_id = f.doc_id AND log.revision = f.i + 1) u){ENDS}"""
UNDONE = START + f""", f AS (SELECT doc_id, 0::BIGINT AS i, b, [b] AS h, 1 AS c FROM docs
UNION ALL SELECT doc_id, i, CASE WHEN undo THEN h[greatest(c - 1, 1)] WHEN redo THEN h[least(c + 1, len(h))] ELSE z END,
CASE WHEN undo OR redo OR z = b THEN h ELSE list_append(h[1:c], z) END, CASE WHEN undo THEN greatest(c - 1, 1) WHEN redo THEN least(c + 1, len(h)) WHEN z = b THEN c ELSE c + 1 END
FROM (SELECT *, event_id % 5 = 2 AS undo, event_id % 5 <> 2 AND event_id % 11 = 3 AS redo, {NEXT} AS z
FROM (SELECT f.doc_id, revision AS i, f.b, f.h, f.c, {EVENT}, {AT} FROM f JOIN log ON log.user_id = f.doc_id AND log.revision = f.i + 1) u) v){ENDS}"""


def digested(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", F.substring(F.sha2("text", 256), 1, 12))


@query(REPLAY)
def recover_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document at its head: each command as a typed transaction with its inverse and hashes, a snapshot every 16 revisions
    (every third one broken), and what comes after the newest that holds replayed."""
    # snapshots and log are both read from what is written, so commands are carried out once
    made = keep(replay.commit(documents_of(spark, sf_dir), commands_of(spark, sf_dir, history=False), every=16, histories=False), "transactions")
    snapshots = replay.snapshots_of(made).withColumn("hash", F.when((F.col("doc_id") + F.col("revision") / 16) % 3 == 0, F.when(F.col("revision") > 0, "broken").otherwise(F.col("hash"))).otherwise(F.col("hash")))
    return digested(replay.blocks_of(replay.recover(snapshots, replay.log_of(made))))


@query(UNDONE)
def undo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document at its head after commits, undos and redos, whose inverses come from the log: only the state at revision 0 is given, and all is replayed."""
    made = keep(replay.commit(documents_of(spark, sf_dir), commands_of(spark, sf_dir, history=True), histories=False), "transactions")
    return digested(replay.blocks_of(replay.recover(replay.snapshots_of(made), replay.log_of(made))))


@query(
    START
    + f""", f AS (SELECT doc_id, 0::BIGINT AS i, b, 'create' AS code FROM docs
UNION ALL SELECT doc_id, i, z, CASE WHEN z = b THEN 'refused' ELSE 'done' END FROM (SELECT *, {NEXT} AS z FROM (SELECT f.doc_id, revision AS i, f.b, {EVENT}, {AT} FROM f JOIN log ON log.user_id = f.doc_id AND log.revision = f.i + 1) u) v)
SELECT doc_id, i AS request, code, sum(CASE WHEN code = 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS revision,
sha256(array_to_string(list_transform(b, lambda y: sha256(y.node || chr(31) || y.kind || chr(31) || y.text)), ',')) AS after_hash FROM f WHERE i > 0"""
)
def commit_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each command became: its revision, and the hash of the document after it. Every stored list of operations is inverted twice on the way, which changes nothing."""
    made = replay.commit(documents_of(spark, sf_dir), commands_of(spark, sf_dir, history=False)).where("request is not null")
    twice = replay.inverses(replay.inverses(F.col("forward")))
    code = F.when(F.col("code").isNotNull(), "refused").when(twice == F.col("forward"), "done").otherwise("not_invertible")
    return made.select("doc_id", "request", code.alias("code"), "revision", "after_hash")
