"""Queries over references: trees with broken parents, graphs with cycles, frames of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..registry import query, read
from ..sources import envelope


@query(
    """
WITH RECURSIVE n AS (SELECT o_custkey AS doc, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders),
t AS (SELECT n.doc, n.node, CASE WHEN n.i = 1 THEN CASE n.doc % 7 WHEN 0 THEN n.last WHEN 1 THEN -1 END ELSE p.node END AS parent FROM n LEFT JOIN n p ON p.doc = n.doc AND p.i = CASE WHEN n.doc % 3 = 0 THEN n.i - 1 ELSE n.i // 2 END),
up AS (SELECT doc, node, parent AS at_, 1 AS h, node AS below FROM t UNION ALL SELECT up.doc, up.node, t.parent, h + 1, t.node FROM up JOIN t ON t.doc = up.doc AND t.node = up.at_ WHERE h < 100)
SELECT doc, node, max(CASE WHEN at_ IS NULL OR at_ = -1 THEN h - 1 END)::BIGINT AS depth, max(CASE WHEN at_ IS NULL OR at_ = -1 THEN below END) AS top,
CASE WHEN bool_or(coalesce(at_ = node, false)) THEN 'cycle' WHEN bool_and(at_ IS NOT NULL AND at_ <> -1) THEN 'under_cycle' WHEN bool_or(coalesce(at_ = -1, false)) THEN CASE WHEN max(h) = 1 THEN 'dangling' ELSE 'unreachable' END WHEN max(h) - 1 > 6 THEN 'too_deep' END AS code FROM up GROUP BY doc, node"""
)
def tree_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as chains or heaps; some first ones have the last as their parent, or one that isn't there. Six levels are allowed."""
    w = Window.partitionBy("doc")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("node")).withColumn("i", F.row_number().over(w.orderBy("node"))).withColumn("last", F.max("node").over(w))
    up = rows.withColumn("up", F.when(F.col("doc") % 3 == 0, F.col("i") - 1).otherwise(F.floor(F.col("i") / 2)).cast("int"))
    above = rows.select("doc", F.col("i").alias("up"), F.col("node").alias("above"))
    first = F.when(F.col("doc") % 7 == 0, F.col("last")).when(F.col("doc") % 7 == 1, F.lit(-1))
    nodes = up.join(above, ["doc", "up"], "left").select("doc", "node", F.when(F.col("i") == 1, first).otherwise(F.col("above")).alias("parent"))
    return graph.audit_tree(nodes, "doc", "node", "parent", 6)


@query(
    """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey // 8 AS doc, l_partkey % 32 AS a, l_suppkey % 32 AS b FROM lineitem), n AS (SELECT DISTINCT doc, a AS node FROM e),
r AS (SELECT doc, a, b FROM e UNION SELECT r.doc, r.a, e.b FROM r JOIN e ON e.doc = r.doc AND e.a = r.b),
c AS (SELECT doc, a AS node FROM r WHERE a = b), o AS (SELECT DISTINCT r.doc, r.a AS node FROM r JOIN c ON c.doc = r.doc AND c.node = r.b), i AS (SELECT DISTINCT r.doc, r.b AS node FROM r JOIN c ON c.doc = r.doc AND c.node = r.a),
m AS (SELECT DISTINCT doc, a AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc = e.doc AND n.node = e.b))
SELECT n.doc, n.node, CASE WHEN o.node IS NOT NULL AND i.node IS NOT NULL THEN 'cycle' WHEN m.node IS NOT NULL THEN 'dangling' END AS code FROM n LEFT JOIN o USING (doc, node) LEFT JOIN i USING (doc, node) LEFT JOIN m USING (doc, node)"""
)
def reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of eight orders each as references from parts to suppliers, both numbered anew."""
    edges = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("doc"), (F.col("l_partkey") % 32).alias("a"), (F.col("l_suppkey") % 32).alias("b"))
    return graph.audit_references(edges.select("doc", F.col("a").alias("node")), edges, "doc", "node", "a", "b")


HEX = envelope.MAGIC.hex().upper()
FRAMES = f"""
WITH d AS (SELECT doc_id, doc_id % 10 AS k, n_chars % 5 AS revision, hex(text) AS t, strlen(text) AS n, sha256(text) AS h, '{{"document_id":' || (doc_id + CASE WHEN doc_id % 10 = 7 THEN 1 ELSE 0 END) || ',"revision":' || (n_chars % 5) || ',"source_hash":"' || sha256(text) || '","payload_hash":"' || sha256(text) || '"}}' AS j FROM documents),
m AS (SELECT *, CASE WHEN k = 6 THEN '{{ ' || j[2:] ELSE j END AS man FROM d),
w AS (SELECT *, '{HEX}' || printf('%08X', strlen(man)) || printf('%08X', n) || hex(man) || t AS whole FROM m),
f AS (SELECT doc_id, revision, CASE k WHEN 2 THEN whole[:-3] WHEN 3 THEN whole || '00' WHEN 4 THEN '58' || whole[3:] WHEN 5 THEN whole[:-3] || 'FE' WHEN 8 THEN '' WHEN 9 THEN hex('%PDF-') || t ELSE whole END AS f FROM w),
l AS (SELECT *, length(f) // 2 AS n, ('0x' || nullif(f[{len(HEX) + 1}:{len(HEX) + 8}], ''))::BIGINT AS a, ('0x' || nullif(f[{len(HEX) + 9}:{len(HEX) + 16}], ''))::BIGINT AS b FROM f WHERE f[:{len(HEX)}] = '{HEX}'),
p AS (SELECT *, CASE WHEN {len(HEX) // 2 + 8} + a + b = n THEN decode(unhex(f[{len(HEX) + 17}:{len(HEX) + 16} + 2 * a])) END AS man, f[{len(HEX) + 17} + 2 * a:] AS payload FROM l),
c AS (SELECT doc_id, CASE WHEN {len(HEX) // 2 + 8} + a + b > n THEN 'truncated' WHEN {len(HEX) // 2 + 8} + a + b < n THEN 'length' WHEN NOT regexp_full_match(man, '\\{{"document_id":\\d+,"revision":\\d+,"source_hash":"[0-9a-f]*","payload_hash":"[0-9a-f]*"\\}}') THEN 'noncanonical_manifest' WHEN b = 0 THEN 'missing_payload'
WHEN man->>'payload_hash' <> sha256(unhex(payload)) THEN 'hash_mismatch' WHEN (man->>'document_id')::BIGINT <> doc_id THEN 'document_mismatch' WHEN (man->>'revision')::BIGINT <> revision THEN 'revision_mismatch' END AS code, b FROM p)"""


@query(FRAMES + " SELECT f.doc_id, CASE WHEN f = '' THEN 'missing' WHEN starts_with(f, hex('%PDF-')) THEN 'external' WHEN c.doc_id IS NULL THEN 'magic' ELSE c.code END AS code, CASE WHEN c.code IS NULL THEN c.b END AS size FROM f LEFT JOIN c USING (doc_id)")
def source_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in frames, some of which lost or gained a byte or are another's; what becomes of each when it is read."""
    docs = read(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 10).withColumn("payload", F.encode("text", "UTF-8")).withColumn("revision", F.col("n_chars") % 5)
    named = envelope.manifest(F.col("doc_id") + F.when(F.col("k") == 7, 1).otherwise(0), F.col("revision"), F.col("payload"))
    man = F.when(F.col("k") == 6, F.concat(F.lit("{ "), F.expr("substring(man, 2)"))).otherwise(F.col("man"))
    rows = docs.withColumn("man", named).withColumn("whole", envelope.encode(man, F.col("payload")))
    # of a frame's bytes in hexadecimal all but the last
    short = F.unhex(F.expr("left(hex(whole), 2 * octet_length(whole) - 2)"))
    frame = F.when(F.col("k") == 2, short).when(F.col("k") == 3, F.concat("whole", F.lit(b"\0"))).when(F.col("k") == 4, F.concat(F.lit(b"X"), F.expr("substring(whole, 2)"))).when(F.col("k") == 5, F.concat(short, F.lit(b"\xfe")))
    frame = frame.when(F.col("k") == 8, F.lit(b"")).when(F.col("k") == 9, F.concat(F.lit(b"%PDF-"), "payload")).otherwise(F.col("whole"))
    found = envelope.decode(rows.select("doc_id", "revision", frame.alias("frame")), "frame")
    code = envelope.recovered(found, F.col("doc_id"), F.col("revision"))
    return found.select("doc_id", code.alias("code"), F.when(code.isNull(), F.octet_length("decoded.payload").cast("long")).alias("size"))
