"""Queries over trees, diffs and commands. Lines of documents stand for blocks, nations under regions for a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commands, tree
from ..registry import query, read

NODES = """
WITH RECURSIVE nodes AS (SELECT 0 AS doc, 'r' || r_regionkey AS node, NULL AS parent, r_regionkey::BIGINT AS ordinal FROM region
UNION ALL SELECT 0, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey::BIGINT FROM nation UNION ALL SELECT 0, 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier UNION ALL SELECT 0, 'c' || c_custkey, 'n' || c_nationkey, 1000000 + c_custkey FROM customer),
t AS (SELECT node, 0 AS depth, [ordinal] AS path, node AS root FROM nodes WHERE parent IS NULL UNION ALL SELECT n.node, t.depth + 1, list_append(t.path, n.ordinal), t.root FROM nodes n JOIN t ON n.parent = t.node)"""


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    of = lambda t, p, k, parent, shift=0: read(spark, sf_dir, t).select(F.lit(0).alias("doc"), name(p, k).alias("node"), parent.alias("parent"), (F.col(k).cast("long") + shift).alias("ordinal"))
    rows = of("region", "r", "r_regionkey", F.lit(None).cast("string")).union(of("nation", "n", "n_nationkey", name("r", "n_regionkey")))
    return rows.union(of("supplier", "s", "s_suppkey", name("n", "s_nationkey"))).union(of("customer", "c", "c_custkey", name("n", "c_nationkey"), 1_000_000))


@query(NODES + " SELECT node, depth::BIGINT AS depth, array_to_string(path, '.') AS path, root FROM t")
def preorder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.paths(nodes_of(spark, sf_dir), "doc", "node", "parent", "ordinal")
    return found.select("node", F.col("depth").cast("long").alias("depth"), F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "root")


@query(NODES + " SELECT root, count(*) AS nodes, max(depth)::BIGINT AS deepest, count(*) FILTER (node LIKE 's%') AS text_nodes FROM t GROUP BY root")
def subtree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.paths(nodes_of(spark, sf_dir), "doc", "node", "parent", "ordinal")
    return found.groupBy("root").agg(F.count("*").alias("nodes"), F.max("depth").cast("long").alias("deepest"), F.count_if(F.col("node").startswith("s")).alias("text_nodes"))


@query("SELECT DISTINCT l_suppkey AS owner FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def owner_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("owner"))
    return tree.owners(refs, read(spark, sf_dir, "part").where("p_size = 7"), "p_partkey", "owner")


BLOCKS = """
WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ordinal FROM documents),
blocks AS (SELECT doc_id, ordinal::BIGINT AS ordinal, sha256(doc_id::VARCHAR || ':' || ordinal::VARCHAR)[1:12] AS node, CASE WHEN ordinal % 5 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, text FROM u)"""


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    node = F.substring(F.sha2(F.concat_ws(":", "doc_id", "ordinal"), 256), 1, 12)
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), node.alias("node"), F.when(F.col("ordinal") % 5 == 0, "heading").otherwise("paragraph").alias("kind"), "text")


def orders_of(spark: SparkSession, sf_dir: str, **arguments) -> DataFrame:
    """A command with these arguments for every third document."""
    docs = read(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    return docs.select("doc_id", *[(v if not isinstance(v, (int, str)) else F.lit(v).cast("long") if isinstance(v, int) else F.lit(v)).alias(k) for k, v in arguments.items()])


DIGEST = "sha256(text)[1:12] AS text"


def digest(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", F.substring(F.sha2("text", 256), 1, 12))


@query(BLOCKS + f", b AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 AND ordinal = 0 AND length(text) >= 8 THEN left(text, 2) || 'NEW' || substr(text, 9) ELSE text END AS text) FROM blocks) SELECT doc_id, ordinal, node, kind, {DIGEST} FROM b")
def replace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(commands.replace_text(blocks_of(spark, sf_dir), orders_of(spark, sf_dir, at=0, start=2, stop=8, new="NEW")))


MIXED = "e\u0301\U0001f600x"  # a letter with a mark, a character of two units, a letter


@query(
    BLOCKS
    + f""", f AS (SELECT doc_id, '{MIXED}' || left(text, 20) AS text, doc_id % 7 = 0 AS lost, doc_id % 8 AS how FROM blocks WHERE ordinal = 0),
c AS (SELECT *, CASE WHEN lost THEN 'invalid_target' WHEN how = 1 THEN 'invalid_utf16_boundary' WHEN how = 2 THEN 'invalid_grapheme_boundary' WHEN how IN (3, 4) THEN 'invalid_range' WHEN how = 5 THEN 'no_op' WHEN how = 6 THEN 'broken_invariant' END AS code FROM f)
SELECT doc_id, code, CASE WHEN code IS NOT NULL THEN text WHEN how = 0 THEN replace(text, '\U0001f600', 'new') ELSE 'new' || text END AS text FROM c"""
)
def replace_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by UTF-16 units on cluster boundaries, each with its code; the first line of each document after them."""
    how = F.col("doc_id") % 8
    first = blocks_of(spark, sf_dir).where("ordinal = 0").withColumn("text", F.concat(F.lit(MIXED), F.substring("text", 1, 20)))
    start = F.when(how == 1, 3).when(how == 2, 1).when(how == 3, 5).when(how.isin(5, 7), 0).otherwise(2)
    stop = F.when(how == 2, 2).when(how == 4, 10**6).when(how == 5, 2).when(how == 7, 0).otherwise(4)
    new = F.when(how == 5, MIXED[:2]).otherwise("new")
    orders = read(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, 10**6).otherwise(0).cast("long").alias("at"), start.alias("start"), stop.alias("stop"), new.alias("new"), F.when(how == 6, "other").alias("expected")
    )
    after, codes = commands.replace_units(first, orders)
    return after.join(codes, "doc_id").select("doc_id", "code", "text")


@query(
    BLOCKS
    + f""", last AS (SELECT doc_id, text FROM blocks WHERE ordinal = 2), b AS (SELECT b.doc_id, b.ordinal, node, kind, CASE WHEN b.doc_id % 3 = 0 AND b.ordinal = 0 THEN left(b.text, 3) || '+' || substr(l.text, 5) ELSE b.text END AS text FROM blocks b LEFT JOIN last l USING (doc_id)
WHERE b.doc_id % 3 <> 0 OR b.ordinal NOT IN (1, 2))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1)::BIGINT AS ordinal, node, kind, {DIGEST} FROM b"""
)
def replace_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(commands.replace_across(blocks_of(spark, sf_dir), orders_of(spark, sf_dir, first=0, start=3, last=2, stop=4, new="+")))


@query(BLOCKS + f" SELECT doc_id, ordinal, node, CASE WHEN doc_id % 3 = 0 AND ordinal = 5 AND kind = 'heading' THEN 'quote' ELSE kind END AS kind, {DIGEST} FROM blocks")
def set_block_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(commands.set_column(blocks_of(spark, sf_dir), orders_of(spark, sf_dir, at=5, expected="heading", value="quote"), "kind"))


@query(BLOCKS + f", b AS (SELECT doc_id, ordinal * 2 + 1 AS o, node, kind, text FROM blocks UNION ALL SELECT doc_id, 2, 'break', 'pageBreak', '' FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::BIGINT AS ordinal, node, kind, {DIGEST} FROM b")
def insert_page_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(commands.insert(blocks_of(spark, sf_dir), orders_of(spark, sf_dir, ordinal=1, node="break", kind="pageBreak", text="")))


@query(BLOCKS + f", n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1)::BIGINT AS ordinal, node, kind, {DIGEST} FROM n WHERE NOT (doc_id % 3 = 0 AND ordinal = 0 AND n > 1)")
def delete_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(commands.delete(blocks_of(spark, sf_dir), orders_of(spark, sf_dir, at=0)))


@query(
    BLOCKS
    + f""", b AS (SELECT doc_id, ordinal * 2 AS o, node, kind, CASE WHEN doc_id % 3 = 0 AND ordinal = 0 AND length(text) >= 6 THEN left(text, 6) ELSE text END AS text FROM blocks
UNION ALL SELECT doc_id, 1, node, CASE WHEN length(text) = 6 THEN 'paragraph' ELSE kind END, substr(text, 7) FROM blocks WHERE doc_id % 3 = 0 AND ordinal = 0 AND length(text) >= 6)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::BIGINT AS ordinal, node, kind, {DIGEST} FROM b"""
)
def split_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(commands.split_block(blocks_of(spark, sf_dir), orders_of(spark, sf_dir, at=0, offset=6)))


@query(
    BLOCKS
    + f""", n AS (SELECT *, lead(text) OVER w AS t, lead(kind) OVER w AS k FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)), b AS (SELECT doc_id, ordinal, node, kind, CASE WHEN doc_id % 3 = 0 AND ordinal = 1 AND k = kind THEN text || t ELSE text END AS text FROM n WHERE NOT (doc_id % 3 = 0 AND ordinal = 2))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1)::BIGINT AS ordinal, node, kind, {DIGEST} FROM b"""
)
def merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks 1 and 2 are paragraphs both, so they merge."""
    return digest(commands.merge_block(blocks_of(spark, sf_dir), orders_of(spark, sf_dir, at=1)))


@query(BLOCKS + f" SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN doc_id % 3 <> 0 THEN ordinal::DOUBLE WHEN ordinal = 0 THEN 3.5 ELSE ordinal END) - 1)::BIGINT AS ordinal, node, kind, {DIGEST} FROM blocks")
def move_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(commands.move(blocks_of(spark, sf_dir), orders_of(spark, sf_dir, at=0, target=3)))


@query("WITH t AS (SELECT o_orderkey AS table_id, o_orderkey % 60 AS r, o_orderkey % 25 AS c FROM orders), x AS (SELECT *, unnest(range(r)) AS i FROM t WHERE r BETWEEN 1 AND 50 AND c BETWEEN 1 AND 20 AND r * c <= 1000) SELECT table_id, count(*)::BIGINT * any_value(c) AS cells, max(i) AS last_row, any_value(c) - 1 AS last_column FROM x GROUP BY table_id")
def insert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cells = commands.grid(read(spark, sf_dir, "orders").select(k.alias("table_id"), (k % 60).alias("rows"), (k % 25).alias("columns")))
    return cells.groupBy("table_id").agg(F.count("*").alias("cells"), F.max("row").cast("long").alias("last_row"), F.max("column").cast("long").alias("last_column"))


@query(
    BLOCKS
    + """, a AS (SELECT doc_id, ordinal, CASE WHEN doc_id % 3 = 0 AND ordinal % 4 = 1 THEN 'x' ELSE kind END AS kind, CASE WHEN doc_id % 2 = 0 AND ordinal % 3 = 1 THEN 'y' ELSE text END AS text, CASE WHEN ordinal % 11 = 10 THEN 'z' ELSE node END AS node FROM blocks WHERE NOT (doc_id % 7 = 0 AND ordinal = 4))
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.ordinal, a.ordinal) AS ordinal, CASE WHEN b.node IS DISTINCT FROM a.node THEN 'structure' WHEN b.kind <> a.kind AND b.text <> a.text THEN 'style_body' WHEN b.kind <> a.kind THEN 'style' WHEN b.text <> a.text THEN 'body' ELSE 'same' END AS change
FROM blocks b FULL JOIN a ON a.doc_id = b.doc_id AND a.ordinal = b.ordinal"""
)
def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = blocks_of(spark, sf_dir)
    d, o = F.col("doc_id"), F.col("ordinal")
    after = before.where(~((d % 7 == 0) & (o == 4)))
    after = after.select("doc_id", "ordinal", F.when((d % 3 == 0) & (o % 4 == 1), "x").otherwise(F.col("kind")).alias("kind"), F.when((d % 2 == 0) & (o % 3 == 1), "y").otherwise(F.col("text")).alias("text"), F.when(o % 11 == 10, "z").otherwise(F.col("node")).alias("node"))
    return tree.positional_diff(before, after, ["doc_id", "ordinal"], "node", ["kind"], ["text"])


@query("WITH a AS (SELECT s_suppkey + CASE WHEN s_suppkey % 9 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_acctbal END AS bal FROM supplier) SELECT coalesce(s_suppkey, k) AS id, CASE WHEN s_suppkey IS NULL THEN 'added' WHEN k IS NULL THEN 'removed' WHEN bal = s_acctbal THEN 'same' ELSE 'changed' END AS change FROM supplier FULL JOIN a ON k = s_suppkey")
def keyed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    after = before.select((F.col("id") + F.when(F.col("id") % 9 == 0, 1_000_000).otherwise(0)).alias("id"), F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.col("balance")).alias("balance"))
    return tree.keyed_diff(before, after, "id", ["balance"])


@query(
    """
WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS p, l_suppkey % 50 AS s, l_quantity::BIGINT % 9 AS r, l_linenumber::BIGINT AS i, l_linenumber % 2 = 0 AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, p AS before, CASE WHEN p < s THEN p WHEN r = 0 AND p = s THEN CASE WHEN f THEN p + i ELSE p END WHEN p = s THEN p WHEN p >= s + r THEN p - r + i END AS after FROM o"""
)
def map_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("before"), (F.col("l_suppkey") % 50).alias("s"), (F.col("l_quantity").cast("long") % 9).alias("r"))
    affinity = F.when(F.col("l_linenumber") % 2 == 0, "forward").otherwise("backward")
    return rows.select("l_orderkey", "l_linenumber", "before", commands.map_offset(F.col("before"), affinity, F.col("s"), F.col("r"), F.col("l_linenumber").cast("long")).alias("after"))


@query(
    """
WITH c AS (SELECT c_custkey, c_name, unnest(range(length(c_name))) AS i FROM customer), m AS (SELECT c_custkey, i, substr(c_name, i + 1, 1) AS ch, CASE WHEN i >= 3 AND i < 12 THEN 'bold' WHEN i < 9 THEN 'plain' ELSE 'italic' END AS mark FROM c),
l AS (SELECT *, CASE WHEN lag(mark) OVER (PARTITION BY c_custkey ORDER BY i) = mark THEN 0 ELSE 1 END AS new FROM m), g AS (SELECT *, sum(new) OVER (PARTITION BY c_custkey ORDER BY i) AS run FROM l)
SELECT c_custkey, run::BIGINT AS run, string_agg(ch, '' ORDER BY i) AS text, any_value(mark) AS mark FROM g GROUP BY c_custkey, run"""
)
def mark_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold set on [3, 12) of two runs; neighbours of equal marks join."""
    n = F.col("c_name")
    runs = F.array(F.struct(F.substring(n, 1, 9).alias("text"), F.lit("plain").alias("mark")), F.struct(F.substring(n, F.lit(10), F.length(n)).alias("text"), F.lit("italic").alias("mark")))
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.posexplode(commands.mark_runs(runs, F.lit(3), F.lit(12), F.lit("bold"))).alias("i", "r"))
    return rows.select("c_custkey", (F.col("i") + 1).cast("long").alias("run"), "r.text", "r.mark")
