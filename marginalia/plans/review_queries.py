"""Queries of forms, reviews, audits, nested lists and edit folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import forms, ranges, tree
from ..registry import query, read
from .log_queries import LOG, log_of

STATUS = "CASE o_orderkey % 9 WHEN 0 THEN 'invalid' WHEN 1 THEN 'tombstone' ELSE 'valid' END"


@query(
    f"""
WITH f AS (SELECT o_orderkey AS field, o_custkey AS document, {STATUS} AS status, o_orderkey % 30 AS place, c_custkey AS node, length(c_mktsegment) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 8 <> 0),
c AS (SELECT *, CASE WHEN status = 'invalid' THEN 'legacy_invalid' WHEN status = 'tombstone' THEN 'target_deleted' WHEN node IS NULL THEN 'target_missing' WHEN place > n THEN 'position_invalid' END AS code FROM f)
SELECT field, code, CASE WHEN code IS NULL THEN row_number() OVER (PARTITION BY document, code IS NULL ORDER BY field) - 1 END AS tab_order FROM c"""
)
def field_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields parted into valid ones, in tab order, and ones to review with the reason."""
    nodes = read(spark, sf_dir, "customer").where("c_custkey % 8 <> 0").select(F.col("c_custkey").alias("document"), F.col("c_custkey").alias("node"), F.length("c_mktsegment").alias("n"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("field"), F.col("o_custkey").alias("document"), F.expr(STATUS).alias("status"), (F.col("o_orderkey") % 30).alias("place"))
    rows = rows.join(nodes, "document", "left").withColumn("code", forms.review_code(F.col("status"), F.col("node"), F.col("place"), F.col("n")))
    return forms.partition_fields(rows, "document", "field", "code").select("field", "code", "tab_order")


@query("SELECT o_orderkey, array_to_string(list_filter(list_transform([o_orderkey % 4, o_orderkey % 7, o_custkey % 5], lambda i: CASE i WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 4 THEN 'four' END), lambda x: x IS NOT NULL), ', ') AS summary FROM orders")
def value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = {0: "none", 1: "one", 2: "two", 4: "four"}
    labels = F.create_map(*[x for k, v in options.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    picked = F.array(F.col("o_orderkey") % 4, F.col("o_orderkey") % 7, F.col("o_custkey") % 5)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(forms.value_summary(picked, labels), ", ").alias("summary"))


@query(
    LOG
    + """, a AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'recovery' ELSE 'edit' END AS action, CASE WHEN event_id % 5 = 0 THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS tx, revision - 1 AS base, revision - CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS new FROM log)
SELECT event_id, CASE WHEN outcome = 'success' AND tx IS NULL THEN 'transaction_required' WHEN outcome = 'failure' AND tx IS NOT NULL THEN 'transaction_forbidden' WHEN outcome = 'success' AND action <> 'recovery' AND new <> base + 1 THEN 'revision_link' WHEN outcome = 'failure' AND new <> base THEN 'revision_link' END AS code FROM a"""
)
def audit_construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = F.col("event_id"), F.col("revision")
    action, outcome = F.when(e % 6 == 0, "recovery").otherwise("edit"), F.when(e % 5 == 0, "failure").otherwise("success")
    code = forms.audit_code(action, outcome, F.when(e % 7 != 0, e), r - 1, r - F.when(e % 4 == 0, 1).otherwise(0))
    return log_of(spark, sf_dir).select("event_id", code.alias("code"))


@query("SELECT user_id, CASE WHEN count(DISTINCT b) = 1 THEN max(b) END AS boundary, CASE WHEN count(DISTINCT b) > 1 THEN 'conflict' WHEN count(DISTINCT b) = 0 THEN 'none' ELSE 'ok' END AS code FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN user_id * 10 WHEN user_id % 3 = 1 THEN event_id % 2 END AS b FROM events) GROUP BY user_id")
def migration_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    rows = read(spark, sf_dir, "events").select("user_id", F.when(u % 3 == 0, u * 10).when(u % 3 == 1, F.col("event_id") % 2).alias("b"))
    return forms.boundary_of(rows, "user_id", "b")


@query(
    """
WITH b AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 10 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'only_left' WHEN a.c_custkey IS NULL THEN 'only_right' WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'c_nationkey' ELSE 'equal' END AS code
FROM (SELECT * FROM customer WHERE c_custkey % 11 <> 0) a FULL JOIN b ON a.c_custkey = b.c_custkey"""
)
def widget_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    b = rows.where("c_custkey % 10 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")))
    return forms.reconcile_attributes(rows.where("c_custkey % 11 <> 0"), b, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query(
    LOG
    + """, h AS (SELECT user_id, max(revision) AS r, arg_max(event_id, revision) AS e FROM log GROUP BY 1), t AS (SELECT user_id, event_id AS id, revision AS base, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END AS before FROM log)
SELECT t.user_id, id, CASE WHEN id = h.e - CASE WHEN t.user_id % 2 = 0 THEN 0 ELSE 1 END THEN 'retry' WHEN base = r AND before = h.e THEN 'extends' ELSE 'conflict' END AS code FROM t JOIN h USING (user_id)"""
)
def commit_extends_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_of(spark, sf_dir)
    heads = rows.groupBy("user_id").agg(F.max("revision").alias("head_revision"), F.max_by("event_id", "revision").alias("head_hash"))
    heads = heads.withColumn("head_id", F.col("head_hash") - F.when(F.col("user_id") % 2 == 0, 0).otherwise(1))
    t = rows.select("user_id", F.col("event_id").alias("id"), F.col("revision").alias("base_revision"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id")).alias("before"))
    return forms.extends_head(t, heads, "user_id")


@query("SELECT sha256(text) AS content_hash, list_sort(list(doc_id)) AS assets, min(n_chars) = max(n_chars) AS exact FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def asset_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachable assets by content hash, with the ids that share it."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.array_sort(F.collect_list("doc_id")).alias("assets"), (F.min("n_chars") == F.max("n_chars")).alias("exact"))


@query("SELECT page_id, unnest(list_filter(['script', 'style', 'iframe', 'form', 'nav'], lambda t: contains(html, '<' || t))) AS active FROM pages")
def active_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the flagged kinds of content a page has."""
    flags = F.array(*map(F.lit, ("script", "style", "iframe", "form", "nav")))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.filter(flags, lambda t: F.contains("html", F.concat(F.lit("<"), t)))).alias("active"))


@query(
    """
WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS adv, l_partkey, l_suppkey FROM lineitem), x AS (SELECT *, coalesce(sum(adv) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, adv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, (x // 40)::BIGINT AS line, (x % 40)::BIGINT AS x FROM x"""
)
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each glyph's line of forty units and its place there, from the running sum of advances."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("advance"))
    rows = ranges.prefix_sum(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "advance"], F.col("advance"), "sum")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.floor(F.col("sum") / 40).cast("long").alias("line"), (F.col("sum") % 40).cast("long").alias("x"))


@query(
    """
WITH RECURSIVE n AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 10 THEN c_custkey // 3 END AS parent, c_custkey % 2 = 0 AS list FROM customer),
t AS (SELECT node, 0 AS depth, CASE WHEN list THEN 1 ELSE 0 END AS lists FROM n WHERE parent IS NULL UNION ALL SELECT n.node, t.depth + 1, t.lists + CASE WHEN n.list THEN 1 ELSE 0 END FROM n JOIN t ON n.parent = t.node)
SELECT node, depth::BIGINT AS depth, lists::BIGINT AS list_depth, lists > 3 AS too_deep FROM t"""
)
def list_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lists a node is in, itself included: counted along its path of ordinals (even ones are lists here)."""
    k = F.col("c_custkey")
    nodes = read(spark, sf_dir, "customer").select(F.lit(0).alias("doc"), k.alias("node"), F.when(k > 10, F.floor(k / 3)).alias("parent"), (k % 2).alias("plain"))
    found = tree.paths(nodes, "doc", "node", "parent", "plain")
    lists = F.size(F.filter("path", lambda x: x == 0)).cast("long")
    return found.select("node", F.col("depth").cast("long").alias("depth"), lists.alias("list_depth"), (lists > 3).alias("too_deep"))


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER w, lag(turn) OVER w) AS focus FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def focus_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the caret goes when a block is removed: the next block, else the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.lead("turn").over(w), F.lag("turn").over(w)).alias("focus"))


@query("SELECT n_nationkey, r_name, n_nationkey % 4 <> 0 AS can_indent, n_nationkey % 4 <> 0 AND n_regionkey > 1 AS can_outdent, CASE WHEN n_nationkey % 4 = 0 THEN 'first_item' WHEN n_regionkey <= 1 THEN 'top_level' END AS reason FROM nation JOIN region ON n_regionkey = r_regionkey")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of what may be done to each node, and the reason where something may not; regions are a table of fixed size."""
    first, top = F.col("n_nationkey") % 4 == 0, F.col("n_regionkey") <= 1
    rows = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", "r_name", (~first).alias("can_indent"), (~first & ~top).alias("can_outdent"), F.when(first, "first_item").when(top, "top_level").alias("reason"))


@query("WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0) SELECT coalesce(a.doc_id, b.doc_id) AS key, CASE WHEN a.doc_id IS NULL THEN 'add' WHEN b.doc_id IS NULL THEN 'drop' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def cache_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache adds, drops and keeps so that it holds just what is reachable."""
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    there, reachable = ids.where("key % 3 <> 0").withColumn("t", F.lit(1)), ids.where("key % 4 <> 0 or key % 3 = 0").withColumn("r", F.lit(1))
    action = F.when(F.col("t").isNull(), "add").when(F.col("r").isNull(), "drop").otherwise("keep")
    return there.join(reachable, "key", "full").select("key", action.alias("action"))


@query(
    LOG
    + """, s AS (SELECT user_id, revision, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY revision) AS size, event_type FROM log)
SELECT user_id, max(revision) AS revision, arg_max(size, revision)::BIGINT AS size, sha256(string_agg(event_type, '>' ORDER BY revision)) AS history FROM s GROUP BY user_id"""
)
def batch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of mutations folded in order into one state: revision, size, and a hash of the history."""
    rows = log_of(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("revision", "event_type"))).alias("ops"))
    start = F.struct(F.lit(0).cast("long").alias("revision"), F.lit(0).cast("long").alias("size"))
    grow = lambda t: F.when(t == "click", 1).when(t == "purchase", 3).otherwise(0).cast("long")
    end = F.aggregate("ops", start, lambda a, o: F.struct(o["revision"].alias("revision"), (a["size"] + grow(o["event_type"])).alias("size")))
    history = F.sha2(F.array_join(F.transform("ops", lambda o: o["event_type"]), ">"), 256)
    return rows.select("user_id", end.alias("e"), history.alias("history")).select("user_id", "e.revision", "e.size", "history")
