"""Queries of aggregations, sets and ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates
from ..registry import query, read


@query(
    """
SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'N') THEN 'on' WHEN NOT bool_or(l_returnflag = 'N') THEN 'off' ELSE 'mixed' END AS state,
CASE WHEN count(DISTINCT l_linestatus) = 1 AND count(l_linestatus) = count(*) THEN min(l_linestatus) END AS uniform FROM lineitem GROUP BY l_orderkey"""
)
def tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(aggregates.tri_state(F.col("l_returnflag") == "N").alias("state"), aggregates.uniform(F.col("l_linestatus")).alias("uniform"))


@query(
    """
SELECT l_orderkey, min(l_linenumber) AS x, min(l_quantity) AS y, max(l_linenumber + 10) - min(l_linenumber) AS width, max(l_quantity + l_tax) - min(l_quantity) AS height, min(10000 - l_discount * 10000)::BIGINT AS confidence, bool_or(l_discount > 0.05) AS review,
count(*) FILTER (l_discount > 0.05) AS reviews, max(l_quantity) AS row_height, sum(l_quantity)::BIGINT AS total_height FROM lineitem GROUP BY l_orderkey"""
)
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union rectangles, least confidence, review flags, heights."""
    x, y = F.col("l_linenumber"), F.col("l_quantity")
    box = aggregates.union_box(x, y, F.lit(10), F.col("l_tax"))
    review = F.col("l_discount") > 0.05
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *box, F.min(10000 - F.col("l_discount") * 10000).cast("long").alias("confidence"), F.bool_or(review).alias("review"), F.count_if(review).alias("reviews"), F.max("l_quantity").alias("row_height"),
        F.try_sum(F.col("l_quantity").cast("long")).alias("total_height"),
    )


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS text, string_agg(role, '' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY conv_id")
def block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts joined by newline, and joined bare, in order."""
    rows = read(spark, sf_dir, "conversations")
    order = ["turn", "role", "text"]
    return rows.groupBy("conv_id").agg(aggregates.joined(F.col("text"), order, "\n").alias("text"), aggregates.joined(F.col("role"), order, "").alias("roles"))


@query("SELECT n_name AS style, s.s_suppkey AS node, greatest(CASE WHEN n_nationkey % 2 = 0 THEN 9000 + n_nationkey * 1000 ELSE 12000 END, coalesce(m, 0))::BIGINT AS font_size FROM supplier s LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, max(l_quantity::BIGINT) * 500 AS m FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's size: its style's, 12000 where it has none, or the largest of its runs. Styles are a small dimension of fixed size."""
    styles = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("style"), F.when(F.col("n_nationkey") % 2 == 0, 9000 + F.col("n_nationkey") * 1000).alias("size"))
    runs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.max(F.col("l_quantity").cast("long")) * 500).alias("most"))
    rows = read(spark, sf_dir, "supplier").join(styles, "s_nationkey", "left").join(runs, "s_suppkey", "left")
    return rows.select("style", F.col("s_suppkey").alias("node"), F.greatest(F.coalesce("size", F.lit(12000)), F.coalesce("most", F.lit(0))).cast("long").alias("font_size"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 0 ELSE min(event_id) END AS boundary, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id")
def earliest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From where a change set invalidates: the start for global kinds, else the earliest owner; with the union of its kinds."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.when(F.bool_or(F.col("event_type") == "purchase"), F.lit(0)).otherwise(F.min("event_id")).alias("boundary"), F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("SELECT c_name AS id, count(*) AS uses FROM (SELECT c_name FROM customer UNION ALL SELECT c_name FROM customer WHERE c_custkey % 9 = 0) GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    return aggregates.repeated(rows.select("c_name").union(rows.where("c_custkey % 9 = 0").select("c_name")), "c_name").withColumnRenamed("c_name", "id")


@query("SELECT l_suppkey AS face, l_linenumber AS glyph, count(*) AS uses, count(DISTINCT l_shipdate) AS widths, count(DISTINCT l_shipdate) > 1 AS conflict FROM lineitem GROUP BY ALL")
def glyph_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("face"), F.col("l_linenumber").alias("glyph"))
    return g.agg(F.count("*").alias("uses"), F.countDistinct("l_shipdate").alias("widths"), (F.countDistinct("l_shipdate") > 1).alias("conflict"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", "value")
    ends = rows.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return aggregates.nearest_ranks(rows, "event_type", "value", {"p50": 0.5, "p95": 0.95}).join(ends, "event_type").select("event_type", "p50", "p95", "least", "most")


@query("SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS complete FROM lineitem GROUP BY 1")
def tab_order_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(aggregates.is_permutation(F.col("l_linenumber"), 1).alias("complete"))


@query("SELECT lang, count(*) AS documents, sum(len(string_split(text, chr(10))))::BIGINT AS paragraphs, sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')))::BIGINT AS words, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1")
def workload_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.sum(c).cast("long")
    return read(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("documents"), n(F.size(F.split("text", "\n"))).alias("paragraphs"), n(F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))).alias("words"), n(F.octet_length("text")).alias("bytes")
    )


@query(
    """
WITH s AS (SELECT user_id, event_id, sum(octet_length(encode(props))) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events)
SELECT user_id, event_id, total::BIGINT AS total, total > 1000 AS over FROM s"""
)
def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.sum(F.octet_length("props")).over(w).alias("total"))
    return rows.withColumn("over", F.col("total") > 1000)


@query("SELECT page_id, length(html)::BIGINT AS size, html LIKE '%<table%' AS has_table FROM pages p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.page_id AND quality = 0)")
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a text element: an anti-join."""
    pages = read(spark, sf_dir, "pages")
    text = read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("page_id"))
    return pages.join(text, "page_id", "left_anti").select("page_id", F.length("html").cast("long").alias("size"), F.col("html").contains("<table").alias("has_table"))


@query(
    """
WITH d AS (SELECT o_custkey % 100 AS seat, o_orderkey % 7 AS idx, o_orderkey % 2 = 0 AS final, o_orderpriority AS said, o_orderkey FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY seat, idx ORDER BY final DESC, o_orderkey DESC) AS n FROM d)
SELECT seat, string_agg(said, ' ' ORDER BY idx) AS transcript FROM r WHERE n = 1 GROUP BY seat"""
)
def transcript_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each index the final result, else the latest interim one; joined in order of index."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("seat"), (k % 7).alias("idx"), F.struct((k % 2 == 0).alias("f"), k.alias("k")).alias("best"), F.col("o_orderpriority").alias("said"))
    one = rows.groupBy("seat", "idx").agg(F.max_by("said", "best").alias("said"))
    return one.groupBy("seat").agg(aggregates.joined(F.col("said"), ["idx"], " ").alias("transcript"))


@query("SELECT l_orderkey, list_sort(list_distinct(list_concat(list(l_linenumber::BIGINT), list(l_linenumber::BIGINT + l_quantity::BIGINT)))) AS bounds FROM lineitem GROUP BY 1")
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sorted ends of intervals."""
    a = F.col("l_linenumber").cast("long")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(a, a + F.col("l_quantity").cast("long")))))).alias("bounds"))


@query(
    """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'undecided' WHEN quality = 0 THEN 'rejected' ELSE 'accepted' END AS decision, CASE WHEN quality = 0 THEN '' ELSE text END AS text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions applied to the blocks that need one."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    said = F.when(F.col("known").isNull(), "undecided").when(F.col("quality") == 0, "rejected").otherwise("accepted")
    return rows.select("doc_id", said.alias("decision"), F.when(F.col("quality") == 0, "").otherwise(F.col("text")).alias("text"))


@query(
    """
WITH t AS (SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS hits, n_chars FROM documents)
SELECT doc_id, CASE WHEN n_chars < 100 THEN 3000 WHEN hits * 20 > n_chars THEN 10000 ELSE 8500 END::BIGINT AS confidence, n_chars < 100 AS review FROM t"""
)
def part_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))
    score = F.when(F.col("n_chars") < 100, 3000).when(hits * 20 > F.col("n_chars"), 10000).otherwise(8500)
    return read(spark, sf_dir, "documents").select("doc_id", score.cast("long").alias("confidence"), (F.col("n_chars") < 100).alias("review"))
