"""Queries over stored records: heads, layouts, write-once stores, lineage, links, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import identity
from ..registry import query, read


@query("SELECT o_custkey AS document, count(*) AS heads, CASE WHEN count(*) > 1 THEN 'conflict' ELSE 'ok' END AS code, max(o_orderkey) AS latest FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def store_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many heads each document has; more than one is a conflict."""
    g = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("document"))
    return g.agg(F.count("*").alias("heads"), F.when(F.count("*") > 1, "conflict").otherwise("ok").alias("code"), F.max("o_orderkey").alias("latest"))


@query("SELECT s_suppkey AS id, hex(encode(s_name)) AS bytes, length(s_name)::BIGINT AS size, CASE WHEN s_suppkey % 2 = 0 THEN 'binary' ELSE 'array' END AS layout FROM supplier")
def asset_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts of byte records, binary and arrays of numbers, read as one."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    binary = rows.where("id % 2 = 0").select("id", F.encode("s_name", "UTF-8").alias("content"), F.lit("binary").alias("layout"))
    numbers = rows.where("id % 2 = 1").select("id", F.transform(F.split("s_name", ""), lambda c: F.ascii(c)).alias("codes"), F.lit("array").alias("layout"))
    legacy = numbers.select("id", F.unhex(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("content"), "layout")
    both = binary.unionByName(legacy, allowMissingColumns=True)
    return both.select("id", F.hex("content").alias("bytes"), F.octet_length("content").cast("long").alias("size"), "layout")


@query("WITH d AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1) SELECT h AS source_hash, min(doc_id) AS first, count(*) AS offered FROM n WHERE h NOT IN (SELECT h FROM d) GROUP BY h")
def write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a write-once store takes: those whose hash it doesn't have, once each."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))
    new = rows.where("doc_id % 2 = 1").join(rows.where("doc_id % 2 = 0").select("source_hash"), "source_hash", "left_anti")
    return new.groupBy("source_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("offered"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN n_chars < 100 THEN 'size_mismatch' WHEN lang <> 'en' AND quality = 0 THEN 'locale_mismatch' WHEN toxic = 1 THEN 'hash_mismatch' ELSE 'ok' END AS code FROM documents LEFT JOIN labels USING (doc_id)")
def source_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first expectation that a recovered source doesn't meet."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    code = F.when(F.col("quality").isNull(), "missing").when(F.col("n_chars") < 100, "size_mismatch").when((F.col("lang") != "en") & (F.col("quality") == 0), "locale_mismatch").when(F.col("toxic") == 1, "hash_mismatch")
    return rows.select("doc_id", code.otherwise("ok").alias("code"))


@query("WITH r AS (SELECT page_id % 20 AS request, page_id, length(html) AS n, sum(length(html)) OVER (PARTITION BY page_id % 20 ORDER BY page_id) AS total FROM pages) SELECT request, count(*) AS pages, sum(n)::BIGINT AS bytes, max(total) > 30000 AS rejected, min(CASE WHEN total > 30000 THEN page_id END) AS over_at FROM r GROUP BY request")
def recognition_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page images of each request with a running total; a request over the cap is refused whole."""
    w = Window.partitionBy("request").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = read(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("request"), "page_id", F.length("html").cast("long").alias("n")).withColumn("total", F.sum("n").over(w))
    over = F.col("total") > 30_000
    return rows.groupBy("request").agg(F.count("*").alias("pages"), F.sum("n").alias("bytes"), F.bool_or(over).alias("rejected"), F.min(F.when(over, F.col("page_id"))).alias("over_at"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'reconstructed' ELSE 'migrated' END AS lineage, CASE WHEN p_partkey % 3 = 1 AND p_size > 40 THEN 'hash_mismatch' WHEN p_partkey % 3 = 2 AND p_size < 3 THEN 'duplicate_source' END AS code FROM part")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a document came to be, and what its sources get wrong: a supplied hash that isn't the computed one, or a source named twice."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 3 == 0, "created").when(k % 3 == 1, "reconstructed").otherwise("migrated")
    supplied, computed = F.sha2(F.when(size > 40, "other").otherwise(F.col("p_name")), 256), F.sha2("p_name", 256)
    sources = F.array(F.col("p_name"), F.when(size < 3, F.col("p_name")).otherwise(F.concat("p_name", F.lit("+"))))
    code = F.when((kind == "reconstructed") & (supplied != computed), "hash_mismatch").when((kind == "migrated") & (F.size(F.array_distinct(sources)) < F.size(sources)), "duplicate_source")
    return read(spark, sf_dir, "part").select("p_partkey", kind.alias("lineage"), code.alias("code"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s_suppkey IS NULL THEN 'no_page' WHEN l_linenumber * 100 + l_quantity > 640 THEN 'out_of_bounds' ELSE 'ok' END AS code, s_nationkey AS page FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0) ON s_suppkey = l_suppkey")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the page that they go to, and whether their rectangle is within it."""
    pages = read(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("page"))
    rows = read(spark, sf_dir, "lineitem").join(pages, "l_suppkey", "left")
    code = F.when(F.col("page").isNull(), "no_page").when(F.col("l_linenumber") * 100 + F.col("l_quantity") > 640, "out_of_bounds").otherwise("ok")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code.alias("code"), "page")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND c_nationkey = o_orderkey % 25 AND (c_mktsegment = o_orderpriority OR o_orderkey % 2 = 0) WHERE c_acctbal > 0")
def export_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose identities all equal the session's: one join by several columns."""
    c = read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("long").alias("nation"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 25).alias("nation"))
    return c.join(o, ["c_custkey", "nation"]).where((F.col("c_mktsegment") == F.col("o_orderpriority")) | (F.col("o_orderkey") % 2 == 0)).select("c_custkey", "o_orderkey")


@query("WITH p AS (SELECT o_custkey AS plan, o_orderkey AS part, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), s AS (SELECT o_custkey AS plan, o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000000 ELSE 0 END AS part FROM orders WHERE o_orderkey % 2 = 0) SELECT s.plan, count(p.part) AS selected, count(*) FILTER (p.part IS NULL) AS unknown, list(place ORDER BY place) FILTER (place IS NOT NULL) AS places FROM s LEFT JOIN p ON p.plan = s.plan AND p.part = s.part GROUP BY s.plan")
def flatten_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected parts in their plan's order, and how many the plan doesn't have."""
    k = F.col("o_orderkey")
    w = Window.partitionBy("plan").orderBy("part")
    plan = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), k.alias("part")).withColumn("place", F.row_number().over(w).cast("long"))
    picked = read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("plan"), (k + F.when(k % 50 == 0, 1_000_000_000).otherwise(0)).alias("part"))
    found = picked.join(plan, ["plan", "part"], "left").groupBy("plan")
    out = found.agg(F.count("place").alias("selected"), F.count_if(F.col("place").isNull()).alias("unknown"), F.array_sort(F.collect_list("place")).alias("places"))
    return out.withColumn("places", F.when(F.size("places") > 0, F.col("places")))


KINDS = ("transaction", "audit", "snapshot", "asset")


@query(
    f"""
WITH r AS (SELECT o_orderkey AS commit, kind, o_orderkey * 4 + CASE kind {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))} END AS key, o_orderdate::VARCHAR AS content, o_orderkey % 16 AS how FROM orders, (VALUES {", ".join(f"('{k}')" for k in KINDS)}) k(kind)),
s AS (SELECT *, CASE WHEN kind = 'asset' AND how = 9 OR kind = 'audit' AND how = 11 THEN 'conflict' WHEN how = 0 OR how IN (1, 9, 11) OR how = 2 AND kind <> 'asset' OR how = 3 AND kind = 'audit' OR how = 4 AND kind = 'snapshot' OR how = 5 AND kind <> 'snapshot' THEN 'exact' ELSE 'missing' END AS state FROM r)
SELECT commit, CASE WHEN how IN (9, 11) THEN 'identity_conflict' WHEN how IN (0, 1) THEN 'idempotent' WHEN how IN (2, 3, 4) THEN 'partial_record_set' ELSE 'committed' END AS disposition FROM s GROUP BY commit, how"""
)
def commit_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of four records each against a store that has all, some, none or others of them."""
    key, how, kind = F.col("o_orderkey"), F.col("o_orderkey") % 16, F.col("kind")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (key * 4 + i).alias("key")) for i, k in enumerate(KINDS)])).alias("x")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", key.alias("commit"), each, F.col("o_orderdate").cast("date").cast("string").alias("content")).select("o_orderkey", "commit", "x.*", "content")
    kept = how.isin(0, 1, 9, 11) | ((how == 2) & (kind != "asset")) | ((how == 3) & (kind == "audit")) | ((how == 4) & (kind == "snapshot")) | ((how == 5) & (kind != "snapshot"))
    other = ((how == 9) & (kind == "asset")) | ((how == 11) & (kind == "audit"))
    durable = rows.where(kept).select("kind", "key", F.when(other, "other").otherwise(F.col("content")).alias("content"))
    return identity.disposition(rows.select("commit", "kind", "key", "content"), durable, "commit", "kind", "key", "content")


@query("WITH a AS (SELECT p_brand AS id, p_type AS payload FROM part), g AS (SELECT id, count(DISTINCT payload) AS n FROM a GROUP BY 1) SELECT id, count(*) AS records, count(DISTINCT payload) AS contents, CASE WHEN count(DISTINCT payload) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'idempotent' ELSE 'single' END AS status FROM a GROUP BY id")
def payload_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one identity must have one payload: by counting, not by joining a table with itself."""
    return identity.reconcile(read(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_type").alias("payload")), ["id"], F.col("payload"))


@query("SELECT r_name, sum(n)::BIGINT AS nodes, sum(s)::BIGINT AS suppliers, sum(n) + sum(s) = 5 + sum(s) AS proven FROM (SELECT r_name, n_nationkey, 1 AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY r_name")
def recipe_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a recipe's parts, and whether they are what it says."""
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    rows = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).join(s, "n_nationkey", "left")
    return rows.groupBy("r_name").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("suppliers"), (F.count("*") == 5).alias("proven"))
