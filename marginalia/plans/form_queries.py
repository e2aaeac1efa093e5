"""Queries of validation, forms and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, validate
from ..registry import query, read
from .tree_queries import BLOCKS, blocks_of


@query(
    """
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders), i AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM o)
SELECT o_custkey AS document, 'price_limit' AS code FROM o WHERE o_totalprice > 400000
UNION ALL SELECT DISTINCT o_custkey, 'duplicate_priority' FROM (SELECT o_custkey, o_orderpriority FROM o GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT o_custkey, 'dangling_customer' FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT DISTINCT o_custkey, 'not_increasing' FROM i WHERE o_totalprice <= p"""
)
def document_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite: a limit, unique values, references, order."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), "o_orderkey", "o_totalprice", "o_orderpriority").withColumn("customer", F.col("document"))
    known = read(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
    return validate.suite(
        validate.failing(rows, ["document"], "price_limit", F.col("o_totalprice") > 400_000), validate.duplicated(rows, ["document"], "o_orderpriority", "duplicate_priority"),
        validate.dangling(rows, ["document"], "customer", known, "c_custkey", "dangling_customer"), validate.not_increasing(rows, "document", "o_orderkey", "o_totalprice", "not_increasing"),
    )


KIND = "CASE o_orderkey % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'number' WHEN 2 THEN 'date' WHEN 3 THEN 'email' WHEN 4 THEN 'choice' ELSE 'other' END"
VALUE = "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 6 = 1 THEN o_custkey || CASE WHEN o_orderkey % 4 = 0 THEN '.5.' ELSE '.' END WHEN o_orderkey % 6 = 2 THEN '2023-02-' || (10 + o_orderkey % 20) WHEN o_orderkey % 6 = 3 THEN o_custkey || '@' || CASE WHEN o_orderkey % 4 = 1 THEN 'b.c' ELSE 'bc' END WHEN o_orderkey % 6 = 0 AND o_orderkey % 4 = 0 THEN 'a' || chr(10) || 'b' ELSE o_orderpriority END"


@query(
    f"""
WITH v AS (SELECT o_orderkey, {KIND} AS kind, {VALUE} AS value, o_orderkey % 2 = 0 AS required, o_orderkey % 8 = 0 AS multiline, CASE WHEN o_orderkey % 7 = 0 THEN [] ELSE [o_orderkey % 5, o_orderkey % 3] END AS selected FROM orders)
SELECT o_orderkey, kind, CASE
WHEN (kind = 'choice' AND len(selected) = 0) OR (kind <> 'choice' AND value = '') THEN CASE WHEN required THEN 'required' END
WHEN kind = 'text' AND NOT multiline AND contains(value, chr(10)) THEN 'multiline_not_allowed'
WHEN kind = 'number' AND NOT regexp_matches(value, '^[+-]?[0-9]*\\.?[0-9]*$') THEN 'invalid_number'
WHEN kind = 'date' AND try_cast(value AS DATE) IS NULL THEN 'invalid_date'
WHEN kind = 'email' AND NOT regexp_matches(value, '^[^@]+@[^@.]+\\.[^@]*[^@.]$') THEN 'invalid_email'
WHEN kind = 'choice' AND (len(list_distinct(selected)) < 2 OR len(list_filter(selected, lambda x: x > 3)) > 0) THEN 'option_set_invalid'
WHEN kind = 'other' THEN 'unsupported_value' END AS code FROM v"""
)
def value_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(KIND).alias("kind"), F.expr(VALUE).alias("value"))
    selected = F.when(k % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 5, k % 3))
    options = F.array(*[F.lit(i).cast("long") for i in range(4)])
    return rows.select("o_orderkey", "kind", validate.value_code(F.col("kind"), F.col("value"), k % 2 == 0, k % 8 == 0, selected, options).alias("code"))


@query("SELECT c_custkey, o.best IS NOT NULL AS overridden, coalesce(o.best, c_mktsegment) AS effective FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS best FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey")
def form_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("default"))
    said = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("override"))
    return validate.form_state(fields, said, ["c_custkey"]).select("c_custkey", F.col("override").isNotNull().alias("overridden"), "effective")


@query(
    """
WITH RECURSIVE w AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM conversations),
f AS (SELECT conv_id, r, 1 AS i, 1 AS line, length(ws[1]) AS used, ws FROM w WHERE len(ws) > 0
UNION ALL SELECT conv_id, r, i + 1, CASE WHEN (used + 1 + length(ws[i + 1])) * 7 <= 420 THEN line ELSE line + 1 END, CASE WHEN (used + 1 + length(ws[i + 1])) * 7 <= 420 THEN used + 1 + length(ws[i + 1]) ELSE length(ws[i + 1]) END, ws FROM f WHERE i < len(ws))
SELECT conv_id, r AS block, line::BIGINT AS line, max(used)::BIGINT AS width FROM f GROUP BY conv_id, r, line"""
)
def greedy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at most 60 code points by the declared width."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = read(spark, sf_dir, "conversations").withColumn("block", F.row_number().over(w).cast("long"))
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = rows.select("conv_id", "block", F.posexplode(layout.fill_lines(words, 420)).alias("i", "t"))
    return rows.select("conv_id", "block", (F.col("i") + 1).cast("long").alias("line"), F.length("t").cast("long").alias("width"))


PARTS = "SELECT l_orderkey AS page, l_linenumber::BIGINT AS part, l_partkey % 640 AS x, l_suppkey % 10 * 25 AS y, 40 + l_quantity::BIGINT AS width, 20 + l_linenumber::BIGINT * 10 AS height FROM lineitem"


def parts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("long")
    return rows.select(F.col("l_orderkey").alias("page"), n.alias("part"), (F.col("l_partkey") % 640).alias("x"), (F.col("l_suppkey") % 10 * 25).alias("y"), (40 + F.col("l_quantity").cast("long")).alias("width"), (20 + n * 10).alias("height"))


@query(
    f"""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y DESC, x, part) AS i FROM ({PARTS})),
f AS (SELECT page, part, i, 1 AS line, y AS lo, y + height AS hi FROM p WHERE i = 1
UNION ALL SELECT p.page, p.part, p.i, CASE WHEN least(hi, y + height) - greatest(lo, y) > 0 OR greatest(lo, y) - least(hi, y + height) <= 64 THEN line ELSE line + 1 END,
CASE WHEN least(hi, y + height) - greatest(lo, y) > 0 OR greatest(lo, y) - least(hi, y + height) <= 64 THEN least(lo, y) ELSE y END,
CASE WHEN least(hi, y + height) - greatest(lo, y) > 0 OR greatest(lo, y) - least(hi, y + height) <= 64 THEN greatest(hi, y + height) ELSE y + height END FROM f JOIN p ON p.page = f.page AND p.i = f.i + 1)
SELECT page, part, line::BIGINT AS line FROM f"""
)
def reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_lines(parts_of(spark, sf_dir))


JOINS = "greatest(0, lo - (y + height)) <= 2 * greatest(height, hi - lo) AND abs(x - le) <= 4 * greatest(height, hi - lo)"


@query(
    f"""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y DESC, x, part) AS i FROM ({PARTS})),
f AS (SELECT page, part, i, 1 AS block, x AS le, y AS lo, y + height AS hi FROM p WHERE i = 1
UNION ALL SELECT p.page, p.part, p.i, CASE WHEN {JOINS} THEN block ELSE block + 1 END, CASE WHEN {JOINS} THEN least(le, x) ELSE x END,
CASE WHEN {JOINS} THEN least(lo, y) ELSE y END, CASE WHEN {JOINS} THEN greatest(hi, y + height) ELSE y + height END FROM f JOIN p ON p.page = f.page AND p.i = f.i + 1)
SELECT page, part AS line, block::BIGINT AS block FROM f"""
)
def reading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of lines: a fold over growing boxes."""
    return layout.reading_blocks(parts_of(spark, sf_dir).withColumnRenamed("part", "line"))


@query(f"WITH p AS ({PARTS}), n AS (SELECT page FROM p GROUP BY page HAVING count(*) >= 4) SELECT DISTINCT a.page FROM p a JOIN p b ON a.page = b.page AND a.y < b.y + b.height AND b.y < a.y + a.height AND b.x - (a.x + a.width) > 160 JOIN n ON n.page = a.page")
def ambiguous_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ambiguous_columns(parts_of(spark, sf_dir))


TAKE = """CASE WHEN least(n - pos, 40 - used) = n - pos THEN n - pos
WHEN used = 0 AND (CASE WHEN n - pos - 40 < 2 THEN greatest(0, n - pos - 2) ELSE 40 END) < least(2, n - pos) THEN least(n - pos, 40)
WHEN (CASE WHEN n - pos - greatest(0, 40 - used) < 2 THEN greatest(0, n - pos - 2) ELSE greatest(0, 40 - used) END) < least(2, n - pos) THEN 0
WHEN n - pos - greatest(0, 40 - used) < 2 THEN greatest(0, n - pos - 2) ELSE greatest(0, 40 - used) END"""


def lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(spark, sf_dir).withColumn("lines", F.greatest(F.lit(1), F.ceil(F.length("text") / 80)).cast("long"))


@query(
    BLOCKS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""",
l AS (SELECT doc_id, ordinal, kind, greatest(1, (length(text) + 79) // 80)::BIGINT AS n FROM blocks),
b AS (SELECT *, CASE WHEN kind = 'heading' THEN least(lead(n, 1, 0::BIGINT) OVER (PARTITION BY doc_id ORDER BY ordinal), 2) ELSE 0 END AS follows FROM l),
f AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS pos, 1::BIGINT AS page, 0::BIGINT AS used, NULL::BIGINT AS f_page, NULL::BIGINT AS f_first, NULL::BIGINT AS f_last, NULL::BIGINT AS ordinal FROM (SELECT DISTINCT doc_id FROM b)
UNION ALL SELECT doc_id, CASE WHEN NOT brk AND pos + take = n THEN i + 1 ELSE i END, CASE WHEN brk OR pos + take = n THEN 0 ELSE pos + take END,
CASE WHEN brk OR pos + take < n THEN page + 1 ELSE page END, CASE WHEN brk OR pos + take < n THEN 0 ELSE used + take END,
CASE WHEN NOT brk AND take > 0 THEN page END, pos, pos + take, i
FROM (SELECT f.doc_id, f.i, f.pos, f.page, f.used, b.n, b.kind = 'heading' AND pos = 0 AND used > 0 AND used + n + follows > 40 AS brk, {TAKE} AS take FROM f JOIN b ON b.doc_id = f.doc_id AND b.ordinal = f.i))
SELECT doc_id, ordinal, f_page AS page, f_first AS first_line, f_last AS last_line FROM f WHERE f_page IS NOT NULL"""
)
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of forty lines."""
    return layout.paginate(lined(spark, sf_dir), 40)


ROWS = "ordinal % 10 >= 5"


@query(
    BLOCKS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""",
k AS (SELECT doc_id, ordinal, CASE WHEN {ROWS} THEN 'row' WHEN ordinal % 10 < 2 THEN 'heading' ELSE 'paragraph' END AS kind, greatest(1, (length(text) + 79) // 80)::BIGINT AS n, CASE WHEN {ROWS} THEN ordinal // 10 END AS tab FROM blocks),
b AS (SELECT *, coalesce(CASE WHEN kind = 'heading' THEN CASE lead(kind) OVER w WHEN 'heading' THEN lead(n) OVER w + least(lead(n, 2, 0::BIGINT) OVER w, 2) ELSE least(lead(n, 1, 0::BIGINT) OVER w, 2) END END, 0) AS follows,
tab IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, tab ORDER BY ordinal) > 1 AS later, first_value(n) OVER (PARTITION BY doc_id, tab ORDER BY ordinal) AS head FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
f AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS pos, 1::BIGINT AS page, 0::BIGINT AS used, NULL::BIGINT AS f_page, NULL::BIGINT AS f_first, NULL::BIGINT AS f_last, NULL::BIGINT AS ordinal, false AS rep, NULL::BIGINT AS tall FROM (SELECT DISTINCT doc_id FROM b)
UNION ALL SELECT doc_id, CASE WHEN NOT brk AND pos + take = n THEN i + 1 ELSE i END, CASE WHEN brk OR pos + take = n THEN 0 ELSE pos + take END,
CASE WHEN brk OR (pos + take = n) IS FALSE THEN page + 1 ELSE page END + CASE WHEN over THEN 1 ELSE 0 END, CASE WHEN brk OR pos + take < n THEN 0 WHEN over THEN n + CASE WHEN later THEN head ELSE 0 END ELSE used + take END,
CASE WHEN NOT brk AND take > 0 THEN page + CASE WHEN over THEN 1 ELSE 0 END END, pos, pos + take, i, over AND later, CASE WHEN over AND later THEN head END
FROM (SELECT f.doc_id, f.i, f.pos, f.page, f.used, b.n, later, head, kind = 'row' AND used > 0 AND used + n > 40 AS over, b.kind = 'heading' AND pos = 0 AND used > 0 AND used + n + follows > 40 AS brk, CASE WHEN kind = 'row' THEN n ELSE {TAKE} END AS take FROM f JOIN b ON b.doc_id = f.doc_id AND b.ordinal = f.i)),
p AS (SELECT f.doc_id, f.ordinal, f.f_page, f.f_first, f.f_last, f.rep, f.tall, b.kind, b.tab FROM f JOIN b ON b.doc_id = f.doc_id AND b.ordinal = f.ordinal WHERE f_page IS NOT NULL)
SELECT doc_id, ordinal, f_page AS page, f_first AS first_line, f_last AS last_line, false AS derived, CASE WHEN kind = 'row' AND f_last > 40 THEN 'overflow' END AS code FROM p
UNION ALL SELECT doc_id, tab * 10 + 5, f_page, 0, tall, true, CASE WHEN tall > 40 THEN 'overflow' END FROM p WHERE rep"""
)
def table_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of forty lines, with tables (each tenth to a half of a document's lines) whose header rows are repeated, and chains of two headings."""
    k = F.col("ordinal") % 10
    rows = lined(spark, sf_dir).withColumn("kind", F.when(k >= 5, "row").when(k < 2, "heading").otherwise("paragraph"))
    return layout.paginate_tables(rows.withColumn("table", F.when(k >= 5, F.floor(F.col("ordinal") / 10))).withColumn("header", k == 5), 40)


@query(BLOCKS + ", c AS (SELECT doc_id, max(ordinal) AS last FROM blocks GROUP BY 1), e AS (SELECT b.doc_id, b.ordinal FROM blocks b WHERE contains(lower(text), 'secret')), x AS (SELECT doc_id, min(ordinal) AS cut FROM e GROUP BY 1) SELECT doc_id, last + 1 AS blocks, CASE WHEN cut IS NULL THEN 'kept' WHEN cut < 2 THEN 'whole' ELSE 'suffix' END AS state FROM c LEFT JOIN x USING (doc_id)")
def layout_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name a secret grow by fifty lines of text: which documents keep their pages, lose all, or are folded from a page on.

    The new pages are those of full pagination (tested); rows here are of documents whose folded blocks agree with the state.
    """
    before = lined(spark, sf_dir)
    after = before.withColumn("lines", F.col("lines") + F.when(F.lower("text").contains("secret"), 50).otherwise(0))
    _, used = layout.repaginate(before, layout.paginate(before, 40), after, 40)
    cut = after.where(F.lower("text").contains("secret")).groupBy("doc_id").agg(F.min("ordinal").alias("cut"))
    state = F.when(F.col("folded") == 0, "kept").when(F.col("cut") < 2, "whole").when((F.col("folded") >= F.col("blocks") - F.col("cut")) & (F.col("folded") <= F.col("blocks")), "suffix")
    return used.join(cut, "doc_id", "left").select("doc_id", "blocks", state.alias("state"))


@query(BLOCKS + ", h AS (SELECT doc_id, max(ordinal) // 10 + 1 AS pages FROM blocks GROUP BY 1), s AS (SELECT doc_id, lang || ' ' || source AS header FROM documents) SELECT doc_id, unnest(range(1, pages + 1))::BIGINT AS page, header FROM h JOIN s USING (doc_id)")
def header_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = blocks_of(spark, sf_dir).groupBy("doc_id").agg(F.floor(F.max("ordinal") / 10 + 1).alias("n")).select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("page"))
    sections = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("header"))
    return layout.bands(pages, sections, "doc_id")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE o_orderkey % 3 = 0 END AS contiguous FROM orders")
def provenance_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from version 0 to 3: all there, one missing, one repeated, one short unless the target is short too."""
    hop = lambda a, b: F.struct(F.lit(a).cast("long").alias("from"), F.lit(b).cast("long").alias("to"))
    k = F.col("o_orderkey")
    hops = F.when(k % 4 == 0, F.array(hop(0, 1), hop(1, 2), hop(2, 3))).when(k % 4 == 1, F.array(hop(0, 1), hop(2, 3))).when(k % 4 == 2, F.array(hop(0, 1), hop(1, 2), hop(1, 2), hop(2, 3))).otherwise(F.array(hop(0, 1), hop(1, 2)))
    target = F.when((k % 4 == 3) & (k % 3 == 0), 2).otherwise(3)
    return read(spark, sf_dir, "orders").select("o_orderkey", validate.contiguous(hops, F.lit(0), target).alias("contiguous"))
