"""Queries of lookups by place: ranges, as-of, prefixes, islands, prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranges
from ..registry import query, read

LINES = """
WITH b AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS line, unnest(range(len(t))) AS ordinal FROM b),
lines AS (SELECT doc_id, ordinal, line, (coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM u)"""


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with their start and stop where lines stand end to end."""
    split = lambda lines: F.zip_with(lines, text.sums_before(F.transform(lines, F.length)), lambda line, start: F.struct(line.alias("line"), start.alias("start")))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.let(F.split("text", "\n"), split)).alias("ordinal", "x"))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "x.line", "x.start", (F.col("x.start") + F.length("x.line")).alias("stop"))


def anchors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place at every line's start, and one 100 after it."""
    return lines_of(spark, sf_dir).where("stop > start").select("doc_id", F.explode(F.array(F.col("start"), F.col("start") + 100)).alias("place"))


ANCHORS = LINES + """, full_lines AS (SELECT * FROM lines WHERE length(line) > 0), anchors AS (SELECT doc_id, unnest([start, start + 100]) AS place FROM full_lines)"""


@query(
    ANCHORS
    + """
SELECT a.doc_id, a.place, max(l.ordinal) AS line FROM anchors a LEFT JOIN full_lines l ON l.doc_id = a.doc_id AND l.start <= a.place AND l.start + length(l.line) >= a.place GROUP BY ALL"""
)
def anchor_line_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir).where("stop > start")
    return ranges.point_in_range(anchors_of(spark, sf_dir).distinct(), lines, "doc_id", "place", "start", "stop", "ordinal").withColumnRenamed("ordinal", "line")


@query(
    ANCHORS
    + """
SELECT a.doc_id, a.place, min(l.ordinal) FILTER (l.start < a.place OR a.place = 0) AS line FROM anchors a LEFT JOIN full_lines l ON l.doc_id = a.doc_id AND l.start <= a.place AND l.start + length(l.line) >= a.place WHERE a.place > 0 GROUP BY ALL"""
)
def anchor_line_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir).where("stop > start")
    points = anchors_of(spark, sf_dir).where("place > 0").distinct()
    return ranges.point_in_range(points, lines, "doc_id", "place", "start", "stop", "ordinal", forward=False).withColumnRenamed("ordinal", "line")


@query(
    LINES
    + """, s AS (SELECT doc_id, 50::BIGINT AS sel_start, least(400, n_chars) AS sel_stop FROM documents)
SELECT doc_id, ordinal::BIGINT AS ordinal, (least(start + length(line), sel_stop) - greatest(start, sel_start))::BIGINT AS selected FROM lines JOIN s USING (doc_id) WHERE start < sel_stop AND start + length(line) > sel_start"""
)
def selection_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each line a document's selection (50 to 400) covers."""
    selection = read(spark, sf_dir, "documents").select("doc_id", F.lit(50).cast("long").alias("sel_start"), F.least(F.lit(400), "n_chars").alias("sel_stop"))
    found = ranges.overlapping(lines_of(spark, sf_dir), selection, ["doc_id"], ("start", "stop"), ("sel_start", "sel_stop"))
    return found.select("doc_id", "ordinal", (F.least("stop", "sel_stop") - F.greatest("start", "sel_start")).alias("selected"))


@query(
    """
SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
AND a.l_linenumber * 10 <= b.l_linenumber * 10 + b.l_quantity AND a.l_linenumber * 10 + a.l_quantity >= b.l_linenumber * 10"""
)
def fragment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed overlap of fragments within an order: an order has few lines, so its pairs are few."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("e"))
    a = rows.select("l_orderkey", F.col("l_linenumber").alias("line_a"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = rows.select("l_orderkey", F.col("l_linenumber").alias("line_b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return ranges.overlapping(a, b, ["l_orderkey"], ("s1", "e1"), ("s2", "e2"), closed=True).where("line_a < line_b").select("l_orderkey", "line_a", "line_b")


@query(
    """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations"""
)
def section_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that a block belongs to: the latest user turn at or before it."""
    return ranges.carried(read(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


# Keys of the prefix table.
KEYS = ("S", "ST", "STA", "STANDARD", "P", "PRO", "LARGE", "LARGE B", "SMALL", "ECO", "MED", "MEDIUM P")


@query(
    f"""
WITH k(code) AS (VALUES {", ".join(f"('{k}')" for k in KEYS)}), m AS (SELECT p_partkey, max(length(code)) AS n FROM part JOIN k ON starts_with(p_type, code) GROUP BY 1)
SELECT p.p_partkey, left(p_type, n) AS code FROM part p LEFT JOIN m USING (p_partkey)"""
)
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(k,) for k in KEYS], "code string")
    return ranges.longest_prefix(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", keys, "code").select("p_partkey", "code")


@query("SELECT o_orderkey, (SELECT min(n.o_orderdate) FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderdate > o.o_orderdate) AS following FROM orders o")
def successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ranges.successor(rows, "o_custkey", "o_orderdate", "following").select("o_orderkey", "following")


@query(
    """
WITH l AS (SELECT *, lag(event_type) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(CASE WHEN t = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS rows FROM i GROUP BY ALL"""
)
def directional_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands: runs of one event type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("t", F.lag("event_type").over(w))
    rows = ranges.islands(rows, "user_id", ["ts", "event_id"], F.coalesce(F.col("t") == F.col("event_type"), F.lit(False)), "run")
    return rows.groupBy("user_id", F.col("run").cast("long").alias("run"), "event_type").agg(F.count("*").alias("rows"))


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::BIGINT * 64) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x, l_partkey FROM lineitem")
def glyph_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each glyph of a line begins: the advances before it."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = ranges.prefix_sum(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_quantity").cast("long") * 64, "x")
    return out.select("l_orderkey", "l_linenumber", F.col("x").cast("long").alias("x"), "l_partkey")


@query("SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def adjacent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.neighbours(read(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], "turn").select("conv_id", "turn", "previous", "next")


@query(
    """
WITH c AS (SELECT l_orderkey AS grid, l_linenumber AS cell, l_partkey, min(CASE WHEN l_quantity > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS ok FROM lineitem)
SELECT grid, cell, lag(l_partkey) OVER w AS previous, lead(l_partkey) OVER w AS next FROM c WHERE ok = 1 WINDOW w AS (PARTITION BY grid ORDER BY cell, l_partkey)"""
)
def cell_focus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in row-major order; a table with a cell without text has none at all."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grid"), F.col("l_linenumber").alias("cell"), "l_partkey", "l_quantity")
    rows = rows.withColumn("ok", F.min((F.col("l_quantity") > 2).cast("int")).over(Window.partitionBy("grid"))).where("ok = 1")
    return ranges.neighbours(rows, "grid", ["cell", "l_partkey"], "l_partkey").select("grid", "cell", "previous", "next")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS tab_order, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey)::BIGINT AS place FROM orders")
def widget_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab order by field list, output order by geometry: two orders of the same rows."""
    tab, place = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_totalprice", "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.row_number().over(tab) - 1).cast("long").alias("tab_order"), F.row_number().over(place).cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + coalesce(lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey), 0) AS room FROM lineitem WHERE l_returnflag = 'R'")
def keep_with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading's own height and that of what follows; the SQL leaves open which of two alike in line and part comes first: here the lower one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    return read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") + F.coalesce(F.lead("l_quantity").over(w), F.lit(0))).alias("room"))
