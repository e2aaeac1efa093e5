"""Queries of table and list commands, and of images and fields as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commands
from ..registry import query, read
from .tree_queries import BLOCKS, blocks_of

CELLS = """
WITH t AS (SELECT s_suppkey AS table_id, s_suppkey % 4 + 1 AS r, s_suppkey % 3 + 1 AS c FROM supplier), a AS (SELECT table_id, r, c, unnest(range(r)) AS "row" FROM t), cells AS (SELECT table_id, r, c, "row", unnest(range(c)) AS "column" FROM a)"""


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cells = commands.grid(read(spark, sf_dir, "supplier").select(k.alias("table_id"), (k % 4 + 1).alias("rows"), (k % 3 + 1).alias("columns")))
    return cells.select("table_id", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), F.concat_ws(":", "row", "column").alias("text"))


def asked(spark: SparkSession, sf_dir: str, **arguments: int) -> DataFrame:
    return read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("table_id"), *[F.lit(v).cast("long").alias(k) for k, v in arguments.items()])


@query(CELLS + """, m AS (SELECT table_id, "row" + CASE WHEN table_id % 2 = 0 AND "row" > 0 THEN 1 ELSE 0 END AS "row", "column", "row" || ':' || "column" AS text FROM cells UNION ALL SELECT table_id, 1, "column", '' FROM cells WHERE table_id % 2 = 0 AND "row" = 0) SELECT * FROM m""")
def add_table_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.insert_line(cells_of(spark, sf_dir), asked(spark, sf_dir, after=0), "row")


@query(CELLS + """, m AS (SELECT table_id, "row", "column" + CASE WHEN table_id % 2 = 0 AND c > 1 AND "column" > 1 THEN 1 ELSE 0 END AS "column", "row" || ':' || "column" AS text FROM cells UNION ALL SELECT table_id, "row", 2, '' FROM cells WHERE table_id % 2 = 0 AND "column" = 1) SELECT * FROM m""")
def add_table_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.insert_line(cells_of(spark, sf_dir), asked(spark, sf_dir, after=1), "column")


@query(CELLS + """ SELECT table_id, CASE WHEN table_id % 2 = 0 AND r > 1 THEN "row" - 1 ELSE "row" END AS "row", "column", "row" || ':' || "column" AS text FROM cells WHERE NOT (table_id % 2 = 0 AND r > 1 AND "row" = 0)""")
def remove_table_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.remove_line(cells_of(spark, sf_dir), asked(spark, sf_dir, at=0), "row")


@query(CELLS + """ SELECT table_id, "row", CASE WHEN table_id % 2 = 0 AND c > 1 AND "column" > 1 THEN "column" - 1 ELSE "column" END AS "column", "row" || ':' || "column" AS text FROM cells WHERE NOT (table_id % 2 = 0 AND c > 1 AND "column" = 1)""")
def remove_table_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.remove_line(cells_of(spark, sf_dir), asked(spark, sf_dir, at=1), "column")


ITEMS = BLOCKS + ", items AS (SELECT doc_id, ordinal, (ordinal * 7 + doc_id) % 4 + CASE WHEN ordinal % 6 = 5 THEN 1 ELSE 0 END AS depth FROM blocks), s AS (SELECT doc_id, max(CASE WHEN ordinal = 2 THEN depth END) AS d, max(CASE WHEN ordinal = 1 THEN depth END) AS b FROM items WHERE doc_id % 3 = 0 GROUP BY 1), e AS (SELECT i.doc_id, min(CASE WHEN ordinal > 2 AND depth <= d THEN ordinal END) AS stop FROM items i JOIN s ON s.doc_id = i.doc_id GROUP BY 1)"


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("ordinal")
    return blocks_of(spark, sf_dir).select("doc_id", "ordinal", ((o * 7 + F.col("doc_id")) % 4 + F.when(o % 6 == 5, 1).otherwise(0)).alias("depth"))


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit(2).cast("long").alias("at"))


@query(ITEMS + " SELECT i.doc_id, ordinal, CASE WHEN d > 0 AND b >= d AND ordinal >= 2 AND (stop IS NULL OR ordinal < stop) THEN depth + 1 ELSE depth END AS depth FROM items i LEFT JOIN s ON s.doc_id = i.doc_id LEFT JOIN e ON e.doc_id = i.doc_id")
def indent_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest item has depth 4 here, so the limit of 8 is never met."""
    return commands.indent(items_of(spark, sf_dir), second(spark, sf_dir), 1)


@query(ITEMS + " SELECT i.doc_id, ordinal, CASE WHEN d > 0 AND ordinal >= 2 AND (stop IS NULL OR ordinal < stop) THEN depth - 1 ELSE depth END AS depth FROM items i LEFT JOIN s ON s.doc_id = i.doc_id LEFT JOIN e ON e.doc_id = i.doc_id")
def outdent_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.indent(items_of(spark, sf_dir), second(spark, sf_dir), -1)


@query("WITH a AS (SELECT sha256(p_type) AS h, min(p_partkey) AS asset FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey AS image, coalesce(asset, p_partkey) AS asset, asset IS NULL AS added FROM part LEFT JOIN a ON h = sha256(p_type) WHERE p_partkey % 2 = 1")
def insert_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New images take the asset that has their content already, if there is one."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.sha2("p_type", 256).alias("h"))
    there = rows.where("p_partkey % 2 = 0").groupBy("h").agg(F.min("p_partkey").alias("asset"))
    return rows.where("p_partkey % 2 = 1").join(there, "h", "left").select(F.col("p_partkey").alias("image"), F.coalesce("asset", "p_partkey").alias("asset"), F.col("asset").isNull().alias("added"))
