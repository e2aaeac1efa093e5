"""Queries over documents as JSON text, made from the lines of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, read
from ..sources import documents

LETTERS = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"


def raw_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of four versions and some that are broken."""
    d = F.col("doc_id")
    t = F.regexp_replace("text", "[^A-Za-z ]", "")
    head = lambda v: F.concat(F.lit(f'{{"schemaVersion":{v},"documentId":"d'), d.cast("string"), F.lit('",'))
    block = lambda style, body: F.concat(F.lit('"content":[{"id":"n","kind":"paragraph",' + style), body, F.lit("}]}"))
    plain = F.concat(F.lit('"text":"'), t, F.lit('"'))
    runs = F.concat(F.lit('"runs":[{"text":"'), t, F.lit('","bold":true}]'))
    raw = (
        F.when(d % 8 == 0, F.concat(head(0), block("", plain)))
        .when(d % 8 == 1, F.concat(head(1), block('"styleId":"body",', plain)))
        .when(d % 8 == 2, F.concat(head(2), block('"styleId":"body",', runs)))
        .when(d % 8 == 3, F.concat(head(3), F.lit('"sections":[],'), block('"styleId":"body",', runs)))
        .when(d % 8 == 4, F.concat(head(9), block("", plain)))
        .when(d % 8 == 5, F.concat(head(0), F.lit('"more":1,'), block("", plain)))
        .when(d % 8 == 6, F.concat(F.repeat(F.lit("["), (d % 200).cast("int")), F.repeat(F.lit("]"), (d % 200).cast("int"))))
        .otherwise(F.concat(F.lit("{"), t))
    )
    return read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query("SELECT doc_id, CASE WHEN doc_id % 8 < 4 OR doc_id % 8 = 5 THEN CASE WHEN doc_id % 8 = 5 THEN 0 ELSE doc_id % 8 END WHEN doc_id % 8 = 4 THEN 9 END::INT AS version, CASE doc_id % 8 WHEN 4 THEN 'future_version' WHEN 6 THEN CASE WHEN doc_id % 200 > 128 THEN 'too_deep' WHEN doc_id % 200 = 0 THEN 'not_json' ELSE 'no_version' END WHEN 7 THEN 'not_json' END AS code FROM documents")
def scan_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.preflight(raw_of(spark, sf_dir)).select("doc_id", "version", "code")


@query(
    f"""
SELECT doc_id, (3 - doc_id % 8)::INT AS hops, '{{"schemaVersion":3,"documentId":"d' || doc_id || '","sections":' || CASE WHEN doc_id % 8 = 3 THEN '[]' ELSE '[{{"id":"d' || doc_id || '-s0","startNodeId":null}}]' END
|| ',"content":[{{"id":"n","kind":"paragraph","styleId":"body","runs":' || CASE WHEN doc_id % 8 < 2 AND {LETTERS} = '' THEN '[]' ELSE '[{{"text":"' || {LETTERS} || '","bold":' || CASE WHEN doc_id % 8 < 2 THEN 'false' ELSE 'true' END || '}}]' END || '}}]}}' AS canonical FROM documents WHERE doc_id % 8 < 4"""
)
def migration_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions 0 to 3 at the current one; those with an unknown field are refused."""
    return documents.migrate(documents.preflight(raw_of(spark, sf_dir))).select("doc_id", "hops", "canonical")


@query("""SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS physical_key FROM supplier""")
def content_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return documents.envelope(rows).select("s_suppkey", "physical_key")
