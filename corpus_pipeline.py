"""A corpus from documents to packed sequences: five stages, each an operator of marginalia.llm.

Every stage works on all rows its predecessor kept and is written as Parquet
before the next reads it, in the shared folder that spark.checkpoint.dir names;
a stage's table is deleted when the next one's is written.
Columns besides those of documents are carried as they are. What each stage does
with nulls, empty texts and repeated rows is said in its operator's docstring; a
row whose doc_id is null is kept by every filter that isn't about its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, lines, minhash, packing, quality
from marginalia.llm.common import discard, free, keep, table

LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives less than LEAST_QUALITY go.

    Null and empty texts have the score of a text without words; repeated rows
    have equal scores and go or stay together. An empty table stays empty.
    """
    score = free(docs, "_score")
    scored = quality.with_scores(docs, table(spark, sf_dir, "labels"), out=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier one repeats, or all but repeats, go; so do documents of which nothing is left.

    Null, empty and blank texts have no lines to lose and stay as they are. Of
    repeated rows one keeps its lines, and the others are left with none and go.
    """
    removed = free(docs, "_removed")
    found = lines.dedupe_lines(docs, out=removed)
    return found.where((F.col(removed) == 0) | (F.trim("text") != "")).drop(removed)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays (five-word shingles, 0.8): that with the smallest doc_id, nulls last.

    Rows of a group that share it are told apart by a hash of their text, and of
    rows alike in both one stays. Null, empty and blank texts are in no group.
    """
    found = keep(minhash.near_duplicates(docs, minhash.Rule(width=5, percent=80)), "groups")
    grouped = found.where("component is not null").select("component", F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("text_hash").alias("hash")).alias("row"))
    first = grouped.groupBy("component").agg(F.min("row").alias("first"))
    gone = grouped.join(first, "component").where("row <> first").select(F.col("row.doc_id").alias("_id"), F.col("row.hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
    left = docs.join(gone, same, "left_anti")
    again = keep(grouped.groupBy("row").count().where("count > 1").select(F.col("row.doc_id").alias("_id"), F.col("row.hash").alias("_hash")), "again")
    if again.isEmpty():
        return left
    same = left["doc_id"].eqNullSafe(again["_id"]) & (F.xxhash64(left["text"]) == again["_hash"])
    mark = free(docs, "_hash")
    one = left.join(again, same, "left_semi").withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)
    return left.join(again, same, "left_anti").union(one)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts hold none; repeated rows go or stay together.
    """
    leaks = free(docs, "_leaks")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), out=leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their sequence and offset.

    Null and empty texts are the end id alone; repeated rows are packed each; an
    empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The stages learn models and iterate, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
