"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, language, lines, lm, middle, minhash, negatives, packing, quality, secrets, toxicity, urls
from .common import table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.judged(quality.scores(docs, labels), 0.3)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Rule(width=4, percent=80))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.judged(toxicity.scores(docs, labels), 0.5)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.secrets(docs))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_against_next(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.judged(language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.quantised(negatives.relabelled(table(spark, sf_dir, "embeddings")))
    return negatives.mine(rows, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_decontaminate": op2_decontaminate,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_url_filters": op8_url_filters,
    "op9_fingerprint": op9_fingerprint,
    "op10_line_dedup": op10_line_dedup,
    "op11_language": op11_language,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op8_url_filters": urls.oracle(),
    "op12_fill_in_middle": middle.oracle(),
    "op13_hard_negatives": negatives.oracle(),
}
