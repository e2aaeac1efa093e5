"""Forms, reviews, audits and lineage: classifications as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_code(anchor_status: Column, node: Column, offset: Column, length: Column) -> Column:
    """Why a field needs review, or null: its anchor was never valid, its node was deleted or isn't there, or its place isn't."""
    return (
        F.when(anchor_status == "invalid", "legacy_invalid").when(anchor_status == "tombstone", "target_deleted").when(node.isNull(), "target_missing").when((offset < 0) | (offset > length), "position_invalid")
    )


def partition_fields(fields: DataFrame, doc: str, order: str, code: str) -> DataFrame:
    """Fields with a dense tab order from 0 over those without a code, in field order; the others have none."""
    w = Window.partitionBy(doc, F.col(code).isNull()).orderBy(order)
    return fields.withColumn("tab_order", F.when(F.col(code).isNull(), (F.row_number().over(w) - 1).cast("long")))


def value_summary(selected: Column, labels: Column) -> Column:
    """Labels of selected option ids in order; ids without one are left out. labels: a map."""
    return F.filter(F.transform(selected, lambda i: F.try_element_at(labels, i)), lambda x: x.isNotNull())


def audit_code(action: Column, outcome: Column, transaction: Column, base: Column, new: Column) -> Column:
    """What is wrong with an audit row, or null: success links a transaction and the next revision, failure neither."""
    return (
        F.when((outcome == "success") & transaction.isNull(), "transaction_required")
        .when((outcome == "failure") & transaction.isNotNull(), "transaction_forbidden")
        .when((outcome == "success") & (action != "recovery") & (new != base + 1), "revision_link")
        .when((outcome == "failure") & (new != base), "revision_link")
    )


def boundary_of(snapshots: DataFrame, doc: str, boundary: str) -> DataFrame:
    """The one boundary that a document's snapshots agree on; several are a conflict, none is none."""
    found = snapshots.groupBy(doc).agg(F.countDistinct(boundary).alias("_n"), F.max(boundary).alias("_b"))
    return found.select(doc, F.when(F.col("_n") == 1, F.col("_b")).alias("boundary"), F.when(F.col("_n") > 1, "conflict").when(F.col("_n") == 0, "none").otherwise("ok").alias("code"))


def reconcile_attributes(a: DataFrame, b: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Both sides by key: equal in all attributes (nulls equal nulls), or which is the first that differs; a key twice on a side is ambiguous."""
    one = lambda x, n: x.groupBy(key).agg(F.count("*").alias(f"_n{n}"), F.first(F.struct(*attributes)).alias(f"_{n}"))
    rows = one(a, "a").join(one(b, "b"), key, "full")
    code = F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").when((F.col("_na") > 1) | (F.col("_nb") > 1), "ambiguous")
    for c in attributes:
        code = code.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c)
    return rows.select(key, code.otherwise("equal").alias("code"))


def extends_head(transactions: DataFrame, heads: DataFrame, doc: str) -> DataFrame:
    """transactions: doc, id, base_revision, before. heads: doc, head_id, head_revision, head_hash. retry, extends or conflict."""
    code = F.when(F.col("id") == F.col("head_id"), "retry").when((F.col("base_revision") == F.col("head_revision")) & (F.col("before") == F.col("head_hash")), "extends").otherwise("conflict")
    return transactions.join(heads, doc, "left").select(doc, "id", F.coalesce(code, F.lit("conflict")).alias("code"))
