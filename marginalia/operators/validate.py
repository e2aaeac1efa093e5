"""Validation suites: every check gives (key, code) rows, so suites are unions and a clean document has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Limits of a form's values.
TEXT_BYTES, SELECTIONS, PAGES = 4096, 16, 2048


def failing(rows: DataFrame, key: list[str], code: str, bad: Column) -> DataFrame:
    """The keys of rows where bad holds."""
    return rows.where(bad).select(*key, F.lit(code).alias("code"))


def duplicated(rows: DataFrame, scope: list[str], value: str, code: str) -> DataFrame:
    """Scopes in which a value is there twice."""
    return rows.groupBy(*scope, value).agg(F.count("*").alias("_n")).where("_n > 1").select(*scope, F.lit(code).alias("code")).distinct()


def dangling(rows: DataFrame, key: list[str], reference: str, targets: DataFrame, target: str, code: str) -> DataFrame:
    """Rows whose reference isn't among the targets (null refers to nothing, and is fine)."""
    return rows.where(F.col(reference).isNotNull()).join(targets.select(F.col(target).alias(reference)), reference, "left_anti").select(*key, F.lit(code).alias("code"))


def not_increasing(rows: DataFrame, key: str, order: str, value: str, code: str) -> DataFrame:
    """Keys whose values don't rise strictly in order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_p", F.lag(value).over(w)).where(F.col(value) <= F.col("_p")).select(key, F.lit(code).alias("code")).distinct()


def suite(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def value_code(kind: Column, value: Column, required: Column, multiline: Column, selected: Column, options: Column) -> Column:
    """The first thing that is wrong with a typed value, or null: its kind decides which checks hold."""
    empty = F.when(kind == "choice", F.size(selected) == 0).otherwise(F.coalesce(value, F.lit("")) == "")
    return (
        F.when(empty, F.when(required, "required"))
        .when((kind == "text") & (F.octet_length(value) > TEXT_BYTES), "text_size_limit")
        .when((kind == "text") & ~multiline & value.contains("\n"), "multiline_not_allowed")
        .when((kind == "number") & ~t.is_decimal(value), "invalid_number")
        .when((kind == "date") & ~t.is_iso_date(value), "invalid_date")
        .when((kind == "email") & ~t.is_email(value), "invalid_email")
        .when((kind == "choice") & (F.size(selected) > SELECTIONS), "selection_limit")
        .when((kind == "choice") & ((F.size(F.array_distinct(selected)) < F.size(selected)) | (F.size(F.array_except(selected, options)) > 0)), "option_set_invalid")
        .when(~kind.isin("text", "number", "date", "email", "choice"), "unsupported_value")
    )


def form_state(fields: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """The override of each field, else its default."""
    return fields.join(overrides, key, "left").withColumn("effective", F.coalesce("override", "default"))


def contiguous(hops: Column, start: Column, stop: Column) -> Column:
    """Whether (from, to) hops lead from start to stop, each by one."""
    end = F.aggregate(hops, start.cast("long"), lambda at, h: F.when((h["from"] == at) & (h["to"] == at + 1), at + 1))
    return F.coalesce(end == stop, F.lit(False))
