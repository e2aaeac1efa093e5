"""Aggregates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tri_state(x: Column) -> Column:
    """on where all are true (and where there are none), off where none is, else mixed."""
    return F.when(F.coalesce(F.bool_and(x), F.lit(True)), "on").when(~F.bool_or(x), "off").otherwise("mixed")


def uniform(x: Column) -> Column:
    """The value that all rows share, else null."""
    return F.when((F.min(x) == F.max(x)) & (F.count(x) == F.count("*")), F.min(x))


def nearest_ranks(rows: DataFrame, key: str, value: str, shares: dict[str, float], buckets: int = 1024) -> DataFrame:
    """Under each key, for each name the least value that its share of the non-null values doesn't exceed.

    Values are counted, and counts are summed in equal ranges between a key's
    least and most value. Running sums are taken over a key's ranges, which are
    few, and then over the values of the one range that holds the rank; so no
    task has all values of a key.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    span = counted.groupBy(key).agg(F.min(value).alias("_least"), F.max(value).alias("_most"), F.sum("_n").alias("_all"))
    place = F.when(F.col("_most") > F.col("_least"), F.least(F.floor((F.col(value) - F.col("_least")) / (F.col("_most") - F.col("_least")) * buckets), F.lit(buckets - 1))).otherwise(F.lit(0))
    dealt = counted.join(span.hint("broadcast") if span.limit(1001).count() <= 1000 else span, key).withColumn("_range", place)
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(key, "_all", "_range").agg(F.sum("_n").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.ceil(F.col("_all") * p), F.lit(1)).alias("rank")) for n, p in shares.items()])
    here = sums.select(key, "_range", "_before", "_in", F.explode(wanted).alias("_w")).where("_w.rank > _before and _w.rank <= _before + _in")
    close = dealt.select(key, "_range", value, "_n").join(here.select(key, "_range", "_before").distinct(), [key, "_range"])
    run = F.sum("_n").over(Window.partitionBy(key, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    found = close.withColumn("_upto", run).join(here.select(key, "_range", "_w"), [key, "_range"]).where("_upto >= _w.rank")
    return found.groupBy(key).agg(*[F.min(F.when(F.col("_w.name") == n, F.col(value))).alias(n) for n in shares])


def union_box(x: Column, y: Column, width: Column, height: Column) -> list[Column]:
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + width) - F.min(x)).alias("width"), (F.max(y + height) - F.min(y)).alias("height")]


def joined(text: Column, order: list[str], separator: str) -> Column:
    """Texts of a group in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], text.alias("_text"))))
    return F.array_join(F.transform(parts, lambda p: p["_text"]), separator)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("uses")).where("uses > 1")


def is_permutation(x: Column, first: int) -> Column:
    """Whether a group's values are first, first + 1, ... each once."""
    return (F.min(x) == first) & (F.max(x) == F.count("*") + first - 1) & (F.countDistinct(x) == F.count("*"))
