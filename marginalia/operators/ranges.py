"""Range, as-of, prefix and successor lookups. Each sorts once by key and place; none compares all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_in_range(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, stop: str, name: str, forward: bool = True) -> DataFrame:
    """The range of each point, both ends inclusive; ranges of a key don't overlap but for their ends.

    On a common end a forward point takes the range that begins there, a
    backward one the range that ends there. Null name: no range.
    """
    # a point looks back to the last range that begins at it or before; points come after starts if forward, else before
    end = F.col(stop)
    p = points.select("*", F.lit(1 if forward else 0).alias("_o"), F.col(at).alias("_at"), F.lit(None).cast(ranges.schema[name].dataType).alias(name), F.lit(None).cast("long").alias("_end"), F.lit(True).alias("_p"))
    r = ranges.select(F.col(key), F.col(start).alias("_at"), F.col(name), end.cast("long").alias("_end"), F.lit(0 if forward else 1).alias("_o"), F.lit(False).alias("_p"))
    both = p.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_found", F.last(F.when(~F.col("_p"), F.struct(F.col(name).alias("n"), F.col("_end").alias("e"))), ignorenulls=True).over(w)).where("_p")
    return seen.select(*points.columns, F.when(F.col("_found.e") >= F.col(at), F.col("_found.n")).alias(name))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], closed: bool = False) -> DataFrame:
    """Pairs under a key whose intervals overlap: by more than a point, or closed by a point at least."""
    (s, e), (t, f) = a_range, b_range
    on = (F.col(s) <= F.col(f)) & (F.col(e) >= F.col(t)) if closed else (F.col(s) < F.col(f)) & (F.col(e) > F.col(t))
    return a.join(b, keys).where(on)


def carried(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The latest non-null value at or before each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


#: Keys of a prefix table that are written into the plan, at most; more are joined.
LITERAL_KEYS = 256


def longest_prefix(rows: DataFrame, text: str, keys: DataFrame, key: str) -> DataFrame:
    """For each row the longest key (not empty) that its text begins with, or null.

    Few keys are tried within the row, longest first, without a shuffle. Of many,
    the prefixes of each distinct text are joined by equality.
    """
    keys = keys.select(key).where(F.length(key) > 0).distinct()
    few = sorted((r[key] for r in keys.limit(LITERAL_KEYS + 1).collect()), key=lambda k: (-len(k), k))
    if len(few) <= LITERAL_KEYS:
        fit = F.filter(F.array(*map(F.lit, few)).cast("array<string>"), lambda k: F.startswith(F.col(text), k))
        return rows.withColumn(key, F.get(fit, F.lit(0)))
    longest = keys.agg(F.max(F.length(key))).first()[0]
    texts = rows.select(F.col(text).alias("_text")).where(F.length("_text") > 0).distinct()
    prefixes = texts.select("_text", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("_text")))).alias("_n")).withColumn(key, F.substr("_text", F.lit(1), F.col("_n")))
    found = prefixes.join(keys, key).groupBy("_text").agg(F.max_by(key, F.length(key)).alias(key))
    return rows.join(found, F.col(text) == F.col("_text"), "left").drop("_text")


def successor(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The next strictly greater value under the key, or null."""
    w = Window.partitionBy(key).orderBy(value)
    following = rows.select(key, value).distinct().withColumn(name, F.lead(value).over(w))
    return rows.join(following, [key, value])


def islands(rows: DataFrame, key: str, order: list[str], same: Column, name: str) -> DataFrame:
    """Numbers from 1 for runs of rows; a run ends where `same` (of a row and the one before) is false."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def prefix_sum(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of the rows before each."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def neighbours(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """previous and next value in order, null at the ends."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))
