"""Identity: reconciling, deduplicating and budgeting records by key and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Budgets of a recovery image and of a session.
RECORDS, BYTES = 10_000, 64 * 1024 * 1024


def reconcile(rows: DataFrame, key: list[str], content: Column) -> DataFrame:
    """For each key its records, distinct contents and status: single, idempotent (equal copies) or conflict."""
    found = rows.groupBy(*key).agg(F.count("*").alias("records"), F.countDistinct(content).alias("contents"))
    return found.withColumn("status", F.when(F.col("contents") > 1, "conflict").when(F.col("records") > 1, "idempotent").otherwise("single"))


def dedupe(rows: DataFrame, key: list[str], content: Column) -> tuple[DataFrame, DataFrame]:
    """One row for each key whose records are equal; and the keys whose records differ, which is an error, not a choice."""
    found = reconcile(rows, key, content)
    # equal copies: any one of them will do, so dropDuplicates is deterministic in all that the content covers
    good = rows.join(found.where("status <> 'conflict'").select(*key), key, "left_semi").dropDuplicates(key)
    return good, found.where("status = 'conflict'")


def guarded_union(durable: DataFrame, incoming: DataFrame, key: list[str], content: Column) -> tuple[DataFrame, DataFrame]:
    """Union by key where a key on both sides must have equal content."""
    return dedupe(durable.unionByName(incoming), key, content)


def budget(rows: DataFrame, group: list[str], size: Column, records: int = RECORDS, most: int = BYTES) -> DataFrame:
    """Records and bytes of each group, counted before any deduplication, against the limits."""
    found = rows.groupBy(*group).agg(F.count("*").alias("records"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
    code = F.when(F.col("records") > records, "record_limit").when(F.col("bytes") > most, "byte_limit")
    return found.withColumn("code", code)


def commit_budget(existing: DataFrame, candidate: DataFrame, group: list[str], physical_key: str, size: Column, records: int = RECORDS, most: int = BYTES) -> DataFrame:
    """The budget of what a commit would leave: both sides, each physical key once."""
    return budget(existing.unionByName(candidate).dropDuplicates([*group, physical_key]), group, size, records, most)


def same_set(a: DataFrame, b: DataFrame, group: list[str], key: str) -> DataFrame:
    """For each group whether two sets of keys are equal, and how many are on one side only."""
    both = a.select(*group, key).distinct().withColumn("_a", F.lit(1)).join(b.select(*group, key).distinct().withColumn("_b", F.lit(1)), [*group, key], "full")
    return both.groupBy(*group).agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra")).withColumn("equal", (F.col("missing") + F.col("extra")) == 0)


def disposition(records: DataFrame, durable: DataFrame, commit: str, kind: str, key: str, content: str) -> DataFrame:
    """What becomes of each commit, whose records (commit, kind, key, content) meet durable ones (kind, key, content).

    Kinds are transaction, audit, snapshot and asset. identity_conflict: a key is
    there with other content. idempotent: all is there. partial_record_set: a
    transaction without its audit or the other way round, a snapshot without its
    transaction, or a transaction without an asset. committed: the rest.
    """
    there = durable.groupBy(kind, key).agg(F.min(content).alias("_low"), F.max(content).alias("_high"))
    state = F.when(F.col("_low").isNull(), "missing").when((F.col("_low") == F.col(content)) & (F.col("_high") == F.col(content)), "exact").otherwise("conflict")
    rows = records.join(there, [kind, key], "left").withColumn("_state", state)
    of = lambda k: F.max(F.when(F.col(kind) == k, F.col("_state")))
    found = rows.groupBy(commit).agg(
        of("transaction").alias("_t"), of("audit").alias("_a"), of("snapshot").alias("_s"), F.bool_or(F.col("_state") == "conflict").alias("_conflict"),
        F.bool_and(F.col("_state") == "exact").alias("_exact"), F.coalesce(F.bool_and(F.when(F.col(kind) == "asset", F.col("_state") == "exact")), F.lit(True)).alias("_assets"),
    )
    partial = ~F.col("_t").eqNullSafe(F.col("_a")) | ((F.col("_t") == "missing") & (F.col("_s") == "exact")) | ((F.col("_t") == "exact") & ~F.col("_assets"))
    code = F.when(F.col("_conflict"), "identity_conflict").when(F.col("_exact"), "idempotent").when(F.coalesce(partial, F.lit(False)), "partial_record_set").otherwise("committed")
    return found.select(commit, code.alias("disposition"))


def completeness(descriptors: DataFrame, records: DataFrame, content_hash: str, size: str) -> DataFrame:
    """Each descriptor against the byte records: ok, missing, size_mismatch or divergent; unreferenced records don't matter."""
    found = records.groupBy(content_hash).agg(F.count("*").alias("_n"), F.min(size).alias("_low"), F.max(size).alias("_high"))
    code = F.when(F.col("_n").isNull(), "missing").when(F.col("_low") != F.col("_high"), "divergent").when(F.col("_low") != F.col(size), "size_mismatch").otherwise("ok")
    return descriptors.join(found, content_hash, "left").withColumn("code", code).drop("_n", "_low", "_high")


def compare_and_swap(requests: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """Requests (key, expected, proposed) against heads (key, head): create, retry, extend or conflict."""
    code = F.when(F.col("head").isNull() & F.col("expected").isNull(), "create").when(F.col("head") == F.col("proposed"), "retry").when(F.col("head") == F.col("expected"), "extend").otherwise("conflict")
    return requests.join(heads, key, "left").withColumn("code", code)
