"""The edit log: continuity, audit binding, snapshots, checkpoints, recovery, undo and redo."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import many_keys

# A checkpoint is due after so many records or bytes.
CHECKPOINT_RECORDS, CHECKPOINT_BYTES = 100, 4 * 1024 * 1024


def chain(log: DataFrame, doc: str, revision: str, before: Column, after: Column) -> DataFrame:
    """For each document: revisions, gaps between them, places where a before-hash isn't the last after-hash, repeats."""
    w = Window.partitionBy(doc).orderBy(revision)
    rows = log.withColumn("_r", F.lag(revision).over(w)).withColumn("_h", F.lag(after).over(w)).withColumn("_b", before)
    gap = F.col(revision) - F.col("_r") > 1
    broken = (F.col(revision) - F.col("_r") == 1) & ~F.col("_b").eqNullSafe(F.col("_h"))
    return rows.groupBy(doc).agg(
        F.count("*").alias("revisions"), F.count_if(gap).alias("gaps"), F.count_if(F.col(revision) == F.col("_r")).alias("repeats"), F.count_if(broken).alias("breaks"),
        F.min(F.when(gap | broken, F.col(revision))).alias("first_bad"),
    )


def bind_audits(transactions: DataFrame, audits: DataFrame, key: str, equal: list[str]) -> DataFrame:
    """Transactions and audits by key: bound, mismatch (a column of `equal` differs), unaudited, or orphan."""
    t = transactions.select(key, F.struct(*equal).alias("_t"))
    a = audits.select(key, F.struct(*equal).alias("_a"))
    code = F.when(F.col("_a").isNull(), "unaudited").when(F.col("_t").isNull(), "orphan").when(F.col("_t").eqNullSafe(F.col("_a")), "bound").otherwise("mismatch")
    return t.join(a, key, "full").select(key, code.alias("code"))


def anchored(audits: DataFrame, anchors: list[DataFrame], keys: list[str]) -> DataFrame:
    """Audits whose (document, revision) is in any of the anchors."""
    union = anchors[0].select(*keys)
    for x in anchors[1:]:
        union = union.union(x.select(*keys))
    return audits.join(union, keys, "left_semi")


def newest_valid(snapshots: DataFrame, doc: str, order: list[Column], valid: Column) -> DataFrame:
    """Each document's first valid snapshot in `order`, and how many newer ones were passed over."""
    w = Window.partitionBy(doc).orderBy(*order)
    ranked = snapshots.withColumn("passed_over", F.row_number().over(w) - 1).where(valid)
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy("passed_over"))).where("_n = 1").drop("_n")


def recover(log: DataFrame, snapshots: DataFrame, doc: str, revision: str, value: Column) -> DataFrame:
    """State of each document: the snapshot's (doc, base_revision, state) and the sum of values after it."""
    rows = log.join(snapshots, doc).where(F.col(revision) > F.col("base_revision")).groupBy(doc).agg(F.sum(value).alias("_add"), F.count("*").alias("replayed"), F.max(revision).alias("_head"))
    out = snapshots.join(rows, doc, "left")
    return out.select(doc, F.coalesce("_head", "base_revision").alias("revision"), F.coalesce("replayed", F.lit(0)).alias("replayed"), (F.col("state") + F.coalesce("_add", F.lit(0))).alias("state"))


def checkpoint_due(log: DataFrame, doc: str, revision: str, size: Column, forced: Column) -> DataFrame:
    """Records and bytes since the last forced checkpoint, and whether one is due."""
    w = Window.partitionBy(doc).orderBy(revision).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("_n", F.count("*").over(w)).withColumn("_b", F.sum(size).over(w)).withColumn("_f", forced)
    at = lambda c: F.coalesce(F.last(F.when(F.col("_f"), F.col(c)), ignorenulls=True).over(w), F.lit(0))
    rows = rows.withColumn("since_records", F.col("_n") - at("_n")).withColumn("since_bytes", F.col("_b") - at("_b"))
    due = (F.col("since_records") >= CHECKPOINT_RECORDS) | (F.col("since_bytes") >= CHECKPOINT_BYTES)
    return rows.withColumn("due", due).drop("_n", "_b", "_f")


def undo_redo(log: DataFrame, doc: str, order: str, kind: str, command: str) -> DataFrame:
    """The stack of applied commands after a document's log of commit, undo and redo rows: what's applied, and what redo could bring back.

    A commit drops what redo could bring back. An undo or redo with nothing to
    act on is counted in ignored. Documents are dealt by key; one document's
    log is folded in order.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([doc, order])
        ends: dict[int, tuple[list, int, int]] = {}
        for d, k, c in zip(*(rows[x].tolist() for x in (doc, kind, command))):
            stack, cursor, ignored = ends.get(d, ([], 0, 0))
            if k == "undo":
                cursor, ignored = (cursor - 1, ignored) if cursor else (0, ignored + 1)
            elif k == "redo":
                cursor, ignored = (cursor + 1, ignored) if cursor < len(stack) else (cursor, ignored + 1)
            else:
                stack[cursor:] = [c]
                cursor += 1
            ends[d] = stack, cursor, ignored
        out = [(d, n, len(stack) - n, ignored, stack[n - 1] if n else None) for d, (stack, n, ignored) in ends.items()]
        return pd.DataFrame(out, columns=[doc, "applied", "redoable", "ignored", "top"]).astype({"top": "Int64"})

    return many_keys(log.select(doc, order, kind, command), doc).applyInPandas(fold, f"{doc} long, applied long, redoable long, ignored long, top long")


def stale(results: DataFrame, heads: DataFrame, doc: str, version: list[str]) -> DataFrame:
    """Results whose version isn't the head's now, by equality of versions, never by time."""
    ok = F.lit(True)
    for v in version:
        ok = ok & F.col(v).eqNullSafe(F.col(f"head_{v}"))
    return results.join(heads.select(doc, *[F.col(v).alias(f"head_{v}") for v in version]), doc, "left").withColumn("accepted", ok).drop(*[f"head_{v}" for v in version])


