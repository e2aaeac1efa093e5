"""Bounded samples of labelled documents, and models fitted on them in one task."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folds of crc32(doc_id as text); rows of fold 0 are never learnt from.
FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, float]:
    """At most per_class documents of either label (text, label), in hash order of doc_id, and the share of label 1.

    Only rows outside fold 0 are read. A doc_id with several labels counts with
    the least, one with several texts with that of the least hash; null labels
    and ids don't count. The ids, 2 * per_class at most,
    are sent to all tasks, so documents aren't shuffled.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    mark = F.xxhash64("doc_id", F.lit(5))
    picked = None
    for y in (0, 1):
        # the filter leaves a little more than is wanted, so that the exact cut sorts little
        share = min(1.0, 1.2 * per_class / max(1, counts.get(y, 0)) + 0.01)
        part = rows.where((F.col("label") == y) & (F.pmod(mark, F.lit(1 << 20)) < int(share * (1 << 20)))).orderBy(mark).limit(per_class)
        picked = part if picked is None else picked.union(part)
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    one = chosen.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x"))
    return one.select("doc_id", "x.text", "label"), counts.get(1, 0) / max(1, sum(counts.values()))


def fitted(rows: DataFrame, fit: Callable[[list[str], list[int]], bytes]) -> bytes:
    """What fit makes of the sample, in one task; rows are put in order first, so it is the same each time."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        return pa.table({"model": pa.array([fit(t.column("text").to_pylist(), t.column("label").to_pylist())], pa.binary())})

    got = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "model binary").first()
    return got["model"] if got else fit([], [])
