"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, side


def large_star(edges: DataFrame, rows: int = 0) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(side(least, rows), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def small_star(edges: DataFrame, rows: int = 0) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(side(least, rows), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether edges to smaller nodes are stars: every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up + root > 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of edges (a, b long); component is the smallest node that can be reached.

    Every round writes its edges to the shared folder and deletes those of the
    round before, so lineage stays short and a lost executor costs one round at most. A round leaves at most as many
    edges as it got; hot nodes meet in partial minima and in joins that adaptive
    execution may split; many edges are never broadcast. Loops (a = a) are components of one; no edges, no rows.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    now = keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    rows = now.count()  # rounds leave no more
    while True:
        before, now = now, keep(small_star(large_star(now, rows), rows), "edges")
        discard(before)
        if settled(now):
            break
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = loops.join(side(found.union(roots), rows), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(roots).union(alone)
