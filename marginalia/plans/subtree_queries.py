"""Queries over subtrees as intervals: nations under regions, suppliers and customers under nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import subtrees
from ..registry import query
from .tree_queries import NODES, nodes_of

NAMES = ("doc", "node", "parent", "ordinal")
#: Deleted: every third nation, every seventh supplier, and one region.
CUT = "(node LIKE 'n%' AND ordinal % 3 = 0) OR (node LIKE 's%' AND ordinal % 7 = 0) OR node = 'r2'"


@query(
    NODES.replace("t AS (SELECT node,", f"t AS (SELECT CASE WHEN {CUT} THEN node END AS removed_by, node,", 1)
    .replace("UNION ALL SELECT n.node, t.depth", "UNION ALL SELECT coalesce(t.removed_by, CASE WHEN (n.node LIKE 'n%' AND n.ordinal % 3 = 0) OR (n.node LIKE 's%' AND n.ordinal % 7 = 0) OR n.node = 'r2' THEN n.node END), n.node, t.depth", 1)
    + " SELECT node, removed_by FROM t"
)
def delete_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with the topmost deleted node that it went with, or null where it stays."""
    rows = subtrees.intervals(nodes_of(spark, sf_dir), *NAMES)
    left, gone, _ = subtrees.delete(rows, rows.where(CUT).select("doc", "node", F.col("enter").alias("command")), *NAMES)
    return left.select("node", F.lit(None).cast("string").alias("removed_by")).union(gone.select("node", "root"))


@query(NODES + ", s AS (SELECT node, unnest(list_concat([node], CASE depth WHEN 0 THEN [] WHEN 1 THEN [root] ELSE [root, parent] END)) AS above FROM t JOIN nodes USING (node)) SELECT above AS node, count(*) AS size, sum(length(node))::BIGINT AS weight FROM s GROUP BY above")
def subtree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each subtree, and their names' characters."""
    return subtrees.intervals(nodes_of(spark, sf_dir), *NAMES, weight=F.length("node")).select("node", "size", "weight")


@query(
    NODES
    + """, c AS (SELECT parent AS node, list(node ORDER BY ordinal) AS now FROM nodes WHERE parent LIKE 'r%' GROUP BY parent),
d AS (SELECT node, list_filter(now, lambda x: substr(x, 2)::INT % 2 = 0) AS kept FROM c WHERE node <> 'r3'),
l AS (SELECT node, list_append(list_reverse(kept), 'x' || node) AS new FROM d),
p AS (SELECT node AS parent, unnest(new) AS node, unnest(range(len(new))) AS place FROM l),
g AS (SELECT n.node FROM nodes n WHERE n.parent IN (SELECT node FROM d) AND n.node NOT IN (SELECT node FROM p))
SELECT n.node, n.parent, coalesce(p.place, n.ordinal)::BIGINT AS ordinal FROM nodes n LEFT JOIN p ON p.node = n.node WHERE n.node NOT IN (SELECT node FROM g) AND (n.parent IS NULL OR n.parent NOT IN (SELECT node FROM g))
UNION ALL SELECT node, parent, place::BIGINT FROM p WHERE node LIKE 'x%'"""
)
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions keep their even nations in reverse and get a new node at the end; the region whose children aren't those expected stays as it is."""
    rows = subtrees.intervals(nodes_of(spark, sf_dir), *NAMES)
    lists = rows.where("depth = 1").groupBy("doc", F.col("parent").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "node"))), lambda x: x["node"]).alias("now"))
    even = F.reverse(F.filter("now", lambda x: F.substring(x, 2, 9).cast("int") % 2 == 0))
    expected = F.when(F.col("node") == "r3", F.reverse("now")).otherwise(F.col("now"))
    commands = lists.select("doc", "node", expected.alias("expected"), F.concat(even, F.array(F.concat(F.lit("x"), "node"))).alias("replacement"))
    return subtrees.replace_children(rows, commands, *NAMES)[0].select("node", "parent", "ordinal")
