"""Trees as intervals: labels made once, after which subtrees are ranges.

A node's label is (enter, leave): enter grows in preorder, leave is the greatest
enter of its subtree, so a node lies under another one when its enter lies in that one's
interval. Labels order nodes of a document and have gaps; nothing else is meant by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep
from . import tree

#: Fixed value: bytes that a removed subtree may have, since it is kept for its undoing.
PREIMAGE = 8 * 1024 * 1024


def intervals(nodes: DataFrame, doc: str, node: str, parent: str, ordinal: str, weight: Column | None = None) -> DataFrame:
    """nodes with depth, root, enter, leave, size (nodes of the subtree) and weight (summed over it; 0 by default).

    Nodes are sorted once over all documents, in ranges of (document, path). Each adds
    itself to its ancestors' totals, which are summed before they are shuffled, so a root of
    many nodes is no task's burden. Nodes that no root reaches have no row.
    """
    found = tree.paths(nodes, doc, node, parent, ordinal).select(doc, node, "depth", "path", "root")
    weighed = found.join(nodes.select(doc, node, (F.lit(0) if weight is None else F.coalesce(weight, F.lit(0))).cast("long").alias("_w")), [doc, node])
    # written once: the numbers must be the same wherever they are read
    sorted_ = keep(weighed.orderBy(doc, "path", node).withColumn("enter", F.monotonically_increasing_id()), "preorder")
    up = sorted_.select(doc, "enter", "_w", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("path"))
    totals = up.groupBy(doc, "path").agg(F.max("enter").alias("leave"), F.count("*").alias("size"), F.sum("_w").alias("weight"))
    labels = sorted_.join(totals, [doc, "path"]).select(doc, node, "depth", "root", "enter", "leave", "size", "weight")
    return nodes.join(labels, [doc, node])


def covering(labelled: DataFrame, doc: str, cut: Column, *named: Column) -> DataFrame:
    """labelled with _cut: of the outermost node at or above each for which `cut` holds, a struct of `named`; null where there is none.

    One pass in order of enter: the outermost open interval is the one that ends last, and of those the widest.
    """
    w = Window.partitionBy(doc).orderBy("enter").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(cut, F.struct(F.col("leave").alias("leave"), (-F.col("enter")).alias("wide"), F.struct(*named).alias("named")))).over(w)
    return labelled.withColumn("_last", last).withColumn("_cut", F.when(F.col("_last.leave") >= F.col("enter"), F.col("_last.named"))).drop("_last")


def delete(labelled: DataFrame, commands: DataFrame, doc: str, node: str, parent: str, ordinal: str, fallback: str = "fallback") -> tuple[DataFrame, DataFrame, DataFrame]:
    """commands: doc, node, command. What is left, what went, and what became of each command.

    Left are the columns doc, node, parent, ordinal; a document that would be left with nothing has one
    node named `fallback`. What went has the topmost removed node above it (root) and that one's
    command, so an anchor in it is known to be deleted and by what. A command's code is null, or
    unknown_node, or preimage_too_large; a command under another one's subtree has none of its own
    (covered).
    """
    # of several commands for a node the least counts
    asked = commands.groupBy(doc, node).agg(F.min("command").alias("_command"))
    rows = labelled.join(asked, [doc, node], "left").withColumn("_cuts", F.col("_command").isNotNull() & (F.col("weight") <= PREIMAGE))
    rows = covering(rows, doc, F.col("_cuts"), F.col(node).alias("root"), F.col("_command").alias("command"))
    left = rows.where("_cut is null").select(doc, node, parent, ordinal)
    empty = rows.groupBy(doc).agg(F.bool_and(F.col("_cut").isNotNull()).alias("_all")).where("_all")
    types = {c: t for c, t in labelled.dtypes}
    spare = empty.select(doc, F.lit(fallback).cast(types[node]).alias(node), F.lit(None).cast(types[parent]).alias(parent), F.lit(0).cast(types[ordinal]).alias(ordinal))
    gone = rows.where("_cut is not null").select(doc, node, "_cut.root", "_cut.command")
    there = rows.where("_command is not null").select(doc, node, F.lit(True).alias("_there"), "_cuts", F.col("_cut.root").alias("_root"))
    code = F.when(F.col("_there").isNull(), "unknown_node").when(~F.col("_cuts"), "preimage_too_large").when(F.col("_root") != F.col(node), "covered")
    return left.unionByName(spare), gone, commands.join(there, [doc, node], "left").select(doc, node, "command", code.alias("code"))


def replace_children(labelled: DataFrame, commands: DataFrame, doc: str, node: str, parent: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """commands: doc, node, expected, replacement (arrays of node ids in order), one a node. The tree after those whose node has just the expected
    children, and each command's code: null, unknown_node, or children_changed.

    A child that isn't in the replacement goes with its subtree; one that is keeps its own and
    gets its place there; ids that aren't children yet are new leaves. A document's ids are its own, so a replacement
    that names a node from elsewhere in the tree is refused (duplicate_node).
    """
    lists = labelled.where(F.col(parent).isNotNull()).groupBy(doc, F.col(parent).alias(node)).agg(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, node))), lambda x: x[node]).alias("_now"))
    named = commands.select(doc, F.col(node).alias("_of"), F.explode(F.array_except("replacement", "expected")).alias(node))
    taken = named.join(labelled.select(doc, node), [doc, node], "left_semi").select(doc, F.col("_of").alias(node), F.lit(True).alias("_taken")).distinct()
    known = labelled.select(doc, node, F.lit(True).alias("_there"))
    checked = commands.join(known, [doc, node], "left").join(lists, [doc, node], "left").join(taken, [doc, node], "left")
    types = {c: t for c, t in labelled.dtypes}
    now = F.coalesce("_now", F.array().cast(f"array<{types[node]}>"))
    code = F.when(F.col("_there").isNull(), "unknown_node").when(now != F.col("expected"), "children_changed").when(F.coalesce("_taken", F.lit(False)) | (F.size(F.array_distinct("replacement")) < F.size("replacement")), "duplicate_node")
    checked = checked.withColumn("code", code)
    done = checked.where("code is null").select(doc, F.col(node).alias("_at"), "expected", "replacement")
    # a child that isn't kept is cut with all below it
    cut = done.select(doc, F.explode(F.array_except("expected", "replacement")).alias(node)).withColumn("_goes", F.lit(True))
    rows = covering(labelled.join(cut, [doc, node], "left"), doc, F.coalesce("_goes", F.lit(False)), F.col(node).alias("root")).where("_cut is null").select(doc, node, parent, ordinal)
    places = done.select(doc, F.col("_at"), F.posexplode("replacement").alias("_place", node), "expected")
    moved = rows.join(places.select(doc, node, "_place", F.col("_at").alias(parent)), [doc, node, parent], "left").select(doc, node, parent, F.coalesce(F.col("_place").cast(types[ordinal]), F.col(ordinal)).alias(ordinal))
    new = places.where(~F.array_contains("expected", F.col(node))).select(doc, node, F.col("_at").alias(parent), F.col("_place").cast(types[ordinal]).alias(ordinal))
    # a node under a removed one isn't there to have children
    new = new.join(rows.select(doc, F.col(node).alias(parent)), [doc, parent], "left_semi").select(doc, node, parent, ordinal)
    return moved.unionByName(new), checked.select(doc, node, "code")
