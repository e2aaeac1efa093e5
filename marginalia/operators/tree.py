"""Document trees as tables of nodes: closure, paths, preorder, diffs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes nest this deep at most; a tree that goes on is refused.
DEPTH = 32


def paths(nodes: DataFrame, doc: str, node: str, parent: str, ordinal: str, deepest: int = DEPTH) -> DataFrame:
    """Each reachable node's depth, path of ordinals from the root (sortable: preorder) and root.

    Level by level from the roots; each level is one join by (document, parent)
    with the level before, which is persisted, and the loop ends with the first
    empty level. Nodes of a cycle, and below one, aren't reached from any root and
    don't appear (`graph.audit_tree` names them). Nodes below `deepest` levels are an error.
    """
    base = nodes.select(doc, node, parent, ordinal)
    level = base.where(F.col(parent).isNull()).select(doc, node, F.lit(0).alias("depth"), F.array(ordinal).alias("path"), F.col(node).alias("root"))
    out = level
    for depth in range(deepest + 1):
        up = level.select(doc, F.col(node).alias(parent), F.col("depth").alias("_d"), F.col("path").alias("_p"), "root")
        level = base.where(F.col(parent).isNotNull()).join(up, [doc, parent]).select(doc, node, (F.col("_d") + 1).alias("depth"), F.concat("_p", F.array(ordinal)).alias("path"), "root")
        level = level.persist(StorageLevel.MEMORY_AND_DISK)
        if level.isEmpty():
            break
        if depth == deepest:
            raise ValueError(f"nodes nest deeper than {deepest} levels")
        out = out.union(level)
    return out


def positional_diff(before: DataFrame, after: DataFrame, keys: list[str], identity: str, style: list[str], body: list[str]) -> DataFrame:
    """Siblings compared by place: structure where one side is missing or identities differ, else style, body, both or same."""
    pack = lambda cols: F.struct(*cols)
    a = before.select(*keys, F.col(identity).alias("_ai"), pack(style).alias("_as"), pack(body).alias("_ab"))
    b = after.select(*keys, F.col(identity).alias("_bi"), pack(style).alias("_bs"), pack(body).alias("_bb"))
    s, t = F.col("_as").eqNullSafe(F.col("_bs")), F.col("_ab").eqNullSafe(F.col("_bb"))
    change = F.when(~F.col("_ai").eqNullSafe(F.col("_bi")), "structure").when(~s & ~t, "style_body").when(~s, "style").when(~t, "body").otherwise("same")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def keyed_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys compared by content: added, removed, changed or same."""
    a, b = before.select(key, F.struct(*columns).alias("_a")), after.select(key, F.struct(*columns).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def owners(references: DataFrame, changed: DataFrame, key: str, owner: str) -> DataFrame:
    """Nodes that refer to any changed key."""
    return references.join(changed.select(key), key, "left_semi").select(owner).distinct()
