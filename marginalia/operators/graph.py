"""References between nodes: chains of parents audited by pointer doubling, general references by peeling.

Each round is one join of the whole table with itself by (document, node), written to
the shared folder. Doubling takes a number of rounds that grows with the logarithm of
the longest chain; peeling takes one a layer. Documents of at most DOCUMENT rows, nodes and
references together, need no rounds: they are dealt by document once and many are peeled at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.shared import keep
from .tree import DEPTH


def audit_tree(nodes: DataFrame, doc: str, node: str, parent: str, deepest: int = DEPTH) -> DataFrame:
    """Every node with depth, top and code, whatever its parents are.

    Ids tell nodes of a document apart. Code: null; too_deep, below `deepest` levels (with its true
    depth); dangling, whose parent isn't there; unreachable, below such a one; cycle, on
    a cycle of parents; under_cycle, below one. top is where the chain of parents ends: a root, or the dangling
    node; null for the last two, as is depth. Below a dangling node depth counts from it.
    """
    there = nodes.select(doc, F.col(node).alias(parent), F.lit(True).alias("_there")).distinct()
    rows = nodes.select(doc, node, parent).join(there, [doc, parent], "left")
    end = F.when(F.col(parent).isNull(), "root").when(F.col("_there").isNull(), "dangling")
    rows = rows.select(doc, node, F.when(end.isNull(), F.col(parent)).alias("at"), F.when(end.isNull(), 1).otherwise(0).cast("long").alias("hops"), end.alias("end"), F.when(end.isNotNull(), F.col(node)).alias("top"))
    rows = keep(rows, "pointers")
    # a chain longer than its document has a cycle in it
    most = nodes.groupBy(doc).count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= most and not rows.where("end is null").isEmpty():
        to = rows.select(doc, F.col(node).alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("end").alias("_end"), F.col("top").alias("_top"))
        on = rows.where("end is null").join(to, [doc, "at"]).select(doc, node, F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_end").alias("end"), F.col("_top").alias("top"))
        rows = keep(rows.where("end is not null").unionByName(on), "pointers")
        reach *= 2
    # a pointer that has gone so far is on the cycle, and all nodes of a cycle are pointed at
    cycle = rows.where("end is null").select(doc, F.col("at").alias(node), F.lit(True).alias("_on")).distinct()
    code = F.when(F.col("end").isNull() & F.col("_on").isNotNull(), "cycle").when(F.col("end").isNull(), "under_cycle")
    code = code.when(F.col("end") == "dangling", F.when(F.col("hops") == 0, "dangling").otherwise("unreachable")).when(F.col("hops") > deepest, "too_deep")
    return rows.join(cycle, [doc, node], "left").select(doc, node, F.when(F.col("end").isNotNull(), F.col("hops")).alias("depth"), "top", code.alias("code"))


#: Nodes and references of a document that is peeled in one task, and rows that such a task takes at once.
DOCUMENT, ROWS = 100_000, 100_000


def peel(edges: DataFrame, doc: str, source: str, target: str, layers: int = DEPTH) -> tuple[DataFrame, DataFrame | None]:
    """Edges that are left when those from a node that nothing refers to, and those to a node that refers to
    nothing, are taken away again and again; and the documents where that didn't come to an end within `layers` layers, if any.

    Where it did, what is left are cycles and paths from one to another.
    """
    kept, count, steps = [keep(edges.select(doc, source, target).distinct(), "edges")], -1, 0
    while steps <= layers:
        left = kept[-1]
        now = left.count()
        if now == count or now == 0:
            return left, None
        count = now
        for _ in range(4):
            into = left.select(doc, F.col(target).alias(source)).distinct()
            out = left.select(doc, F.col(source).alias(target)).distinct()
            left = left.join(into, [doc, source], "left_semi").join(out, [doc, target], "left_semi")
        kept, steps = [*kept[-2:], keep(left, "edges")], steps + 4
    going = kept[-2].groupBy(doc).count()
    if len(kept) > 2:
        before = kept[-3].groupBy(doc).agg(F.count("*").alias("_before"))
        going = going.join(before, doc).where("count <> _before")
    return kept[-1], going.select(doc)


def peeled(doc: np.ndarray, source: np.ndarray, target: np.ndarray, layers: int) -> tuple[np.ndarray, np.ndarray]:
    """`peel` for edges at hand, each of a document by number, between nodes by number: the places of those left, and the documents that didn't end."""
    at = np.arange(len(doc))
    checks = [np.zeros(0, np.int64)]
    most = int(max(source.max(initial=-1), target.max(initial=-1))) + 1
    docs = int(doc.max(initial=-1)) + 1
    for _ in range(layers // 4 + 1):
        checks = [checks[-1], np.bincount(doc[at], minlength=docs)]
        for _ in range(4):
            into, out = np.bincount(target[at], minlength=most), np.bincount(source[at], minlength=most)
            at = at[(into[source[at]] > 0) & (out[target[at]] > 0)]
        if not len(at):
            break
    before, now = checks
    going = now > 0 if not len(before) else now != before
    return at, np.flatnonzero(going & (now > 0))


def audited(rows: pa.Table, layers: int) -> tuple[pa.Array, pa.Array, list[str | None]]:
    """Documents, nodes and codes of whole documents' rows (document, source, target, whether it is a node)."""
    docs = rows.column(0).combine_chunks().dictionary_encode("encode")
    both = pa.concat_arrays([rows.column(1).combine_chunks(), rows.column(2).combine_chunks()])
    names = both.dictionary_encode("encode")
    d, n = docs.indices.to_numpy(), names.indices.to_numpy().astype(np.int64)
    key = np.r_[d, d].astype(np.int64) * len(names.dictionary) + n
    own = rows.column(3).to_numpy()
    source, target = key[: len(d)], key[len(d) :]
    nodes = np.unique(source[own])
    edges = ~own & np.isin(source, nodes)
    there = np.isin(target, nodes) & rows.column(2).is_valid().to_numpy()
    code = np.full(len(nodes), None, object)
    code[np.searchsorted(nodes, source[edges & ~there])] = "dangling"
    a, b, e = (x[edges & there] for x in (source, target, d))
    a, b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    _, once = np.unique(a * max(1, len(nodes)) + b, return_index=True)
    a, b, e = a[once], b[once], e[once]
    left, going = peeled(e, a, b, layers)
    deep = np.isin(e[left], going)
    for of, value in ((left[~deep], "cycle"), (left[deep], "too_deep")):
        code[a[of]] = value
        code[b[of]] = value
    at = pa.array(nodes // max(1, len(names.dictionary))), pa.array(nodes % max(1, len(names.dictionary)))
    return docs.dictionary.take(at[0]), names.dictionary.take(at[1]), code.tolist()


def audit_small(rows: DataFrame, doc: str, node: str, layers: int) -> DataFrame:
    """`audit_references` of documents that a task can hold; rows: document, source, target, whether it is a node."""
    schema = StructType([StructField(doc, rows.schema[0].dataType), StructField(node, rows.schema[1].dataType), StructField("code", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coded(table: pa.Table) -> pa.RecordBatch:
            of, name, code = audited(table, layers)
            return pa.RecordBatch.from_arrays([of.cast(arrow.field(0).type), name.cast(arrow.field(1).type), pa.array(code, pa.string())], schema=arrow)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                table = pa.Table.from_batches(held)
                # the last document may go on
                ids = table.column(0).combine_chunks().dictionary_encode("encode").indices.to_numpy()
                whole = int(np.argmax(ids == ids[-1]))
                if whole:
                    yield coded(table.slice(0, whole))
                rest = table.slice(whole).combine_chunks()
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield coded(pa.Table.from_batches(held))

    return rows.repartition(doc).sortWithinPartitions(doc).mapInArrow(run, schema)


def audit_references(nodes: DataFrame, edges: DataFrame, doc: str, node: str, source: str, target: str, layers: int = DEPTH) -> DataFrame:
    """Every node (doc, node) with the first code that holds: cycle, dangling (it refers to a node that isn't there), or null.

    A node on a path from one cycle to another counts as cycle. Where a document's references go on for more than `layers`
    layers, those that are left after so many have the code too_deep, and whether they end isn't asked.
    Nodes repeated count once; edges whose source isn't a node have no part. Ids of nodes, sources and targets have one type.
    """
    edges = edges.select(doc, source, target).where(F.col(doc).isNotNull() & F.col(source).isNotNull())
    rows = nodes.select(doc, F.col(node).alias(source), F.lit(None).cast(nodes.schema[node].dataType).alias(target), F.lit(True).alias("_own")).union(edges.withColumn("_own", F.lit(False)))
    # documents too large for a task go by joins; without a document there are no references
    large = keep(rows.where(F.col(doc).isNotNull()).groupBy(doc).count().where(F.col("count") > DOCUMENT).select(doc), "large")
    if large.isEmpty():
        return audit_small(rows, doc, node, layers)
    found = audit_large(nodes.join(large, doc, "left_semi"), edges.join(large, doc, "left_semi"), doc, node, source, target, layers)
    return audit_small(rows.join(large, doc, "left_anti"), doc, node, layers).union(found)


def audit_large(nodes: DataFrame, edges: DataFrame, doc: str, node: str, source: str, target: str, layers: int) -> DataFrame:
    """`audit_references` by rounds of joins, for documents of any size."""
    nodes = nodes.select(doc, node).distinct()
    known = lambda end: nodes.select(doc, F.col(node).alias(end))
    edges = edges.join(known(source), [doc, source], "left_semi")
    missing = edges.join(known(target), [doc, target], "left_anti").select(doc, F.col(source).alias(node), F.lit(True).alias("_missing")).distinct()
    left, going = peel(edges.join(known(target), [doc, target], "left_semi"), doc, source, target, layers)
    left = left.withColumn("_left", F.lit("cycle")) if going is None else left.join(going.withColumn("_deep", F.lit("too_deep")), doc, "left").withColumn("_left", F.coalesce("_deep", F.lit("cycle")))
    ends = left.select(doc, F.col(source).alias(node), "_left").union(left.select(doc, F.col(target).alias(node), "_left")).distinct()
    code = F.coalesce("_left", F.when(F.col("_missing").isNotNull(), "dangling"))
    return nodes.join(ends, [doc, node], "left").join(missing, [doc, node], "left").select(doc, node, code.alias("code"))
