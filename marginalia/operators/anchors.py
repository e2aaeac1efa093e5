"""Anchors under edits: maps of positions as values, composed by an associative operation.

A position is (node, offset, affinity). Written as one number, twice the offset and
one more for forward, positions of a node are in order, and every edit is a map that is
piecewise a shift: pieces (node, lo, hi, to, shift), where `to` is null for what the edit
deletes. A map lists the whole of each node that it names, from 0 to LAST, and leaves
other nodes as they are. `compose` of two maps is again such a map, so maps of a
document's revisions can be composed in any grouping: `spans` makes those of all
aligned runs of 1, 2, 4, ... revisions, level by level, and `resolve` takes an anchor
from any revision to any later one by as many maps as the distance has binary
digits, twice at most, without replaying what lies between.

A level pairs neighbours by (document, place) and is written to the shared folder: a
group has two maps, and a map's size is that of the edits in its span. Documents of at most DOCUMENT
edits and anchors need no tables of levels: `chained` deals each once, and a task makes the same
maps and takes the same steps.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import keep
from .replay import fold

PIECE = "struct<node:string,lo:long,hi:long,to:string,shift:long>"
LAST = 2**62
#: Edits and anchors of a document that one task holds, at most.
DOCUMENT = 50_000


def position(offset: Column, affinity: Column) -> Column:
    return offset * 2 + (affinity == "forward").cast("long")


def _pieces(node: Column, *parts: tuple[Column, Column, Column, Column]) -> Column:
    """(lo, hi, to, shift) of a node, without those that are empty."""
    made = F.array(*[F.struct(node.alias("node"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), to.alias("to"), shift.cast("long").alias("shift")) for lo, hi, to, shift in parts])
    return F.filter(made, lambda p: p["lo"] <= p["hi"])



def END() -> Column:  # noqa: N802
    return F.lit(LAST)


def GONE() -> Column:  # noqa: N802
    return F.lit(None).cast("string")



def text_edit(node: Column, start: Column, removed: Column, inserted: Column) -> Column:
    """[start, start + removed) replaced by so many units. What lies inside is deleted; an anchor at an end of it that leans
    into it goes to the end of what was put there, and is deleted where that is nothing."""
    s, e, m = start * 2, (start + removed) * 2, inserted * 2
    empty = inserted == 0
    into = F.when(empty, GONE()).otherwise(node)
    insertion = _pieces(node, (F.lit(0), s, node, F.lit(0)), (s + 1, END(), node, m))
    edit = _pieces(
        node, (F.lit(0), s, node, F.lit(0)), (s + 1, s + 1, into, m - 1), (s + 2, e - 1, GONE(), F.lit(0)), (e, e, into, s + 1 - e), (e + 1, END(), node, m + s - e)
    )
    return F.when(removed == 0, insertion).otherwise(edit)


def split(node: Column, new: Column, at: Column) -> Column:
    """A block is cut: what comes after, and a forward anchor at the cut, goes to the new block."""
    return _pieces(node, (F.lit(0), at * 2, node, F.lit(0)), (at * 2 + 1, END(), new, at * -2))


def merge(first: Column, second: Column, length: Column) -> Column:
    """A block is put after another one of that length."""
    return _pieces(second, (F.lit(0), END(), first, length * 2))


def delete(node: Column) -> Column:
    return _pieces(node, (F.lit(0), END(), GONE(), F.lit(0)))


def across(first: Column, start: Column, end: Column, last: Column, last_end: Column, removed: Column, inserted: Column) -> Column:
    """From start of the first block to last_end of the last one replaced by so many units; the first block, which was `end` long, takes what is left. Blocks between (removed, an array) go."""
    s, e, f, m = start * 2, end * 2, last_end * 2, inserted * 2
    head = _pieces(first, (F.lit(0), s, first, F.lit(0)), (s + 1, s + 1, first, m), (s + 2, e - 1, GONE(), F.lit(0)), (F.greatest(e, s + 2), END(), first, s + m - e))
    tail = _pieces(last, (F.lit(0), f - 1, GONE(), F.lit(0)), (f, END(), first, s + m - f))
    middle = F.flatten(F.transform(removed, delete))
    return F.concat(head, tail, middle)


Map = dict[str, list[tuple[int, int, str | None, int]]]


def by_node(pieces: Iterator[dict]) -> Map:
    out: Map = {}
    for p in pieces:
        out.setdefault(p["node"], []).append((p["lo"], p["hi"], p["to"], p["shift"]))
    for x in out.values():
        x.sort()
    return out


def compose(first: Map, then: Map) -> Map:
    """The map that does one and then the other: each piece of the first is cut where its image meets a border of the second."""
    out: Map = {}
    for node, parts in first.items():
        made = out[node] = []
        for lo, hi, to, shift in parts:
            after = then.get(to) if to is not None else None
            if after is None:
                made.append((lo, hi, to, shift))
                continue
            k = max(0, bisect.bisect_right(after, (lo + shift, LAST * 2)) - 1)
            while k < len(after) and after[k][0] <= hi + shift:
                a, b, onward, more = after[k]
                left, right = max(lo, a - shift), hi if b >= LAST else min(hi, b - shift)
                if left <= right:
                    made.append((left, right, onward, shift + more if onward is not None else 0))
                k += 1
    for node, parts in then.items():
        if node not in out:
            out[node] = parts
    return {node: joined(parts) for node, parts in out.items()}


def joined(parts: list[tuple[int, int, str | None, int]]) -> list[tuple[int, int, str | None, int]]:
    """Neighbouring pieces that do the same as one, so that equal maps are equal values."""
    out: list[tuple[int, int, str | None, int]] = []
    for lo, hi, to, shift in parts:
        if out and out[-1][2:] == (to, shift) and out[-1][1] + 1 == lo:
            out[-1] = out[-1][0], hi, to, shift
        else:
            out.append((lo, hi, to, shift))
    return out


def rows_of(m: Map) -> list[dict]:
    return [{"node": node, "lo": lo, "hi": hi, "to": to, "shift": shift} for node in sorted(m) for lo, hi, to, shift in m[node]]


def mapped(rows: DataFrame, keys: list[str], how: Callable[[dict], Map]) -> DataFrame:
    """keys and the map that `how` makes of each row."""
    schema = StructType([*rows.select(*keys).schema.fields, *StructType.fromDDL(f"map array<{PIECE}>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([rows_of(how(row)) for row in batch.to_pylist()], arrow.field("map").type)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), made], schema=arrow)

    return rows.mapInArrow(run, schema)


def revisions(edits: DataFrame, doc: str, revision: str, seq: str, pieces: Column) -> DataFrame:
    """One map (doc, revision, map) a revision from its edits, composed in order; revisions are those of edits, from 1.

    A revision has as many edits as a transaction may have, so they are composed in one row.
    """

    def in_order(row: dict) -> Map:
        total: Map = {}
        for e in sorted(row["edits"], key=lambda e: e["seq"]):
            total = compose(total, by_node(e["map"]))
        return total

    rows = edits.select(doc, revision, F.struct(F.col(seq).alias("seq"), pieces.alias("map")).alias("e"))
    return mapped(rows.groupBy(doc, revision).agg(F.collect_list("e").alias("edits")), [doc, revision], in_order)


def spans(maps: DataFrame, doc: str, revision: str, most: int) -> DataFrame:
    """(doc, level, place, map) for levels 0 to log2(most): the map of the revisions place * 2^level + 1 to (place + 1) * 2^level.

    Spans in which nothing changes have no row, which stands for a map that changes
    nothing. A run that isn't whole yet has the map of what there is.
    """
    # each level is written, since the one above and every look into it would make it again
    level = keep(maps.select(doc, (F.col(revision) - 1).alias("place"), "map"), "span")
    out = level.select(doc, F.lit(0).alias("level"), "place", "map")
    for k in range(1, max(1, (most - 1).bit_length()) + 1):
        half = lambda odd: F.any_value(F.when(F.col("place") % 2 == odd, F.col("map")), F.lit(True)).alias(f"m{odd}")
        pairs = level.groupBy(doc, F.floor(F.col("place") / 2).cast("long").alias("place")).agg(half(0), half(1))
        level = keep(mapped(pairs, [doc, "place"], lambda r: compose(by_node(r["m0"] or []), by_node(r["m1"] or []))), "span")
        out = out.union(level.select(doc, F.lit(k).alias("level"), "place", "map"))
    return out


def resolve(anchors: DataFrame, spanned: DataFrame, doc: str, most: int) -> DataFrame:
    """anchors (doc, node, offset, affinity, at, upto) with where they are at revision `upto`: to_node, to_offset, to_affinity, null once deleted, and deleted_in, the last revision of the span that deleted them.

    An anchor steps up through levels while its revision is odd in them, and down again
    to its goal; each step is a join by document, level and place with one row at most, in
    which the piece is looked up.
    """
    levels = max(1, (most - 1).bit_length())
    kept = anchors.columns
    rows = anchors.withColumns({"to_node": F.col("node"), "_p": position(F.col("offset"), F.col("affinity")), "_r": F.col("at").cast("long"), "deleted_in": F.lit(None).cast("long")})
    for k, up in [*((k, True) for k in range(levels)), *((k, False) for k in range(levels, -1, -1))]:
        size = 1 << k
        goes = F.col("to_node").isNotNull() & (F.col("_r") + size <= F.col("upto")) & (F.col("_r") % size == 0)
        if up:
            goes = goes & (F.floor(F.col("_r") / size) % 2 == 1)
        step = spanned.where(F.col("level") == k).select(F.col(doc), F.col("place").alias("_place"), F.col("map").alias("_m"))
        rows = rows.withColumn("_place", F.when(goes, F.floor(F.col("_r") / size).cast("long"))).join(step, [doc, "_place"], "left")
        hit = F.get(F.filter("_m", lambda p: (p["node"] == F.col("to_node")) & F.col("_p").between(p["lo"], p["hi"])), F.lit(0))
        rows = rows.withColumns({"_h": hit, "_go": F.col("_place").isNotNull()})
        gone = F.col("_h").isNotNull() & F.col("_h.to").isNull()
        rows = rows.select(
            *kept,
            F.when(F.col("_h").isNull(), F.col("to_node")).otherwise(F.col("_h.to")).alias("to_node"),
            (F.col("_p") + F.coalesce("_h.shift", F.lit(0))).alias("_p"),
            (F.col("_r") + F.when(F.col("_go"), size).otherwise(0)).alias("_r"),
            F.when(gone, F.col("_r") + size).otherwise(F.col("deleted_in")).alias("deleted_in"),
        )
    there = F.col("to_node").isNotNull()
    return rows.select(*kept, "to_node", F.when(there, F.floor(F.col("_p") / 2).cast("long")).alias("to_offset"), F.when(there, F.when(F.col("_p") % 2 == 1, "forward").otherwise("backward")).alias("to_affinity"), F.when(~there, F.least("deleted_in", "upto")).alias("deleted_in"))


def stacked(maps: dict[int, Map], levels: int) -> list[dict[int, Map]]:
    """`spans` for one document's maps by place: those of each level."""
    out = [maps]
    for _ in range(levels):
        below = out[-1]
        out.append({place: compose(below.get(2 * place, {}), below.get(2 * place + 1, {})) for place in {p // 2 for p in below}})
    return out


def walked(spanned: list[dict[int, Map]], node: str | None, p: int | None, at: int | None, upto: int | None) -> tuple[str | None, int | None, int | None]:
    """`resolve` for one anchor: node, position, and the last revision of the span that deleted it."""
    if at is None or upto is None:
        return node, p, None
    top = len(spanned) - 1
    for k, up in [*((k, True) for k in range(top)), *((k, False) for k in range(top, -1, -1))]:
        size = 1 << k
        if at + size > upto or at % size or (up and not at >> k & 1):
            continue
        parts = spanned[k].get(at >> k, {}).get(node) if p is not None else None
        at += size
        if parts:
            i = bisect.bisect_right(parts, p, key=lambda x: x[0]) - 1
            if i >= 0 and p <= parts[i][1]:
                node, p = parts[i][2], p + parts[i][3]
                if node is None:
                    return None, p, at
    return node, p, None


def chained(anchors: DataFrame, edits: DataFrame, doc: str, revision: str, seq: str, pieces: str, most: int) -> DataFrame:
    """What `resolve` gives for anchors over the `spans` of the `revisions` of edits; `most` is the last revision of any document."""
    levels = max(1, (most - 1).bit_length())
    kept = anchors.columns
    empty = lambda df, name: F.lit(None).cast(df.schema[name].dataType)
    first = edits.select(doc, F.lit(0).alias("_phase"), F.col(revision).cast("long").alias("_r"), F.col(seq).cast("long").alias("_seq"), F.col(pieces).alias("_map"))
    then = anchors.select(doc, F.lit(1).alias("_phase"), F.lit(None).cast("long").alias("_r"), F.lit(None).cast("long").alias("_seq"), empty(edits, pieces).alias("_map"), F.struct(*kept).alias("_a"))
    rows = first.unionByName(then, allowMissingColumns=True)
    large = keep(rows.groupBy(doc).count().where(F.col("count") > DOCUMENT).select(doc), "large")
    some = not large.isEmpty()

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        maps: dict[int, Map] = {}
        spanned = None
        for row in rows:
            if row["_phase"] == 0:
                if row["_r"] is not None:
                    place, own = row["_r"] - 1, by_node(row["_map"] or [])
                    maps[place] = compose(maps[place], own) if place in maps else joined_all(own)
                continue
            if spanned is None:
                spanned = stacked(maps, levels)
            a = row["_a"]
            p = None if a["offset"] is None or a["affinity"] is None else a["offset"] * 2 + (a["affinity"] == "forward")
            node, p, gone = walked(spanned, a["node"], p, a["at"], a["upto"])
            there = node is not None
            affinity = "forward" if p is not None and p % 2 else "backward"
            yield a | {"to_node": node, "to_offset": p // 2 if there and p is not None else None, "to_affinity": affinity if there else None, "deleted_in": min(gone, a["upto"]) if gone is not None else a["upto"] if not there else None}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema) + ", to_node string, to_offset long, to_affinity string, deleted_in long"
    found = fold(rows.join(large, doc, "left_anti") if some else rows, doc, ["_phase", "_r", "_seq"], step, schema)
    if not some:
        return found
    maps = revisions(edits.join(large, doc, "left_semi"), doc, revision, seq, F.col(pieces))
    return found.unionByName(resolve(anchors.join(large, doc, "left_semi").select(*kept), spans(maps, doc, revision, most), doc, most))


def joined_all(m: Map) -> Map:
    return {node: joined(parts) for node, parts in m.items()}
