"""Command families over tables of blocks (document, ordinal, node, kind, text): each gives the table after the command.

Commands come as a table too (document and arguments), so one call applies a
command to any number of documents: a join by document, then expressions. A
document without a command is unchanged. Order is by ordinal; what a command
inserts gets an ordinal between its neighbours, and `renumber` makes them dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import replace_units as replace_text_units

# Largest tables.
ROWS, COLUMNS, CELLS = 50, 20, 1000


def renumber(blocks: DataFrame, doc: str = "doc_id", order: str = "ordinal") -> DataFrame:
    w = Window.partitionBy(doc).orderBy(order)
    return blocks.withColumn(order, (F.row_number().over(w) - 1).cast("long"))


def splice(text: Column, start: Column, stop: Column, new: Column) -> Column:
    """text with [start, stop) in code points replaced; null where the range isn't one of the text."""
    ok = (start >= 0) & (start <= stop) & (stop <= F.length(text))
    return F.when(ok, F.concat(F.substring(text, F.lit(1), start), new, F.substring(text, stop + 1, F.length(text))))


def _with(blocks: DataFrame, commands: DataFrame) -> DataFrame:
    return blocks.join(commands, "doc_id", "left")


def replace_text(blocks: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: doc_id, at (ordinal), start, stop, new. Inserting has start = stop; deleting an empty new. A range outside changes nothing."""
    hit = F.col("at") == F.col("ordinal")
    text = F.when(hit, F.coalesce(splice(F.col("text"), F.col("start"), F.col("stop"), F.col("new")), F.col("text"))).otherwise(F.col("text"))
    return _with(blocks, commands).withColumn("text", text).select(blocks.columns)


def replace_units(blocks: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commands: doc_id, at (ordinal), start, stop (UTF-16 units), expected (null: anything), new; one for a document.

    The blocks after all commands that can be done, and each command's doc_id and
    code: null for done, invalid_target where the document has no such block, or
    what `text.replace_units` says.
    """
    rows = _with(blocks, commands)
    text, code = replace_text_units(F.col("text"), F.col("start"), F.col("stop"), F.col("new"), F.col("expected"))
    after = rows.withColumn("text", F.when(F.col("at") == F.col("ordinal"), text).otherwise(F.col("text"))).select(blocks.columns)
    hit = blocks.select("doc_id", F.col("ordinal").alias("at"), "text", F.lit(True).alias("_there"))
    codes = commands.join(hit, ["doc_id", "at"], "left").select("doc_id", F.when(F.col("_there").isNull(), "invalid_target").otherwise(code).alias("code"))
    return after, codes


def replace_across(blocks: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: doc_id, first, start, last, stop, new. The first block keeps its identity and takes what is left of the last; those between go."""
    rows = _with(blocks, commands)
    tail = rows.where(F.col("ordinal") == F.col("last")).select("doc_id", F.substring("text", F.col("stop") + 1, F.length("text")).alias("_tail"))
    rows = rows.join(tail, "doc_id", "left").where(F.col("first").isNull() | (F.col("ordinal") <= F.col("first")) | (F.col("ordinal") > F.col("last")))
    text = F.when(F.col("ordinal") == F.col("first"), F.concat(F.substring("text", F.lit(1), F.col("start")), "new", "_tail")).otherwise(F.col("text"))
    return renumber(rows.withColumn("text", text).select(blocks.columns))


def set_column(blocks: DataFrame, commands: DataFrame, column: str) -> DataFrame:
    """commands: doc_id, at, expected, value: compare and set of one column, null-safe."""
    hit = (F.col("at") == F.col("ordinal")) & F.col(column).eqNullSafe(F.col("expected"))
    return _with(blocks, commands).withColumn(column, F.when(hit, F.col("value")).otherwise(F.col(column))).select(blocks.columns)


def insert(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """rows like blocks: each goes before the block that now has its ordinal (past the end: last)."""
    moved = blocks.withColumn("ordinal", F.col("ordinal") * 2 + 1)
    return renumber(moved.unionByName(rows.withColumn("ordinal", F.col("ordinal") * 2)))


def delete(blocks: DataFrame, commands: DataFrame, protected: Column | None = None) -> DataFrame:
    """commands: doc_id, at. The last block of a document stays, and so do protected ones."""
    rows = _with(blocks, commands).withColumn("_n", F.count("*").over(Window.partitionBy("doc_id")))
    goes = (F.col("at") == F.col("ordinal")) & (F.col("_n") > 1)
    goes = goes & ~protected if protected is not None else goes
    return renumber(rows.where(~F.coalesce(goes, F.lit(False))).select(blocks.columns))


def split_block(blocks: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: doc_id, at, offset. One row becomes two; a heading that is split at its end goes on as a paragraph."""
    rows = _with(blocks, commands)
    hit = F.coalesce((F.col("at") == F.col("ordinal")) & F.col("offset").between(0, F.length("text")), F.lit(False))
    others = [c for c in blocks.columns if c not in ("ordinal", "text", "kind")]
    kind = F.when((F.col("kind") == "heading") & (F.col("offset") == F.length("text")), "paragraph").otherwise(F.col("kind"))
    pair = F.array(
        F.struct((F.col("ordinal") * 2).alias("ordinal"), F.when(hit, F.substring("text", F.lit(1), F.col("offset"))).otherwise(F.col("text")).alias("text"), F.col("kind").alias("kind")),
        F.struct((F.col("ordinal") * 2 + 1).alias("ordinal"), F.substring("text", F.col("offset") + 1, F.length("text")).alias("text"), kind.alias("kind")),
    )
    out = rows.withColumn("_x", F.explode(F.when(hit, pair).otherwise(F.slice(pair, 1, 1)))).select(*others, "_x.*")
    return renumber(out.select(blocks.columns))


def merge_block(blocks: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: doc_id, at. A block takes the text of the next one of its kind, which goes."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    rows = _with(blocks, commands).withColumn("_t", F.lead("text").over(w)).withColumn("_same", F.lead("kind").over(w) == F.col("kind"))
    hit = F.coalesce((F.col("at") == F.col("ordinal")) & F.col("_same"), F.lit(False))
    rows = rows.withColumn("_gone", F.coalesce(F.lag(hit).over(w), F.lit(False))).withColumn("text", F.when(hit, F.concat("text", "_t")).otherwise(F.col("text")))
    return renumber(rows.where(~F.col("_gone")).select(blocks.columns))


def move(blocks: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: doc_id, at, target: a block goes to an ordinal; the others close up and make way."""
    rows = _with(blocks, commands)
    o, a, t = F.col("ordinal"), F.col("at"), F.col("target")
    new = F.when(a.isNull() | t.isNull(), o).when(o == a, t).when((a < o) & (o <= t), o - 1).when((t <= o) & (o < a), o + 1).otherwise(o)
    return renumber(rows.withColumn("ordinal", new).select(blocks.columns))


def grid(tables: DataFrame) -> DataFrame:
    """tables: table_id, rows, columns: a cell for each place; sizes over the limits give none."""
    ok = F.col("rows").between(1, ROWS) & F.col("columns").between(1, COLUMNS) & (F.col("rows") * F.col("columns") <= CELLS)
    one = tables.where(ok).select("table_id", "columns", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)).alias("row"))
    return one.select("table_id", "row", F.explode(F.sequence(F.lit(0), F.col("columns").cast("int") - 1)).alias("column"))


# --- styled runs: array<struct<text, mark>> ---------------------------------

RUNS = "array<struct<text:string,mark:string>>"


def coalesce_runs(runs: Column) -> Column:
    """Empty runs dropped, neighbours of equal marks joined."""

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.concat(last["text"], r["text"]).alias("text"), last["mark"].alias("mark"))))
        return F.when(F.length(r["text"]) == 0, done).when((F.size(done) > 0) & last["mark"].eqNullSafe(r["mark"]), joined).otherwise(F.concat(done, F.array(F.struct(r["text"].alias("text"), r["mark"].alias("mark")))))

    return F.aggregate(runs, F.array().cast(RUNS), step)


def mark_runs(runs: Column, start: Column, stop: Column, mark: Column) -> Column:
    """The mark set on [start, stop) in code points: runs are cut at both ends, and joined again where they can be."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast(RUNS).alias("out"))

    def step(a: Column, r: Column) -> Column:
        n = F.length(r["text"])
        s = F.least(n, F.greatest(F.lit(0), start - a["at"]))
        e = F.greatest(s, F.least(n, stop - a["at"]))
        cut = lambda i, j, m: F.struct(F.substring(r["text"], i + 1, j - i).alias("text"), m.alias("mark"))
        return F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(cut(F.lit(0), s, r["mark"]), cut(s, e, mark), cut(e, n, r["mark"]))).alias("out"))

    return coalesce_runs(F.aggregate(runs, state, step)["out"])


# --- positions under edits ---------------------------------------------------


def map_offset(offset: Column, affinity: Column, start: Column, removed: Column, inserted: Column) -> Column:
    """Where an offset is after an edit: null inside what was removed. At an insertion, forward goes after it and backward stays."""
    end = start + removed
    at_insertion = F.when(affinity == "forward", offset + inserted).otherwise(offset)
    return F.when(offset < start, offset).when((removed == 0) & (offset == start), at_insertion).when(offset == start, offset).when(offset >= end, offset - removed + inserted)


# --- tables: cells (table_id, row, column, text) ------------------------------

AXES = ("row", "column")


def insert_line(cells: DataFrame, commands: DataFrame, axis: str) -> DataFrame:
    """commands: table_id, after. An empty row (or column) after that one; a table at its limit is unchanged."""
    other = AXES[1 - AXES.index(axis)]
    size = cells.groupBy("table_id").agg((F.max("row") + 1).alias("_r"), (F.max("column") + 1).alias("_c"))
    more = (F.col("_r") + int(axis == "row"), F.col("_c") + int(axis == "column"))
    fits = (more[0] <= ROWS) & (more[1] <= COLUMNS) & (more[0] * more[1] <= CELLS)
    wanted = commands.join(size, "table_id").where(fits & F.col("after").between(0, F.col("_r" if axis == "row" else "_c") - 1)).select("table_id", "after")
    rows = cells.join(wanted, "table_id", "left")
    moved = rows.withColumn(axis, F.when(F.col(axis) > F.col("after"), F.col(axis) + 1).otherwise(F.col(axis))).select(cells.columns)
    new = rows.where(F.col(axis) == F.col("after")).select("table_id", (F.col(axis) + 1).alias(axis), other, F.lit("").alias("text"))
    return moved.unionByName(new)


def remove_line(cells: DataFrame, commands: DataFrame, axis: str) -> DataFrame:
    """commands: table_id, at. A row (or column) goes and the others close up; the last one stays."""
    size = cells.groupBy("table_id").agg((F.max(axis) + 1).alias("_n"))
    rows = cells.join(commands.join(size.where("_n > 1"), "table_id").select("table_id", "at"), "table_id", "left")
    left = rows.where(F.col("at").isNull() | (F.col(axis) != F.col("at")))
    return left.withColumn(axis, F.when(F.col(axis) > F.col("at"), F.col(axis) - 1).otherwise(F.col(axis))).select(cells.columns)


# --- lists: blocks with depth (0: not in a list) --------------------------------

DEEPEST = 8


def indent(items: DataFrame, commands: DataFrame, by: int) -> DataFrame:
    """commands: doc_id, at. An item goes under the item before it (by = 1: one deeper than that at most, and DEEPEST), or after its parent (by = -1: out of the list at 0). Its descendants go along."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    rows = items.join(commands, "doc_id", "left").withColumn("_before", F.lag("depth").over(w))
    start = F.max(F.when(F.col("ordinal") == F.col("at"), F.struct("depth", "_before"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("_s", start)
    # descendants: the items after it until one that is no deeper
    ends = F.min(F.when((F.col("ordinal") > F.col("at")) & (F.col("depth") <= F.col("_s.depth")), F.col("ordinal"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("_end", ends)
    inside = (F.col("ordinal") >= F.col("at")) & (F.col("_end").isNull() | (F.col("ordinal") < F.col("_end")))
    top = F.max(F.when(inside, F.col("depth"))).over(Window.partitionBy("doc_id"))
    ok = (F.col("_s.depth") > 0) & ((F.lit(by) < 0) | ((F.col("_s._before") >= F.col("_s.depth")) & (top + by <= DEEPEST)))
    return rows.withColumn("_ok", ok).withColumn("depth", F.when(inside & F.col("_ok"), F.col("depth") + by).otherwise(F.col("depth"))).select(items.columns)
