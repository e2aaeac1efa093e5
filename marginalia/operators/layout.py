"""Ordered folds over a page or a document: reading order, line filling, pagination.

Widths are a declared model, UNIT for each code point, not a font's. A fold runs
for each key, and keys are dealt over the cluster; a key is one page or document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Nearness of lines, in 1/64 point; width of a code point; lines kept together at a page's ends.
NEAR, UNIT, WIDOW = 64, 7, 2


def many_keys(rows: DataFrame, key: str):
    """Rows grouped so that a call gets many whole keys: a call for each small key would cost more than its fold."""
    spread = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(spread))).groupBy("_group")


def reading_lines(parts: DataFrame, page: str = "page") -> DataFrame:
    """Parts (page, part, x, y, width, height) with their line: top to bottom, then left to right; a part joins the last
    line when it overlaps the union of that line's boxes in height, or is within NEAR of it."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([page, "y", "x", "part"], ascending=[True, False, True, True])
        out, last, line, low, high = [], None, 0, 0, 0
        for p, y, h in zip(rows[page].tolist(), rows["y"].tolist(), rows["height"].tolist()):
            if p != last:
                last, line, low, high = p, 1, y, y + h
            elif min(high, y + h) - max(low, y) > 0 or max(low, y) - min(high, y + h) <= NEAR:
                low, high = min(low, y), max(high, y + h)
            else:
                line, low, high = line + 1, y, y + h
            out.append(line)
        return rows[[page, "part"]].assign(line=out)

    return many_keys(parts.select(page, "part", "x", "y", "width", "height"), page).applyInPandas(fold, f"{page} long, part long, line long")


def reading_blocks(lines: DataFrame, page: str = "page") -> DataFrame:
    """Lines (page, line, x, y, width, height) with their block: top to bottom, a line joins the last block when the gap to
    the union of its boxes is at most twice the larger height and their left edges at most four times it apart."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([page, "y", "x", "line"], ascending=[True, False, True, True])
        out, last, block, left, low, high = [], None, 0, 0, 0, 0
        for p, x, y, h in zip(*(rows[c].tolist() for c in (page, "x", "y", "height"))):
            tall = max(h, high - low)
            if p == last and max(0, low - (y + h)) <= 2 * tall and abs(x - left) <= 4 * tall:
                left, low, high = min(left, x), min(low, y), max(high, y + h)
            else:
                block = 1 if p != last else block + 1
                last, left, low, high = p, x, y, y + h
            out.append(block)
        return rows[[page, "line"]].assign(block=out)

    return many_keys(lines.select(page, "line", "x", "y", "width", "height"), page).applyInPandas(fold, f"{page} long, line long, block long")


def ambiguous_columns(parts: DataFrame, page: str = "page", page_width: int = 640) -> DataFrame:
    """Pages of four parts or more where two overlap in height with over a quarter of the page between them.

    Parts are cut into bands of a fixed height, so only parts of one band meet;
    in a band, the widest gap to the left suffices.
    """
    counted = parts.withColumn("_n", F.count("*").over(Window.partitionBy(page))).where("_n >= 4")
    band = 256
    cut = counted.withColumn("band", F.explode(F.sequence(F.floor(F.col("y") / band), F.floor((F.col("y") + F.col("height") - 1) / band))))
    a = cut.select(page, "band", F.col("y").alias("y1"), F.col("height").alias("h1"), (F.col("x") + F.col("width")).alias("right"))
    b = cut.select(page, "band", F.col("y").alias("y2"), F.col("height").alias("h2"), F.col("x").alias("left"))
    over = (F.col("y1") < F.col("y2") + F.col("h2")) & (F.col("y2") < F.col("y1") + F.col("h1")) & (F.col("left") - F.col("right") > page_width / 4)
    return a.join(b, [page, "band"]).where(over).select(page).distinct()


def fill_lines(words: Column, room: int) -> Column:
    """Greedy lines of a text's words: each as long as fits; a word that fits no line has one of its own."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("open"))

    def step(a: Column, w: Column) -> Column:
        longer = F.when(a["open"] == "", w).otherwise(F.concat(a["open"], F.lit(" "), w))
        fits = (F.length(longer) * UNIT <= room) | (a["open"] == "")
        return F.struct(F.when(fits, a["lines"]).otherwise(F.concat(a["lines"], F.array(a["open"]))).alias("lines"), F.when(fits, longer).otherwise(w).alias("open"))

    return F.aggregate(words, start, step, lambda a: F.when(a["open"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["open"]))))


def paginate(blocks: DataFrame, capacity: int, doc: str = "doc_id") -> DataFrame:
    """Pages of blocks (doc, ordinal, kind, lines): fragments (page, first_line, last_line) of each block.

    A page holds `capacity` lines. A break in a paragraph leaves WIDOW lines on
    either side where it has so many; a heading goes on with at least a line of
    what follows; a page break ends the page. With columns page and skip, a document
    begins at the top of its first block's page, without the first `skip` lines of that block.
    """
    if not {"page", "skip"} <= set(blocks.columns):
        blocks = blocks.withColumn("page", F.lit(1)).withColumn("skip", F.lit(0))

    def one(key: int, items: list[tuple]) -> list[tuple]:
        out, page, used = [], items[0][3], 0
        for i, (o, kind, n, _, skip) in enumerate(items):
            if kind == "pageBreak":
                out.append((key, o, page, 0, 0))
                page, used = page + 1, 0
                continue
            follows = min(items[i + 1][2], WIDOW) if kind == "heading" and i + 1 < len(items) and items[i + 1][1] != "pageBreak" else 0
            if kind == "heading" and used and used + n + follows > capacity:
                page, used = page + 1, 0
            at = skip
            while at < n:
                left = n - at
                take = min(left, capacity - used)
                if take < left:
                    if left - take < WIDOW:
                        take = max(0, left - WIDOW)
                    if take < min(WIDOW, left):
                        take = 0
                    if take == 0 and used == 0:
                        take = min(left, capacity)
                if take:
                    out.append((key, o, page, at, at + take))
                    at, used = at + take, used + take
                if at < n:
                    page, used = page + 1, 0
        return out

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([doc, "ordinal"])
        items: dict[int, list[tuple]] = {}
        for key, *item in zip(*(rows[c].tolist() for c in (doc, "ordinal", "kind", "lines", "page", "skip"))):
            items.setdefault(key, []).append(tuple(item))
        return pd.DataFrame([r for key, x in items.items() for r in one(key, x)], columns=[doc, "ordinal", "page", "first_line", "last_line"])

    schema = f"{doc} long, ordinal long, page long, first_line long, last_line long"
    return many_keys(blocks.select(doc, "ordinal", "kind", "lines", "page", "skip"), doc).applyInPandas(fold, schema)


def _fits_after(items: list[tuple], i: int) -> int:
    """Lines that a chain of headings from i on must keep with it: the headings that follow, and the start of the block after them."""
    more = 0
    for _, kind, n, *_ in items[i + 1 :]:
        if kind == "heading":
            more += n
            continue
        return more + (0 if kind == "pageBreak" else n if kind == "row" else min(n, WIDOW))
    return more


def paginate_tables(blocks: DataFrame, capacity: int, doc: str = "doc_id") -> DataFrame:
    """Pages of blocks (doc, ordinal, kind, lines, table, header) with tables: fragments (page, first_line, last_line, derived, code).

    Rows (kind row) of one table number stand together and are never cut. A row that
    doesn't fit goes to the next page, where the table's header row, if its first row is one, is
    repeated before it (derived). A row taller than a page is placed all the same, at a page's top, and
    its code is overflow. A chain of headings stays with the start of what follows it.
    Paragraphs break as in `paginate`. One document is folded at a time; null lines count as one, and
    rows without a table number are tables of their own.
    """

    def one(key: int, items: list[tuple]) -> list[tuple]:
        out, page, used = [], 1, 0
        table, head = None, None
        for i, (o, kind, n, number, header) in enumerate(items):
            if kind != "row":
                table = head = None
            if kind == "pageBreak":
                out.append((key, o, page, 0, 0, False, None))
                page, used = page + 1, 0
                continue
            if kind == "row":
                first = number is None or number != table
                if first:
                    table, head = number, (o, n) if header and number is not None else None
                if used and used + n > capacity:
                    page, used = page + 1, 0
                    if head and not first:
                        out.append((key, head[0], page, 0, head[1], True, "overflow" if head[1] > capacity else None))
                        used += head[1]
                out.append((key, o, page, 0, n, False, "overflow" if n > capacity else None))
                used += n
                continue
            if kind == "heading" and used and used + n + _fits_after(items, i) > capacity:
                page, used = page + 1, 0
            at = 0
            while at < n:
                left = n - at
                take = max(0, min(left, capacity - used))
                if take < left:
                    if left - take < WIDOW:
                        take = max(0, left - WIDOW)
                    if take < min(WIDOW, left):
                        take = 0
                    if take == 0 and used == 0:
                        take = min(left, capacity)
                if take:
                    out.append((key, o, page, at, at + take, False, None))
                    at, used = at + take, used + take
                if at < n:
                    page, used = page + 1, 0
        return out

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([doc, "ordinal"])
        items: dict[int, list[tuple]] = {}
        for key, o, kind, n, number, header in zip(*(rows[c].tolist() for c in (doc, "ordinal", "kind", "lines", "table", "header"))):
            items.setdefault(key, []).append((o, kind, n, None if pd.isna(number) else int(number), bool(header)))
        return pd.DataFrame([r for key, x in items.items() for r in one(key, x)], columns=[doc, "ordinal", "page", "first_line", "last_line", "derived", "code"])

    rows = blocks.select(doc, "ordinal", "kind", F.coalesce("lines", F.lit(1)).cast("long").alias("lines"), F.col("table").cast("double").alias("table"), F.coalesce("header", F.lit(False)).alias("header"))
    return many_keys(rows, doc).applyInPandas(fold, f"{doc} long, ordinal long, page long, first_line long, last_line long, derived boolean, code string")


def signatures(blocks: DataFrame, columns: list[str], doc: str = "doc_id") -> DataFrame:
    """blocks (doc, ordinal, ...) with the signature of each prefix: two 64-bit hashes of all blocks so far with their place.

    A prefix's signature is the last one's xor the block's own hashes, so it is a running
    aggregate; two prefixes with equal counts and signatures are alike in `columns`.
    """
    w = Window.partitionBy(doc).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    own = [F.xxhash64(F.lit(salt), F.row_number().over(Window.partitionBy(doc).orderBy("ordinal")), *columns) for salt in (1, 2)]
    rows = blocks.withColumn("_a", own[0]).withColumn("_b", own[1])
    return rows.withColumn("signature", F.concat_ws(":", F.hex(F.bit_xor("_a").over(w)), F.hex(F.bit_xor("_b").over(w)))).drop("_a", "_b")


def repaginate(before: DataFrame, pages: DataFrame, after: DataFrame, capacity: int, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Pages of the blocks `after`, from those of the blocks `before`, and what was folded anew: fragments, and (doc, blocks, folded).

    Blocks are (doc, ordinal, kind, lines); ordinals tell blocks apart and order them. The longest prefix that both have alike
    is found by its signature. A page's start depends on the blocks before it and on the one that
    a heading looks ahead to, so pages before that of the last block but one of the prefix are kept,
    and only what begins with that page is folded. Documents without a change are kept whole; new ones
    are folded whole; those that are no more have no rows.
    """
    cols = ["ordinal", "kind", "lines"]
    new = signatures(after.select(doc, *cols), cols, doc)
    old = signatures(before.select(doc, *cols), cols, doc).select(doc, "ordinal", "signature", F.lit(True).alias("_same"))
    w = Window.partitionBy(doc).orderBy("ordinal")
    marked = new.join(old, [doc, "ordinal", "signature"], "left").withColumn("_n", F.row_number().over(w))
    sizes = before.groupBy(doc).agg(F.count("*").alias("_was"))
    state = marked.groupBy(doc).agg(F.count("*").alias("blocks"), F.max(F.when(F.col("_same"), F.col("_n"))).alias("_alike")).join(sizes, doc, "left")
    state = state.withColumn("_whole", (F.coalesce("_alike", F.lit(0)) == F.col("blocks")) & F.col("blocks").eqNullSafe(F.col("_was")))
    # the last block but one of the prefix; its last fragment's page is folded again from its start
    anchor = marked.join(state.where("not _whole and _alike > 1"), doc).where("_n = _alike - 1").select(doc, "ordinal")
    page = pages.join(anchor, [doc, "ordinal"]).groupBy(doc).agg(F.max("page").alias("_page"))
    start = pages.join(page, doc).where("page = _page").groupBy(doc).agg(F.first("_page").alias("_page"), F.min(F.struct("ordinal", "first_line")).alias("_start"))
    plan = state.select(doc, "blocks", "_whole").join(start, doc, "left")
    kept = pages.join(plan, doc).where("_whole or page < _page").select(*pages.columns)
    rest = after.select(doc, *cols).join(plan.where("not _whole"), doc).where("_start is null or ordinal >= _start.ordinal")
    skip = F.when(F.col("ordinal") == F.col("_start.ordinal"), F.col("_start.first_line")).otherwise(0)
    folded = paginate(rest.select(doc, *cols, skip.alias("skip"), F.coalesce("_page", F.lit(1)).alias("page")), capacity, doc)
    count = rest.groupBy(doc).agg(F.count("*").alias("folded"))
    return kept.unionByName(folded), plan.select(doc, "blocks").join(count, doc, "left").select(doc, "blocks", F.coalesce("folded", F.lit(0)).alias("folded"))


def bands(pages: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """A header or footer row for each page of its section."""
    return pages.join(sections, key)
