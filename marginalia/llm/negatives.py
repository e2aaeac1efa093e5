"""Hard-negative mining by a two-dimensional block matrix multiply.

Anchors and rows are cut into blocks, and each block into chunks of dimensions.
A grid of (anchor blocks, row blocks, dimension chunk) multiplies its blocks, as
in SUMMA: a block is sent once to every column (row) of the grid it takes part in,
and each meeting of two blocks gives a partial tile of integer scores. Partial
tiles of the same blocks are shuffled together and added, and an added tile
leaves its task only as the best few of each anchor.

That runs twice over different tiles: first those that hold rows of an anchor's
own label, for the anchor's positives; then those that hold other labels, for the
best rows in each positive's window of scores. Blocks are cut from rows in order of
label, so nearly all tiles belong to one of the two runs only.

Products are exact: in floating point where they stay below 2^53, else in 64-bit
integers (which wrap).

A row takes no part when its label, id or vector is null, or a component is null
or not finite. Missing components of a shorter vector count as 0. Rows that
share an id are rows of their own: each may be an anchor, and the others are its
candidates; between equal scores and ids, a row's number decides. Columns are taken
by name, and others aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, keep, pack, unpack

#: Rows of a block, anchors of a block, dimensions of a chunk; blocks of rows and of anchors that one task of the grid multiplies.
ROWS, ANCHORS, DIMS = 2048, 256, 32
GRID_ROWS, GRID_ANCHORS = 4, 8
LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Rule:
    """An anchor has `positives`; a positive has `negatives`, of a score between low and high percent of its own."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100


def quantised(vectors: DataFrame, scale: int = 256, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, q) of the rows that take part: components times scale, rounded down."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col(id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & finite)
    return rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("q"))


def whole(a: np.ndarray) -> np.ndarray:
    """Signed numbers as the narrowest unsigned ones that hold them, sign last, which pack well."""
    z = ((a << 1) ^ (a >> 63)).astype(U64)
    top = int(z.max(initial=0))
    return z.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else U64)


def signed(z: np.ndarray) -> np.ndarray:
    z = z.astype(U64)
    return (z >> U64(1)).view(np.int64) ^ -(z & U64(1)).view(np.int64)


BLOCK = "block long, chunk int, n int, labels binary, matrix binary, about binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (row, id, label, q, ...) cut in order of label into blocks of `size` at most, one record a chunk of dimensions.

    The record of chunk 0 says what the rows are: their number, id, label, and, where rows have a window, the scores and numbers of their positives.
    """
    windows = "scores" in rows.columns

    def cut(part: pa.Table, number: int) -> Iterator[tuple]:
        q = part.column("q").combine_chunks()
        lengths = np.diff(q.offsets.to_numpy())
        flat = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        dims = max(1, int(lengths.max(initial=0)))
        matrix = np.zeros((len(lengths), dims), np.int64)
        matrix[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        row, ids, label = (part.column(c).to_numpy() for c in ("row", "id", "label"))
        about = [row, ids, label]
        if windows:
            for c in ("scores", "numbers", "ids"):
                x = part.column(c).combine_chunks()
                about += [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(x.offsets.to_numpy())]
        for k in range(0, dims, DIMS):
            yield number, k // DIMS, len(row), pack(label[[0, -1]]), pack(whole(matrix[:, k : k + DIMS].ravel())), pack(*about) if k == 0 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def out(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cut(part, number)), kinds)], [c.split(" ")[0] for c in BLOCK.split(", ")])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= size:
                table = pa.Table.from_batches(held)
                label = table.column("label").slice(0, size).to_numpy()
                # a block ends with its label, where that leaves a fair part of one
                ends = np.flatnonzero(label[1:] != label[:-1]) + 1
                n = int(ends[-1]) if len(ends) and ends[-1] >= size // 4 else size
                yield out(table.slice(0, n))
                held, count = table.slice(n).to_batches(), count - n
        if count:
            yield out(pa.Table.from_batches(held))

    # equal labels are dealt further by the row's number, so that a frequent one is no single task's
    return rows.repartitionByRange("label", F.xxhash64("row")).sortWithinPartitions("label", "id", "row").mapInArrow(run, BLOCK)


TILE = "a long, b long, chunk int, scores binary, about_a binary, about_b binary"


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x times y transposed, in whole numbers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2.0**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def partial_tiles(anchors: DataFrame, rows: DataFrame, same: bool) -> DataFrame:
    """Partial tiles of all pairs of blocks that may hold pairs of one label (same) or of two."""
    sizes = [max(1, -(-d.where("chunk = 0").count() // n)) for d, n in ((anchors, GRID_ANCHORS), (rows, GRID_ROWS))]
    down, across = ((F.pmod(F.xxhash64("block"), F.lit(n))).cast("int") for n in sizes)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"down": down, "across": each(sizes[1])})
    right = rows.withColumns({"down": each(sizes[0]), "across": across})

    def shape(blob: bytes, n: int) -> np.ndarray:
        return signed(unpack(blob)[0]).reshape(n, -1)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        right = [(r, *unpack(r["labels"])[0].tolist(), shape(r["matrix"], r["n"])) for r in b.to_pylist()]
        for x in a.to_pylist():
            lo, hi = unpack(x["labels"])[0].tolist()
            m = shape(x["matrix"], x["n"])
            for y, first, last, other in right:
                if (lo > last or first > hi) if same else (lo == hi == first == last):
                    continue
                width = min(m.shape[1], other.shape[1])
                tile = product(m[:, :width], other[:, :width])
                out.append((x["block"], y["block"], x["chunk"], pack(whole(tile.ravel())), x["about"], y["about"]))
        cols = list(zip(*out)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], [c.split(" ")[0] for c in TILE.split(", ")])

    key = ["down", "across", "chunk"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, TILE)


def added(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The sum of a tile's parts, and what its anchors and rows are."""
    total = sum(signed(unpack(x)[0]) for x in t.column("scores").to_pylist())
    a, b = (unpack(next(x for x in t.column(c).to_pylist() if x is not None)) for c in ("about_a", "about_b"))
    return total.reshape(len(a[0]), len(b[0])), a, b


def best(found: DataFrame, key: list[str], most: int, out: str) -> DataFrame:
    """The first `most` rows of each key by score, id and number; Spark cuts each task's rows to as many before they are shuffled."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "id", "row")
    return found.withColumn(out, F.row_number().over(w)).where(F.col(out) <= most)


def positives(anchors: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(anchor, row, id, score) of each anchor's nearest other rows of its label."""

    def run(t: pa.Table) -> pa.Table:
        score, (number, _, label), (row, ids, other) = added(t)
        fits = (label[:, None] == other) & (number[:, None] != row)
        score = np.where(fits, score, LEAST)
        # rows of a block are in order of (label, id, number), so that a stable sort leaves ties by id
        order = np.argsort(np.negative(score, where=score > LEAST, out=np.full_like(score, np.iinfo(np.int64).max)), axis=1, kind="stable")[:, :most]
        at, col = np.repeat(np.arange(len(number)), order.shape[1]), order.ravel()
        at, col = (x[fits[at, col]] for x in (at, col))
        return pa.table({"anchor": number[at], "row": row[col], "id": ids[col], "score": score[at, col]})

    tiles = partial_tiles(anchors, rows, same=True).groupBy("a", "b").applyInArrow(run, "anchor long, row long, id long, score long")
    return best(tiles, ["anchor"], most, "place")


def window_negatives(anchors: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """(anchor, anchor_id, positive, positive_id, positive_score, rank, row, id, score): the best rows of other labels in each positive's window."""

    def run(t: pa.Table) -> pa.Table:
        score, (number, name, label, scores, n, numbers, _, names, _), (row, ids, other) = added(t)
        fits = label[:, None] != other
        score = np.where(fits, score, LEAST)
        by_id = np.lexsort((row, ids))  # a block may hold several labels
        score, row, ids = score[:, by_id], row[by_id], ids[by_id]
        order = np.argsort(np.negative(score, where=score > LEAST, out=np.full_like(score, np.iinfo(np.int64).max)), axis=1, kind="stable")
        sorted_scores = np.take_along_axis(score, order, 1)
        fit = (sorted_scores > LEAST).sum(1)
        of = np.repeat(np.arange(len(number)), n)
        out = []
        for a in range(len(number)):
            down = sorted_scores[a, : fit[a]][::-1]  # ascending, for searches
            for p in np.flatnonzero(of == a).tolist():
                s = int(scores[p])
                # 100 * score <= high * s, and low * s <= 100 * score
                most, least = rule.high * s // 100, -(-rule.low * s // 100)
                first = len(down) - int(np.searchsorted(down, most, "right"))
                last = min(len(down) - int(np.searchsorted(down, least, "left")), first + rule.negatives)
                out += [(number[a], name[a], numbers[p], names[p], s, row[c], ids[c], score[a, c]) for c in order[a, first:last].tolist()]
        cols = ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "row", "id", "score"]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * len(cols))], cols)

    schema = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, row long, id long, score long"
    tiles = partial_tiles(anchors, rows, same=False).groupBy("a", "b").applyInArrow(run, schema)
    return best(tiles, ["anchor", "positive"], rule.negatives, "rank")


def mine(rows: DataFrame, anchor: Column, rule: Rule = Rule()) -> DataFrame:
    """Of rows (id, label, q), the anchors' positives with their hard negatives, one row each: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = keep(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "q"), "vectors")
    anchors = rows.where(anchor)
    b = keep(blocks(rows, ROWS), "blocks")
    near = keep(positives(keep(blocks(anchors, ANCHORS), "anchors"), b, rule.positives).select("anchor", "row", "id", "score"), "positives")
    # an anchor has rule.positives of them at most
    held = near.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("score", F.col("row").alias("number"), "id"))).alias("near"))
    with_window = anchors.join(held, "row").select("row", "id", "label", "q", F.col("near.score").alias("scores"), F.col("near.number").alias("numbers"), F.col("near.id").alias("ids"))
    found = window_negatives(keep(blocks(with_window, ANCHORS), "anchors"), b, rule)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's rows: where vec_id is divisible by 7 the label is the next of ten."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def oracle() -> str:
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5"""
