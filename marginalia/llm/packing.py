"""Packing into sequences by cutting-stock column generation.

A document is its token ids and one end id. It is cut into pieces of `length`
ids and a rest; whole pieces are sequences of their own, and rests are packed:

* Their lengths, rounded up to `grain`, make a histogram of at most
  length / grain classes, whatever the number of documents. Only it goes to the
  driver.
* A linear program over patterns (how many rests of each class share a
  sequence) is solved by column generation: a knapsack over the dual prices, by
  dynamic programming, yields the next pattern until none is worth more than
  GAP above the bound.
* Patterns are used as often as the solution's whole part says; what is left,
  less than a few sequences a pattern, is filled largest first.
* Rests are ranked within their class, and rank decides pattern, copy and slot.
  Offsets are sums of true lengths, so sequences have no holes.

Null and empty texts are the end id alone. Repeated rows are packed each. Rows
may have a null doc_id. Columns besides doc_id and text are not read. No rows,
no sequences.
"""

from __future__ import annotations

import base64
import functools
import sys
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, text_chunks

LENGTH, GRAIN, END_ID = 2048, 8, 1
GAP = 1e-4
SPECIAL = "<|endoftext|>"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """text -> ids of the byte-level BPE in a tokenizers file, as Tokenizer.encode(add_special_tokens=False) gives them.

    Where the same vocabulary lies beside it as tiktoken ranks, that encoder is
    used (five times as fast, the same ids); texts with the special token's
    string go to the tokenizers one, which alone reads it as one id.
    """
    kept = sys.__dict__.setdefault("_marginalia_encoders", {})  # a worker process serves many tasks
    if path not in kept:
        @functools.cache
        def slow():
            from tokenizers import Tokenizer

            return Tokenizer.from_file(path)

        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            kept[path] = lambda t: slow().encode(t, add_special_tokens=False).ids if SPECIAL in t else fast.encode_ordinary(t)
        else:
            kept[path] = lambda t: slow().encode(t, add_special_tokens=False).ids
    return kept[path]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for texts, ids in text_chunks(batches, ["text", "doc_id"]):
            out = []
            for text, i in zip(texts, ids):
                tokens = np.array([*(encode(text) if text else ()), END_ID], "<u4")
                for at in range(0, len(tokens), length):
                    piece = tokens[at : at + length]
                    out.append((i, at, len(piece), zlib.crc32(piece.tobytes()), len(tokens)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [c.split(" ")[0] for c in PIECE.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The knapsack of most worth: its worth, and how many of each size. sizes ascend."""
    worth, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        worth[c] = worth[c - 1]
        if n := fits[c]:
            of = worth[c - sizes[:n]] + prices[:n]
            i = int(of.argmax())
            if of[i] > worth[c] + 1e-12:
                worth[c], took[c] = of[i], i
    out, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[took[c]] += 1
            c -= sizes[took[c]]
    return float(worth[room]), out


def solve(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Column generation by the revised simplex method: patterns of the last basis, how often, and a lower bound."""
    n = len(sizes)
    basis = np.diag(room // sizes).astype(float)  # one class a pattern, to begin with
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    bound = 0.0
    while True:
        prices = np.maximum(inverse.sum(0), 0.0)
        worth, pattern = best_pattern(prices, sizes, room)
        now = x.sum()
        bound = max(bound, float(prices @ demand) / max(worth, 1.0))
        if worth <= 1 + 1e-9 or now - bound <= GAP * now:
            return basis.T.round().astype(np.int64), x, bound
        way = inverse @ pattern
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * way, 0.0)
        x[out] = step
        basis[:, out] = pattern
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row


def plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold all of demand."""
    out: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    if not len(sizes):
        return out
    patterns, x, _ = solve(sizes, demand.astype(float), room)
    for pattern, times in zip(patterns, np.floor(x + 1e-9).astype(np.int64)):
        has = pattern > 0
        times = min(times, int((left[has] // pattern[has]).min())) if has.any() else 0
        if times > 0:
            out.append((pattern, int(times)))
            left -= pattern * times
    while left.any():  # largest first, as often as the rest allows
        pattern, space = np.zeros_like(left), room
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], space // sizes[i])
            space -= pattern[i] * sizes[i]
        has = pattern > 0
        times = int((left[has] // pattern[has]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def slots(patterns: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """For each class its runs of ranks: (first rank, first sequence, how many a sequence, first slot)."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[i])
            out.setdefault(i, []).append((rank.get(i, 0), sequence, each, slot))
            rank[i] = rank.get(i, 0) + each * times
            slot += each
        sequence += times
    return {i: np.array(v, np.int64) for i, v in out.items()}


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    # each piece gets a number of its own as it is written, so that pieces alike are dealt apart
    cut = keep(pieces(docs, tokenizer or vocabulary(), length).withColumn("row", F.monotonically_increasing_id()), "pieces")
    size = F.ceil(F.col("length") / grain).cast("int")
    rests = cut.where(F.col("length") < length).withColumn("size", size)
    found = sorted((r["size"], r["count"]) for r in rests.groupBy("size").count().collect())
    sizes = np.array([s for s, _ in found], np.int64)
    patterns = plan(sizes, np.array([c for _, c in found], np.int64), length // grain)
    runs = {int(sizes[i]): v for i, v in slots(patterns).items()}
    sequences = sum(times for _, times in patterns)

    # a rank within a class: a running count of its buckets, then the place in the bucket; no class meets in one task
    rests = rests.withColumn("mark", F.xxhash64("row")).withColumn("bucket", F.pmod("mark", F.lit(4 * partitions(docs.sparkSession))))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rests.groupBy("size", "bucket").count().select("size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("mark", "row")) - 1
    ranked = rests.withColumn("place", place).join(counts, ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))
    names = [c.split(" ")[0] for c in PIECE.split(", ")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            seq, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(size).tolist():
                rows, run = np.flatnonzero(size == s), runs[s]
                k = np.searchsorted(run[:, 0], rank[rows], "right") - 1
                at = rank[rows] - run[k, 0]
                seq[rows] = run[k, 1] + at // run[k, 2]
                slot[rows] = run[k, 3] + at % run[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(slot)], [*names, "sequence_id", "slot"])

    placed = ranked.select(*names, "size", "rank").mapInArrow(assign, f"{PIECE}, sequence_id long, slot long")
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
    whole = cut.where(F.col("length") == length).drop("row").withColumn("sequence_id", F.monotonically_increasing_id() + sequences).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(whole)
