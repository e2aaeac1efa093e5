"""Line dedup by a deletion-neighbourhood join.

A line is its words (lower-cased, split at white space). Each line emits hashed
keys: the whole line, and, where it has at least `least` words, the line without
each one of its words, keyed with and without the position of the gap. Lines
that share a key are within one word edit of one another:

* whole = whole: equal lines;
* gap at i = gap at i: one word replaced;
* whole = gap: one word inserted or deleted.

Equal lines are brought together first, one copy a chunk of text, and compared
by their words; only the earliest of them emits further keys, so a line that a third of the
corpus repeats counts once. The earliest line of a key is a partner of all others, and a
minimum for each key finds every line an earlier partner without pairing lines. Found
partners are verified on their words before a line goes.

Order is (doc_id, line number). A line goes when an earlier one lies within the
bound, whether that one goes or stays, so the result doesn't depend on any
processing order. Lines without words never go. Null texts stay null; texts
without a line that goes are returned as they are. A null doc_id comes after
all others. Rows that share a doc_id, or have none, follow one another by a hash
of their text, and each is a row of its own (see `placed`): of rows alike in both
one keeps its lines. Other columns may have any name and are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, PACKED, U64, by_shard, discard, free, keep, mix64, pack, partitions, release, text_chunks, unpack, words

#: Fewest words of a line that may lose or change one; shorter lines must be equal.
LEAST_WORDS = 8
CHUNK = 3_000_000
PER_SHARD = 16_000_000  # bytes of text
LAST = np.iinfo(np.int64).max  # a null doc_id's place
BASE = U64(MIX[0])


def powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, U64)
    np.cumprod(np.full(n, BASE, U64), out=out[1:])
    return out


def gaps_of(h: np.ndarray, n_words: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive lines with word hashes h: each line's key; and for the wanted lines (line, key, place) without each one word.

    Equal words have equal keys, whether a word was left out or not.
    """
    ends = np.cumsum(n_words)
    starts = ends - n_words
    pos = np.arange(len(h)) - np.repeat(starts, n_words)
    # a polynomial hash: prefix sums give any line without one word at once
    term = h * powers(int(n_words.max(initial=1)))[pos]
    total = np.r_[U64(0), np.cumsum(term)]
    before, whole = total[starts], total[ends] - total[starts]
    own = mix64(whole ^ n_words.astype(U64))
    at = np.flatnonzero(np.repeat(wanted(own), n_words))
    line = np.repeat(np.arange(len(n_words)), n_words)[at]
    prefix = total[at] - before[line]
    rest = prefix + (whole[line] - prefix - term[at]) * U64(pow(int(BASE), -1, 2**64))
    return own, line, mix64(rest ^ (n_words[line] - 1).astype(U64)), (pos[at] + 1).astype(np.uint32)


SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts' lines laid end to end; and of each line with words its words, text and number.

    The words are those of `words`; their hashes are polynomials of their bytes,
    summed for all words at once.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    a = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = SPACE[a]
    start = ~space & np.r_[True, space[:-1]]
    at = np.flatnonzero(~space)
    starts = np.flatnonzero(start)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(U64), none, none, none
    first = np.searchsorted(at, starts)
    length = np.diff(np.r_[first, len(at)])
    place = at - np.repeat(starts, length)
    h = mix64(np.add.reduceat((a[at] + U64(1)) * powers(int(length.max()))[place], first))
    newline = a == 10
    line, n_words = np.unique(np.cumsum(newline)[starts], return_counts=True)
    lines = np.array([r.count(b"\n") + 1 for r in raw])
    before = np.cumsum(lines) - lines
    text = np.searchsorted(before, line, "right") - 1
    return h, n_words, text, line - before[text]


def placed(docs: DataFrame, place: str, tie: str) -> DataFrame:
    """docs with two columns that tell each row from all others and order them: its doc_id, and 0 or, where rows share that, its number among all such rows by text."""
    found = docs.withColumn(place, F.coalesce("doc_id", F.lit(int(LAST))))
    shared = keep(found.groupBy(place).count().where("count > 1").select(place), "shared")
    if shared.isEmpty():
        return found.withColumn(tie, F.lit(0).cast("long"))
    alone = found.join(shared, place, "left_anti").select(*found.columns, F.lit(0).cast("long").alias(tie))
    # rows alike are dealt by chance, so that many of them are no single task's
    ordered = found.join(shared, place, "left_semi").orderBy(place, F.xxhash64("text"), F.rand(1)).select(*found.columns, (F.monotonically_increasing_id() + 1).alias(tie))
    return keep(alone.union(ordered), "placed")


def distinct_lines(docs: DataFrame, n: int) -> DataFrame:
    """Lines of rows (doc, tie, text), packed by shards of their words' hash. Of equal lines a chunk sends only the earliest; the others go along as pairs with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids, ties in text_chunks(batches, ["text", "doc", "tie"], CHUNK):
            places, ties = np.array(ids, np.int64), np.array(ties, np.int64)
            first: dict[bytes, int] = {}
            doc, tie, no, copies, of = [], [], [], [], []
            for r in np.lexsort((ties, places)).tolist():
                for k, line in enumerate((texts[r] or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):
                    key = b" ".join(line.split())
                    if not key:
                        continue
                    at = first.setdefault(key, len(doc))
                    if at == len(doc):
                        doc.append(places[r])
                        tie.append(ties[r])
                        no.append(k)
                    else:
                        copies.append((places[r], ties[r], k))
                        of.append(at)
            if not doc:
                continue
            keys = list(first)
            doc, tie, no = np.array(doc, np.int64), np.array(tie, np.int64), np.array(no, np.int32)
            own = np.fromiter(map(xxhash.xxh64_intdigest, keys), U64, len(keys))
            blobs: dict[int, list[np.ndarray]] = {}
            for s, i in by_shard(own % U64(n), n):
                mine = [keys[k] for k in i.tolist()]
                blobs[s] = [own[i], np.diff(doc[i], prepend=0), tie[i], no[i], np.array(list(map(len, mine)), np.uint32), np.frombuffer(b"".join(mine), np.uint8)]
            if copies:
                a, b, c = (np.array(x, np.int64) for x in zip(*copies))
                # where they go doesn't matter, so a chunk's pairs are in one of its blobs
                blobs[int(own[0] % U64(n))] += [a, b, c.astype(np.int32), doc[of], tie[of], no[of]]
            yield pa.RecordBatch.from_arrays([pa.array(list(blobs), pa.int32()), pa.array([pack(*x) for x in blobs.values()], pa.binary())], ["shard", "blob"])

    return docs.select("doc", "tie", "text").mapInArrow(run, PACKED)


def emit(packed: DataFrame, least: int, n: int) -> DataFrame:
    """Keys of distinct lines, packed by shard; with them the pairs of lines that are equal.

    All copies of a line are in one shard, one a chunk at most, and meet here: the
    earliest stands for them all from here on, and the others are pairs with it.
    Lines are equal when their words are, not when their hashes are.
    """

    def run(t: pa.Table) -> pa.Table:
        parts, pairs = [], []
        for blob in t.column("blob").to_pylist():
            arrays = unpack(blob)
            ends = np.cumsum(arrays[4], dtype=np.int64)
            raw = arrays[5].tobytes()
            text = [raw[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]
            parts.append((arrays[0], np.cumsum(arrays[1]), arrays[2], arrays[3], text))
            pairs += [arrays[6:]] if len(arrays) > 6 else []
        own, doc, tie, no = (np.concatenate(x) for x in list(zip(*parts))[:4])
        text = [x for p in parts for x in p[4]]
        order = np.lexsort((no, tie, doc, own))
        own, doc, tie, no = own[order], doc[order], tie[order], no[order]
        new = np.r_[True, own[1:] != own[:-1]]
        of = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        alone = [i for i in np.flatnonzero(~new).tolist() if text[order[i]] != text[order[of[i]]]]
        new[alone] = True  # another line of the same hash
        copy = np.flatnonzero(~new)
        pairs.append([x for k in (copy, of[copy]) for x in (doc[k], tie[k], no[k])])
        kept = np.flatnonzero(new)
        kept = kept[np.lexsort((no[kept], tie[kept], doc[kept]))]
        doc, tie, no = doc[kept], tie[kept], no[kept]
        h, n_words, line, _ = hashed([text[k].decode("utf-8", "surrogatepass") for k in order[kept].tolist()])
        doc, tie, no = doc[line], tie[line], no[line]
        # hashes of the shortest lines meet no other line
        own, line, gaps, place = gaps_of(h, n_words, lambda own: n_words >= least)
        long = np.flatnonzero(n_words >= least - 1)
        blobs: dict[int, list[np.ndarray]] = {}
        for s, i in by_shard(own[long] % U64(n), n):
            i = long[i]
            blobs[s] = [np.diff(doc[i], prepend=0), tie[i], no[i], own[i] // U64(n) & KEY]
        for s, i in by_shard(gaps % U64(n), n):
            new = np.r_[True, line[i][1:] != line[i][:-1]]
            src = line[i][new]
            blobs.setdefault(s, [doc[:0], tie[:0], no[:0], own[:0]])
            blobs[s] += [np.diff(doc[src], prepend=0), tie[src], no[src], new.astype(np.uint8), place[i], gaps[i] // U64(n) & KEY]
        out = {s: pack(*x) for s, x in blobs.items()}
        shards, made = list(out), list(out.values())
        equal = [np.concatenate(x) for x in zip(*pairs)]
        if len(equal[0]):
            shards.append(int(t.column("shard")[0].as_py()))
            made.append(pack(*equal))
        return pa.table({"shard": pa.array(shards, pa.int32()), "blob": pa.array(made, pa.binary())})

    return packed.groupBy("shard").applyInArrow(run, PACKED)


#: Bits of a key that a shard compares; what meets by chance is told apart by its words.
KEY = U64((1 << 48) - 1)
PARTNER = "doc long, tie long, no int, with_doc long, with_tie long, with_no int, equal boolean"
NAMES = [c.split(" ")[0] for c in PARTNER.split(", ")]
ROW, WITH = ["doc", "tie", "no"], ["with_doc", "with_tie", "with_no"]


def partners(packed: DataFrame) -> DataFrame:
    """For each distinct line, a shard's earliest line that shares a key with it and comes before it; and the pairs of equal lines that came along."""

    def run(t: pa.Table) -> pa.Table:
        doc, tie, no, parts, equal = [], [], [], [], []
        for blob in t.column("blob").to_pylist():
            arrays = unpack(blob)
            if len(arrays) == 6:
                equal.append(arrays)
                continue
            parts.append((arrays[3], None, None))
            doc.append(np.cumsum(arrays[0]))
            tie.append(arrays[1])
            no.append(arrays[2])
            if arrays := arrays[4:]:
                new, place, key = arrays[3:]
                parts.append((key, np.cumsum(new, dtype=np.int32) - 1, place))
                doc.append(np.cumsum(arrays[0]))
                tie.append(arrays[1])
                no.append(arrays[2])
        equal = [np.concatenate(x) for x in zip(*equal)] or [np.zeros(0, t) for t in (np.int64, np.int64, np.int32) * 2]
        if not parts:
            return pa.table([*map(pa.array, equal), pa.array(np.ones(len(equal[0]), bool))], NAMES)
        low = np.concatenate([x[0] for x in parts])
        order = np.argsort(low)
        same = low[order][1:] == low[order][:-1]
        shared = np.zeros(len(low), bool)  # most keys have one line, and the rest is built for the others only
        shared[order[np.r_[same, False] | np.r_[False, same]]] = True
        del order, same
        low = low[shared]
        row, gap = [], []
        at = lines = 0
        for (key, of, place), d in zip(parts, doc):
            here = np.flatnonzero(shared[at : at + len(key)])
            line = here if of is None else of[here].astype(np.int64)
            row.append(line + lines)
            gap.append(np.zeros(len(here), np.uint32) if place is None else place[here])
            at += len(key)
            lines += len(d)
        del parts, shared
        doc, tie, no, row, gap = map(np.concatenate, (doc, tie, no, row, gap))
        by = np.lexsort((no, tie, doc) if tie.any() else (no, doc))
        new = np.r_[True, np.any([x[by][1:] != x[by][:-1] for x in (doc, tie, no)], axis=0)]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new) - 1
        doc, tie, no = doc[by][new], tie[by][new], no[by][new]  # by rank
        row = rank[row]
        found = []

        def meet(src: np.ndarray, dst: np.ndarray) -> None:
            found.append((src * len(doc) + dst)[dst < src])

        def firsts(*keys: np.ndarray) -> np.ndarray:
            """For sorted rows, the place of the first with the same keys."""
            new = np.any([np.r_[True, k[1:] != k[:-1]] for k in keys], axis=0)
            return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

        if len(row):
            order = np.lexsort((row, gap, low))
            row, low, gap = row[order], low[order], gap[order]
            meet(row, row[firsts(low, gap)])  # equal, or another word in the same place
            whole = np.where(gap == 0, row, len(doc))
            starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            sizes = np.diff(np.r_[starts, len(low)])
            least_whole = np.repeat(np.minimum.reduceat(whole, starts), sizes)
            meet(row[gap > 0], np.where(least_whole < len(doc), least_whole, len(doc) * 2)[gap > 0])  # a word less
            gapped = np.repeat(np.minimum.reduceat(np.where(gap > 0, row, len(doc) * 2), starts), sizes)
            meet(row[gap == 0], gapped[gap == 0])  # a word more
        src, dst = np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), max(1, len(doc)))
        near = (doc[src], tie[src], no[src], doc[dst], tie[dst], no[dst])
        return pa.table([*(pa.array(np.r_[x, y]) for x, y in zip(near, equal)), pa.array(np.arange(len(src) + len(equal[0])) >= len(src))], NAMES)

    return packed.groupBy("shard").applyInArrow(run, PARTNER)


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the word edit distance is 1 at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def duplicates(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Of rows (doc, tie, text) that (doc, tie) tells apart: every line that goes, by row and number, and an earlier line that it repeats."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(2 * partitions(docs.sparkSession), math.ceil(size / PER_SHARD))
    found = keep(partners(emit(distinct_lines(docs, n), least, n)), "partners")
    release(docs.sparkSession)
    near = found.where(~F.col("equal")).drop("equal").distinct()
    wanted = near.select(ROW).union(near.select(WITH)).distinct()
    places = wanted.groupBy("doc", "tie").agg(F.collect_set("no").alias("numbers"))
    text = F.split("text", "\n")

    # sorted and merged at every size: both sides grow with the corpus
    own = docs.select("doc", "tie", "text").join(places.hint("merge"), ["doc", "tie"])
    lines = keep(own.withColumn("lines", text).select("doc", "tie", F.explode(F.transform("numbers", lambda k: F.struct(k.alias("no"), F.get("lines", k).alias("line")))).alias("x")).select("doc", "tie", "x.no", "x.line"), "lines")
    pairs = near.join(lines.hint("merge"), ROW).join(lines.toDF(*WITH, "with_line").hint("merge"), WITH)

    @F.pandas_udf("boolean")
    def verified(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([(x := words(p)) == (y := words(q)) or (max(len(x), len(y)) >= least and within_one(x, y)) for p, q in zip(a, b)], dtype=bool)

    links = pairs.where(verified("line", "with_line")).select(*ROW, *WITH).union(found.where("equal").select(*ROW, *WITH))
    gone = keep(links.groupBy(ROW).agg(F.min(F.struct(WITH)).alias("w")).select(*ROW, "w.*"), "gone")
    discard(found, lines)
    return gone


def dedupe_lines(docs: DataFrame, least: int = LEAST_WORDS, out: str = "lines_removed") -> DataFrame:
    """docs with the lines that go taken out of text, and how many went in column `out`."""
    gone, place, tie = free(docs, "_gone"), free(docs, "_place"), free(docs, "_tie")
    docs = placed(docs, place, tie)
    found = duplicates(docs.select(F.col(place).alias("doc"), F.col(tie).alias("tie"), "text"), least)
    release(docs.sparkSession)
    numbers = found.groupBy(F.col("doc").alias(place), F.col("tie").alias(tie)).agg(F.collect_set("no").alias(gone))
    rows = docs.join(numbers.hint("merge"), [place, tie], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    rows = rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)).withColumn(out, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return rows.drop(gone, place, tie)
