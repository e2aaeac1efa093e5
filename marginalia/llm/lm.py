"""Language-model scores from an Elias-Fano n-gram trie, dealt over the cluster.

The model. Orders one to four, each smoothed by the order below (a hierarchical
Dirichlet prior):

    p1(w)     = (c(w) + 1) / (N + V + 1)               all unknown words are one
    pk(w | h) = (c(h w) + M_k p(k-1)(w | h')) / (C(h) + M_k)

where c counts training tokens, h' is h without its first word and C(h) how
often h is followed by a word. So the words of each order sum to one, and a
context that was never seen gives the order below. A text is its words and an
end; before the first word stands a start, which is context only, so the first
word has order two at most and the second three.

The work goes order by order, and all n-grams have the same way whatever the
size of the corpus:

1. Texts are packed into chunks of about CHUNK bytes, a table in the shared folder.
2. Each chunk asks for its distinct n-grams of the order, once each, with their
   counts in the chunk's training texts. They are dealt by context and a slice of
   the last word. There is a slice for each SHARE shards, so that a context which
   holds a third of all rows is spread over as many.
3. A shard adds the counts up, builds its part of the level from what was trained
   (contexts, and the words after each) in a memory-mapped file, and answers each
   chunk in the order asked: quantised probabilities, and exact counts of words.
4. Each chunk's texts meet the answers of all orders and are scored.

Everything is counted in full and counts are sums, so results don't depend on
the partitions of the input. Only sums (N, V) go to the driver and nothing is
broadcast. Single words are known by 64 bits. In longer n-grams a word is known
by 32 bits (24 in order four) within its context, and a context by 40 within its
shard; so an n-gram that isn't there is taken for one that is with a chance of
2**-32 (2**-24) for each word that follows its context.

Nulls and empty texts are just the end token. A null doc_id counts as an empty
string for the split. Repeated rows each count and each get a row. Only doc_id
and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, U64, by_shard, keep, mix64, pack, partitions, release, trim, unpack
from .trie import Trie, dequantise

FOLDS, HELD = 7, 2
#: Weight of the order below in orders two, three and four.
PRIOR = (1000.0, 100.0, 3.0)
ORDERS = 1 + len(PRIOR)
END, START = U64(xxhash.xxh64_intdigest(b" end")), U64(xxhash.xxh64_intdigest(b" start"))  # no word holds a blank
WORD_BITS, CONTEXT_BITS = {2: 32, 3: 32, 4: 24}, 40
PER_SHARD = 7_000_000  # bytes of text
SHARE = 16
CHUNK = 2_500_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the number of each; a sort of number and place in one word, where both fit, is the fastest way."""
    bits = len(x).bit_length()
    if len(x) == 0 or int(x.max()) >> (64 - bits):
        return np.unique(x, return_inverse=True)
    both = np.sort(x.view(U64) << U64(bits) | np.arange(len(x), dtype=U64))
    value, at = (both >> U64(bits)).view(np.int64), (both & U64((1 << bits) - 1)).view(np.int64)
    new = np.r_[True, value[1:] != value[:-1]]
    inverse = np.empty(len(x), np.int64)
    inverse[at] = np.cumsum(new) - 1
    return value[new], inverse


class Grams:
    """The distinct n-grams of a chunk in sorted order, up to an order, and which of them each token ends.

    words: hashes. grams: (parent, word) for orders from two on, where parents are
    n-grams of the order below and words are numbers in `words` (one past its end:
    the start). of: for each order the n-gram of each token, -1 for none.
    """

    def __init__(self, size: np.ndarray, coded: np.ndarray, hashes: np.ndarray, top: int = ORDERS):
        """Of texts with `size` tokens each, the end included; coded has each word's number in hashes."""
        self.size, self.first = size, np.cumsum(size) - size
        self.words, rank = np.unique(np.r_[hashes, END], return_inverse=True)
        one = np.full(int(size.sum()), rank[-1])
        at = np.ones(len(one), bool)
        at[np.cumsum(size) - 1] = False
        one[at] = rank[coded]
        self.place = np.arange(len(one)) - np.repeat(self.first, self.size)
        base = len(self.words) + 1
        before = np.where(self.place > 0, np.r_[0, one[:-1]], base - 1)
        self.of, self.grams = [one], []
        for order in range(2, top + 1):
            on = np.flatnonzero(self.place >= order - 2)
            parent = before[on] if order == 2 else self.of[-1][on - 1]
            u, inverse = numbered(parent * base + one[on])
            of = np.full(len(one), -1, np.int64)
            of[on] = inverse
            self.of.append(of)
            self.grams.append(np.divmod(u, base))

    def counts(self, train: np.ndarray, order: int) -> np.ndarray:
        """How often training texts have each n-gram of an order."""
        of = self.of[order - 1]
        n = len(self.words) if order == 1 else len(self.grams[order - 2][0])
        return np.bincount(of[np.repeat(train, self.size) & (of >= 0)], minlength=n).astype(np.uint32)

    def dealt(self, order: int, n: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Codes of an order's contexts and of its words, and the n-grams of each of n shards, in order."""
        word = mix64(np.r_[self.words, START] ^ U64(MIX[3]))
        code = word
        for parent, last in self.grams[: order - 2]:
            code = mix64(code[parent] * U64(MIX[1]) + word[last])
        parent, last = self.grams[order - 2]
        shard = (code[parent] + word[last] % U64(1 + n // SHARE)) % U64(n)
        return (code >> U64(64 - CONTEXT_BITS)), (word >> U64(64 - WORD_BITS[order])).astype(np.uint32), dict(by_shard(shard, n))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each run of equal values, and the runs' lengths."""
    new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[new], np.diff(np.r_[new, len(x)]).astype(np.uint32)


def narrow(x: np.ndarray) -> np.ndarray:
    """Small numbers as bytes."""
    return x.astype(np.uint8) if len(x) and int(x.max()) < 256 else x


def asked(g: Grams, train: np.ndarray, order: int, n: int) -> Iterator[tuple[int, bytes]]:
    """What a chunk asks of each shard: contexts (in two parts), how many words after each, the words, and counts; with order two also single words and theirs."""
    context, word, shards = g.dealt(order, n)
    low, top = context.astype(np.uint32), (context >> U64(32)).astype(np.uint8)
    parent, last = g.grams[order - 2]
    count, single = g.counts(train, order), g.counts(train, 1)
    alone = dict(by_shard(g.words % U64(n), n)) if order == 2 else {}
    none = np.zeros(0, np.int64)
    for s in sorted({*shards, *alone}):
        i, one = shards.get(s, none), alone.get(s, none)
        head, fan = runs(parent[i])
        yield s, pack(low[head], top[head], narrow(fan), word[last[i]], narrow(count[i]), g.words[one], narrow(single[one]))


def summed(count: np.ndarray, fan: np.ndarray) -> np.ndarray:
    """Sums of as many consecutive counts as each fan says, one at least."""
    return np.add.reduceat(count, np.cumsum(fan, dtype=np.int64) - fan, dtype=np.int64) if len(fan) else np.zeros(0, np.int64)


def answered(requests: list[list[np.ndarray]], bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
    """Answers to all requests of a shard: codes of n-grams and exact counts of single words; and training tokens and distinct words."""
    low, top, fan, word, count, single, own = (np.concatenate(x) for x in zip(*requests))
    contexts, of = numbered(top.astype(np.int64) << 32 | low)
    total = np.bincount(of, summed(count, fan), len(contexts))
    grams, inverse = numbered(np.repeat(of, fan) << bits | word)
    counts = np.bincount(inverse, count, len(grams))
    del low, top, word, count
    parent, last = grams >> bits, (grams & ((1 << bits) - 1)).astype(U64)
    contexts, trained, seen = contexts.view(U64), total > 0, counts > 0
    node = np.cumsum(trained) - 1
    trie = Trie([(None, contexts[trained], total[trained]), (node[parent[seen]], last[seen], counts[seen])], bits)
    # what many chunks ask is looked up once, and in the trie's order, so that its file is read from front to back
    codes = trie.code(1, trie.find(1, trie.find(0, None, contexts)[parent], last))[inverse]
    u, at = np.unique(single, return_inverse=True)
    known = np.bincount(at, own, len(u)).astype(np.int64)
    parts = lambda x, k: np.split(x, np.cumsum([len(r[k]) for r in requests])[:-1])
    return list(zip(parts(codes, 3), parts(known[at], 5))), int(known.sum()), int((known > 0).sum())


def probabilities(g: Grams, counts: list[np.ndarray], tokens: int, distinct: int) -> np.ndarray:
    """Of each token, from the counts of the chunk's n-grams by order."""
    own = [np.where(o >= 0, c[np.maximum(o, 0)] if len(c) else 0, 0).astype(np.float64) for o, c in zip(g.of, counts)]
    starts = float(counts[0][np.searchsorted(g.words, END)])  # as many as ends
    p = (own[0] + 1.0) / (tokens + distinct + 1.0)
    for order, prior in enumerate(PRIOR, 2):
        context = np.r_[0.0, own[order - 2][:-1]]
        if order == 2:
            context = np.where(g.place > 0, context, starts)
        p = np.where(g.place >= order - 2, (own[order - 1] + prior * p) / (context + prior), p)
    return p


def arrow_chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows (text, doc_id) in order, in tables of about `most` bytes of text."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + most - size, "left")) + 1)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text (its words and an end), the words by number, and the numbers' hashes. The words are those of `words`."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    every = lists.flatten()
    real = pc.greater(pc.binary_length(every), 0)  # white space at an end gives an empty word
    counts = np.diff(np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]])
    found = every.filter(real).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found.dictionary.cast(pa.binary()).to_pylist()), U64, len(found.dictionary))
    return counts + 1, found.indices.to_numpy(), hashes


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of texts: ids, whether they are null, tokens of each text, words by number, and the numbers' hashes."""
    task = TaskContext.get().partitionId() << 32
    for k, rows in enumerate(arrow_chunks(batches, CHUNK)):
        ids = rows.column("doc_id").combine_chunks()
        blob = pack(pc.fill_null(ids, 0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), *coded(rows.column("text").combine_chunks()))
        yield pa.RecordBatch.from_arrays([pa.array([task + k], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])
    trim()


def answers(chunks: DataFrame, order: int, n: int) -> DataFrame:
    """chunk, order, shard, blob with the answers of an order, and sums of tokens and distinct words with order two."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, null, *tokens = unpack(blob.as_py())
                train = np.array([not held_out(None if x else i) for i, x in zip(ids.tolist(), null.tolist())])
                out = list(asked(Grams(*tokens, order), train, order, n))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], ["shard", "chunk", "blob"])
        trim()

    def answer(t: pa.Table) -> pa.Table:
        found, tokens, distinct = answered([unpack(x) for x in t.column("blob").to_pylist()], WORD_BITS[order])
        n = len(found)
        first = np.arange(n) == 0
        trim()
        return pa.table(
            {
                "chunk": t.column("chunk"), "order": pa.array(np.full(n, order), pa.int32()), "shard": t.column("shard"),
                "blob": pa.array([pack(*x) for x in found], pa.binary()), "tokens": tokens * first, "distinct": distinct * first,
            }
        )

    asks = chunks.mapInArrow(ask, "shard int, chunk long, blob binary")
    return keep(asks.groupBy("shard").applyInArrow(answer, "chunk long, order int, shard int, blob binary, tokens long, distinct long"), "answers")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(partitions(spark), math.ceil(size / PER_SHARD))
    chunks = keep(docs.select("text", "doc_id").mapInArrow(cut, "chunk long, blob binary"), "chunks")
    found = []
    for order in range(2, ORDERS + 1):
        found.append(answers(chunks, order, n))
        release(spark)
    tokens, distinct = found[0].agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = tokens or 0, distinct or 0

    def finish(t: pa.Table) -> pa.Table:
        rows = list(zip(t.column("order").to_pylist(), t.column("shard").to_pylist(), t.column("blob").to_pylist()))
        ids, null, *own = unpack(next(blob for order, _, blob in rows if order == 0))
        g = Grams(*own)
        shards = {order: g.dealt(order, n)[2] for order in range(2, ORDERS + 1)}
        alone = dict(by_shard(g.words % U64(n), n))
        counts = [np.zeros(len(g.words), np.int64), *(np.zeros(len(w), np.uint16) for _, w in g.grams)]
        for order, s, blob in rows:
            if order:
                codes, single = unpack(blob)
                if s in shards[order]:
                    counts[order - 1][shards[order][s]] = codes
                if len(single):
                    counts[0][alone[s]] = single
        counts[1:] = [dequantise(c) for c in counts[1:]]
        p = probabilities(g, counts, tokens, distinct)
        count = counts[0][g.of[0]]
        of_doc = lambda x: np.add.reduceat(x, g.first)
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=null),
                "n_tokens": g.size,
                "n_known": of_doc((count > 0).astype(np.int64)),
                "base": of_doc(np.log10(count + 1.0)),
                "score": of_doc(np.log10(p)),
            }
        )

    rows = chunks.select("chunk", F.lit(0).alias("order"), F.lit(0).alias("shard"), "blob")
    for f in found:
        rows = rows.union(f.select("chunk", "order", "shard", "blob"))
    whole = rows.groupBy("chunk").applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base double, score double")
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return whole.select(
        "doc_id",
        (F.crc32(text.cast("binary")) % FOLDS == HELD).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(tokens + distinct + 1)).alias("base_score"),
        "score",
    )
