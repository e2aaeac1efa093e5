"""Benchmark decontamination by latent semantic retrieval.

1. Passages are runs of 32 words; words are hashed to BUCKETS terms. Document
   frequencies of terms are counted over the distinct passages of all documents,
   so copies of a leak don't make its words common. Frequent terms weigh less,
   and every term weighs something.
2. The term space is reduced by a randomised SVD of the TF-IDF passages in one
   distributed pass: with a random matrix O, tasks sum A'(A O), and the small
   factors (Nystroem) give the right singular vectors. It is fitted on all distinct
   passages of all documents, which are packed in the shared folder meanwhile.
3. Every document passage (32 words, each 16 words) is compared by cosine with
   every passage of the benchmark; vectors are divided by the singular values.
   Beside them, an exact way that rests on no vector: a leak has PARAPHRASE of an
   item's distinct words, hence at least `need` of its rarest ones (all but as
   many as may be missing, and `need` more). Places with so many are candidates.
4. At each candidate the item is aligned with the words around by longest common
   subsequence. It counts as leaked with COPY of its words in
   order, or with PARAPHRASE of them if its end (the answer) is there too.

Items of fewer than LEAST words leave no room for a paraphrase: they are leaked
where all their words stand in a row, found by their rarest word.

The benchmark is sent to tasks in blocks of BLOCK items and BLOCK_BYTES of text at most. A larger one is
searched block by block, one after another, each over all texts, so neither the
driver nor a task ever has more than one block; what is found (by hash of text)
meets the documents at the end. Null and empty texts have no leaks; null
benchmark texts, and those without words, have none either. Repeated documents get equal
results; repeated rows of the benchmark (id and text) are one item. Other columns may have any name.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PACKED, U64, by_shard, discard, free, keep, mix64, pack, partitions, text_chunks, unpack

WIDTH, STEP, ITEM_STEP = 32, 16, 8
BUCKETS, RANK, RANGES = 1 << 12, 96, 16
SEED = 1
COSINE, COPY, PARAPHRASE, ANSWER = 0.45, 0.8, 0.6, 0.75
LEAST, BLOCK = 6, 2000
#: Bytes of text of a block, which bounds what the driver collects and sends.
BLOCK_BYTES = 8_000_000
EDGES = b".,;:!?\"'()[]{}*#%&$|"


def raw_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stripped(raw: list[bytes]) -> list[bytes]:
    return [w for x in raw if (w := x.strip(EDGES))]


def tokens(text: str | None) -> list[bytes]:
    return stripped(raw_words(text))


#: What each byte is: of a word, of its edges (stripped from it), between words.
INNER, EDGE, BLANK = 0, 1, 2
KINDS = np.full(256, INNER, np.uint8)
KINDS[list(EDGES)] = EDGE
KINDS[list(b" \t\n\r\x0b\x0c")] = BLANK
LETTERS = mix64(np.arange(1, 257, dtype=U64))
BASE = 0xD1342543DE82EF95
#: Words are hashed together by so many bytes of text.
SLICE = 1 << 16


class Terms:
    """Hashes of words without a Python object for each, their terms, and their numbers in a vocabulary (hash -> number from 1; 0: not there)."""

    def __init__(self, vocabulary: dict[int, int] | None = None):
        self.known = np.array(sorted(vocabulary or {}), U64)
        self.number = np.array([(vocabulary or {})[h] for h in self.known.tolist()], np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known >> U64(44)] = True
        self.powers, self.inverse = np.zeros(0, U64), np.zeros(0, U64)

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers, self.inverse = (np.multiply.accumulate(np.r_[U64(1), np.full(n - 1, x, U64)]) for x in (BASE, pow(BASE, -1, 1 << 64)))

    def hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word of lower-cased data begins, its hash as stripped, and whether anything is left of it.

        A hash is the sum of the bytes' numbers times powers of BASE from the word's
        begin: running sums over the text, less their value there, times the inverse power.
        """
        x = np.frombuffer(data, np.uint8)
        kind = KINDS[x]
        run = np.flatnonzero(np.r_[len(x) > 0, kind[1:] != kind[:-1]])
        stop, what = np.r_[run[1:], len(x)][: len(run)], kind[run]
        word = np.r_[False, what != BLANK, False]
        begin, end = run[word[1:-1] & ~word[:-2]], stop[word[1:-1] & ~word[2:]]
        start, inner = begin.copy(), what == INNER
        left, right = np.flatnonzero(kind[start] == EDGE), np.flatnonzero(kind[end - 1] == EDGE)
        start[left] = np.minimum(np.r_[run[inner], len(x)][np.searchsorted(run[inner], start[left])], end[left])
        end[right] = np.maximum(np.r_[0, stop[inner]][np.searchsorted(stop[inner], end[right], "right")], start[right])
        out = np.empty(len(start), U64)
        cuts = np.searchsorted(begin, np.arange(0, len(x) + SLICE, SLICE)).tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            first, last = int(begin[lo]), int(end[lo:hi].max())
            self.reach(last - first + 1)
            sums = np.zeros(last - first + 1, U64)
            np.cumsum(LETTERS[x[first:last]] * self.powers[: last - first], out=sums[1:])
            s = start[lo:hi] - first
            out[lo:hi] = mix64((sums[end[lo:hi] - first] - sums[s]) * self.inverse[s])
        return begin, out, start < end

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash in the vocabulary."""
        out = np.zeros(len(h), np.int32)
        at = np.flatnonzero(self.maybe[h >> U64(44)])
        place = np.searchsorted(self.known, h[at])
        there = place < len(self.known)
        at, place = at[there], place[there]
        same = self.known[place] == h[at]
        out[at[same]] = self.number[place[same]]
        return out


def terms_of(h: np.ndarray) -> np.ndarray:
    return (h % U64(BUCKETS)).astype(np.int64)


def padded(texts: list[str | None | list[bytes]], terms: Terms, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of texts (or of their words) laid end to end, each filled up to a whole number of steps with BUCKETS; where each begins, its words, and the words' numbers."""
    data = [b" ".join(t) if isinstance(t, list) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin, h, some = terms.hashes(b" ".join(data).lower())
    bounds = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in data)]))
    words = np.diff(bounds)
    sizes = -(-words // step) * step
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(h)) + np.repeat(starts - bounds[:-1], words)
    flat, number = np.full(int(sizes.sum()), BUCKETS, np.int64), np.zeros(int(sizes.sum()), np.int32)
    # signs alone are filling
    flat[at] = np.where(some, terms_of(h), BUCKETS)
    number[at[some]] = terms.numbers(h[some])
    return flat, starts, words, number


def rows_of(flat: np.ndarray) -> np.ndarray:
    """Passages with each term once, others made BUCKETS."""
    rows = np.sort(flat.reshape(-1, WIDTH), axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = BUCKETS
    return rows


def summed(parts: DataFrame) -> np.ndarray:
    """Sums of arrays packed in RANGES parts; the driver gets one array."""

    def run(t: pa.Table) -> pa.Table:
        total = sum(unpack(x)[0].astype(np.float64) for x in t.column("blob").to_pylist())
        return pa.table({"shard": t.column("shard")[:1], "blob": pa.array([pack(total)], pa.binary())})

    found = {r["shard"]: unpack(r["blob"])[0] for r in parts.groupBy("shard").applyInArrow(run, PACKED).collect()}
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(0)


def parted(array: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([pack(x) for x in np.split(array.reshape(-1), RANGES)], pa.binary())], ["shard", "blob"])


PLACES = mix64(np.arange(1, WIDTH + 1, dtype=U64)) | U64(1)


def distinct(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages and keys with each key once."""
    key, at = np.unique(key, return_index=True)
    return rows[at], key


def distinct_passages(docs: DataFrame) -> DataFrame:
    """The distinct passages of all documents, one packed array of terms a shard, in the shared folder."""
    n_shards = 2 * partitions(docs.sparkSession)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for (texts,) in text_chunks(batches, ["text"]):
            rows = rows_of(padded(texts, terms, WIDTH)[0])
            rows, key = distinct(rows.astype(np.uint16), mix64((mix64(rows.astype(U64)) * PLACES).sum(1, dtype=U64)))
            blobs = {s: pack(key[i], rows[i].reshape(-1)) for s, i in by_shard(key % U64(n_shards), n_shards)}
            yield pa.RecordBatch.from_arrays([pa.array(list(blobs), pa.int32()), pa.array(list(blobs.values()), pa.binary())], ["shard", "blob"])

    def once(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in t.column("blob").to_pylist()]
        rows, _ = distinct(np.concatenate([r for _, r in parts]).reshape(-1, WIDTH), np.concatenate([k for k, _ in parts]))
        return pa.table({"shard": t.column("shard")[:1], "blob": pa.array([pack(rows.reshape(-1))], pa.binary())})

    return keep(docs.select("text").mapInArrow(passages, PACKED).groupBy("shard").applyInArrow(once, PACKED), "passages")


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The passages of each shard of `distinct_passages`."""
    for batch in batches:
        for blob in batch.column(1):
            yield unpack(blob.as_py())[0].reshape(-1, WIDTH)


def weights(passages: DataFrame) -> np.ndarray:
    """Inverse document frequency of each term over all distinct passages, always above 0; 0 for filling."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in shards_of(batches):
            df = np.bincount(rows.reshape(-1), minlength=BUCKETS + 1)
            df[BUCKETS] = len(rows)
            yield parted(np.r_[df, np.zeros(RANGES - 1, np.int64)])

    total = summed(passages.mapInArrow(count, PACKED))
    if not len(total):
        return np.zeros(BUCKETS + 1)
    df, n = total[:BUCKETS], total[BUCKETS]
    return np.r_[np.log((n + 2) / (df + 1)), 0.0]


def latent(passages: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Term vectors: right singular vectors of all distinct passages over singular values, times idf, float32 (BUCKETS + 1, rank)."""
    omega = np.random.default_rng(SEED).normal(size=(BUCKETS + 1, RANK)).astype(np.float32)
    omega[BUCKETS] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((RANK, BUCKETS + 1))
        for rows in shards_of(batches):
            for i in range(0, len(rows), 2048):
                r = rows[i : i + 2048].astype(np.int64)
                a = idf[r]
                a /= np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-9)
                y = np.einsum("nk,nkr->nr", a, omega[r])
                for c in range(RANK):
                    g[c] += np.bincount(r.reshape(-1), (a * y[:, c, None]).reshape(-1), BUCKETS + 1)
        yield parted(g[:, :BUCKETS])

    total = summed(passages.mapInArrow(run, PACKED))
    g = total.reshape(RANK, BUCKETS).T if len(total) else np.zeros((BUCKETS, RANK))
    core = omega[:BUCKETS].astype(float).T @ g
    value, vector = np.linalg.eigh((core + core.T) / 2)
    some = value > max(value.max(), 1e-12) * 1e-6
    if not some.any():
        return (idf[:, None] * omega).astype(np.float32)
    v, s, _ = np.linalg.svd(g @ (vector[:, some] / np.sqrt(value[some])), full_matrices=False)
    s = np.maximum(s, s[0] * 1e-3)
    return (idf[:, None] * np.r_[v / s, np.zeros((1, len(s)))]).astype(np.float32)


def lcs(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        if m := at.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


class Index:
    """A block of benchmark items: their passages' vectors, and the search."""

    def __init__(self, items: list[tuple[int, str]], vectors: np.ndarray, idf: np.ndarray):
        self.vectors = vectors
        self.items = [(i, w) for i, t in items if (w := tokens(t))]
        hashed = Terms()
        hashes = [hashed.hashes(b" ".join(w))[1] for _, w in self.items]
        term = [terms_of(h) for h in hashes]
        self.terms = [set(t.tolist()) for t in term]
        self.merged = [len(set(w)) - len(t) for (_, w), t in zip(self.items, self.terms)]
        found, own = [], []
        for k, (_, w) in enumerate(self.items):
            if len(w) < LEAST:
                continue
            x = vectors[term[k]]
            last = max(0, len(w) - WIDTH)
            for i in {*range(0, last + 1, ITEM_STEP), last}:
                found.append(x[i : i + WIDTH].sum(0))
                own.append(k)
        m = np.array(found, np.float32).reshape(len(found), vectors.shape[1])
        self.matrix = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).T
        self.own = np.array(own, np.int64)
        self.vocabulary: dict[int, int] = {}
        self.need = np.ones(len(self.items), np.int64)
        postings: list[list[int]] = [[]]
        for k, (_, w) in enumerate(self.items):
            own_hash = dict(zip(w, hashes[k].tolist()))
            rarest = [own_hash[y] for y in sorted(own_hash, key=lambda y: (-idf[own_hash[y] % BUCKETS], y))]
            least = math.ceil(PARAPHRASE * len(rarest)) if len(w) >= LEAST else len(rarest)
            self.need[k] = max(1, least // 3) if len(w) >= LEAST else 1
            for y in rarest[: len(rarest) - least + int(self.need[k])]:
                if self.vocabulary.setdefault(y, len(postings)) == len(postings):
                    postings.append([])
                postings[self.vocabulary[y]].append(k)
        self.fan = np.array([len(p) for p in postings])
        self.first = np.cumsum(self.fan) - self.fan
        self.posting = np.array([k for p in postings for k in p], np.uint16)  # BLOCK items at most
        self.size = np.array([len(w) for _, w in self.items], np.int64)

    def passages(self, flat: np.ndarray) -> np.ndarray:
        """Vectors of the passages that begin at each step."""
        ones = np.ones((1, STEP), np.float32)
        steps = np.concatenate([np.matmul(ones, self.vectors[flat[i : i + (1 << 11)]].reshape(-1, STEP, self.vectors.shape[1]))[:, 0] for i in range(0, len(flat), 1 << 11)])
        steps[:-1] += steps[1:]
        return steps / np.maximum(np.linalg.norm(steps, axis=1, keepdims=True), 1e-9)

    def near(self, steps: np.ndarray) -> np.ndarray:
        """step * items + item where a passage is near one of an item's by cosine."""
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(steps) if len(self.own) else 0, 2048):
            cosine = steps[i : i + 2048] @ self.matrix
            some = np.flatnonzero(cosine.max(1) >= COSINE)
            r, c = np.nonzero(cosine[some] >= COSINE)
            out.append((some[r] + i) * len(self.items) + self.own[c])
        return np.concatenate(out)

    def sharing(self, number: np.ndarray) -> np.ndarray:
        """step * items + item where words with these numbers hold `need` of an item's rarest."""
        at = np.flatnonzero(number)
        fan = self.fan[number[at]]
        pos = np.repeat(at, fan)
        item = self.posting[np.repeat(self.first[number[at]] - (np.cumsum(fan) - fan), fan) + np.arange(len(pos))]
        order = np.argsort(item, kind="stable")
        pos, item = pos[order], item[order]
        last = np.arange(len(pos)) + self.need[item] - 1
        here = np.flatnonzero(last < len(pos))
        last = last[here]
        same = item[last] == item[here]
        here, last = here[same], last[same]
        item, start, end = item[here].astype(np.int64), pos[here], pos[last]
        close = end - start < 2 * self.size[item] + WIDTH
        item, start, end = item[close], start[close], end[close]
        # every step whose words around (see search) hold them all
        low = np.maximum(-(-(end - self.size[item] - WIDTH + 1) // STEP), 0)
        many = np.minimum((start + self.size[item]) // STEP, (len(number) - 1) // STEP) - low + 1
        some = many > 0
        item, low, many = item[some], low[some], many[some]
        step = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return step * len(self.items) + np.repeat(item, many)

    def search(self, texts: list[str | None], terms: Terms) -> list[list[dict]]:
        """Leaks of each text, best alignment of each item."""
        found: list[dict[int, dict]] = [{} for _ in texts]
        flat, starts, size, number = padded(texts, terms, STEP)
        if not self.items or not len(flat):
            return [[] for _ in texts]
        steps = self.passages(flat)
        pair = np.unique(np.concatenate([self.near(steps), self.sharing(number)]))
        if len(pair):
            step, item = np.divmod(pair, len(self.items))
            full = np.flatnonzero(size)
            cut = (-1, [])
            doc = full[np.searchsorted(starts[full], step * STEP, "right") - 1]
            for s, k, d in zip(step.tolist(), item.tolist(), doc.tolist()):
                number, words = self.items[k]
                at = s * STEP - int(starts[d])
                lo = max(0, at - len(words))
                hi = min(int(size[d]), at + WIDTH + len(words))
                # terms first: words of one term count as one, so this lets through all that words would
                near = self.terms[k].intersection(flat[starts[d] + lo : starts[d] + hi].tolist())
                if len(near) < PARAPHRASE * len(self.terms[k]) - self.merged[k]:
                    continue
                if cut[0] != d:
                    cut = d, raw_words(texts[d])
                around = stripped(cut[1][lo:hi])
                distinct = set(words)
                if len(distinct.intersection(around)) < PARAPHRASE * len(distinct):
                    continue
                if len(words) < LEAST:
                    if any(around[j : j + len(words)] == words for j in range(len(around) - len(words) + 1)):
                        found[d][k] = {"item_id": number, "common": len(words), "item_words": len(words), "cosine": None, "first_word": lo}
                    continue
                n = lcs(words, around)
                if n < PARAPHRASE * len(words):
                    continue
                answer = words[-max(4, len(words) // 4) :]
                if n >= COPY * len(words) or lcs(answer, around) >= ANSWER * len(answer):
                    if n > found[d].get(k, {"common": 0})["common"]:
                        cosine = float((steps[s] @ self.matrix[:, self.own == k]).max())
                        found[d][k] = {"item_id": number, "common": n, "item_words": len(words), "cosine": cosine, "first_word": lo}
        return [sorted(f.values(), key=lambda x: (x["item_id"] is None, x["item_id"])) for f in found]


LEAK = "array<struct<item_id:long,common:long,item_words:long,cosine:double,first_word:long>>"


def searcher(index):
    """A column function: the leaks of a text, by an index sent to all tasks (pickled by value, so that workers need no package)."""

    @F.pandas_udf(LEAK)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pickle.loads(index.value)
        terms = Terms(own.vocabulary)
        for s in batches:
            got, chunk, size = [], [], 0
            for t in s.tolist():
                chunk.append(t)
                size += len(t or "")
                if size > 1_000_000:
                    got += own.search(chunk, terms)
                    chunk, size = [], 0
            got += own.search(chunk, terms) if chunk else []
            yield pd.Series(got, dtype=object)

    return of


def in_blocks(benchmark: DataFrame) -> DataFrame:
    """Distinct items (item_id, text) in order, with the block that each is in: BLOCK items and BLOCK_BYTES of text a block at most, or one longer item.

    A block is what the driver holds and all tasks get. Places are running sums within
    ranges of the order; the driver gets one number a range, and one a block.
    """
    cost = F.greatest(F.lit(BLOCK_BYTES // BLOCK), F.octet_length("text")).cast("long")
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    rows = keep(rows.select("item_id", "text", F.spark_partition_id().alias("part"), cost.alias("cost")), "items")
    sums = sorted((r["part"], r["cost"]) for r in rows.groupBy("part").agg(F.sum("cost").alias("cost")).collect())
    before = benchmark.sparkSession.createDataFrame([(part, sum(c for _, c in sums[:i])) for i, (part, _) in enumerate(sums)], "part int, before long")
    running = F.sum("cost").over(Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    # an item whose text is longer than what a block may hold begins one and ends it
    start = F.col("before") + F.coalesce(running, F.lit(0))
    placed = keep(rows.join(F.broadcast(before), "part").select("item_id", "text", F.floor(start / BLOCK_BYTES).cast("long").alias("block")), "items")
    discard(rows)
    return placed


def leaks(docs: DataFrame, benchmark: DataFrame, out: str = "leaks") -> DataFrame:
    """All columns of docs and what each document's text holds of the benchmark."""
    spark = docs.sparkSession
    passages = distinct_passages(docs)
    idf = weights(passages)
    vectors = latent(passages, idf)
    discard(passages)
    items = in_blocks(benchmark)
    blocks = [r["block"] for r in items.select("block").distinct().orderBy("block").collect()]

    def search(b: int):
        part = items.where(F.col("block") == b).orderBy("item_id", "text")
        index = Index([(r["item_id"], r["text"]) for r in part.collect()], vectors, idf)
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))
        return sent, searcher(sent)(F.coalesce("text", F.lit("")))

    if len(blocks) <= 1:
        return docs.withColumn(out, search(blocks[0] if blocks else 0)[1])
    mark, found = free(docs, "_mark"), []
    for b in blocks:
        sent, column = search(b)
        found.append(keep(docs.select(F.xxhash64("text").alias(mark), column.alias("x")).where(F.size("x") > 0).dropDuplicates([mark]), "leaks"))
        sent.unpersist()
    every = functools.reduce(DataFrame.union, found).groupBy(mark).agg(F.array_sort(F.flatten(F.collect_list("x"))).alias(out))
    none = F.array().cast(LEAK)
    return docs.withColumn(mark, F.xxhash64("text")).join(every, mark, "left").withColumn(out, F.coalesce(out, none)).drop(mark)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and leaked item."""
    found = leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
