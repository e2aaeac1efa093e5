"""Language identification by bit-sliced Bloom filters of n-grams.

A text's n-grams are the runs of two to four letters of its words, lower-cased,
with the words' ends counting as a letter. A language contains an n-gram that
makes up at least one in RARE of its n-grams of that length in the documents that
are learnt from, so a language has RARE n-grams of a length at most, however large the
corpus. All languages' Bloom filters have the same hash functions and lie in one
table with a slot's bits side by side, one for each language: the slots of an n-gram,
anded, are the set of all languages that contain it.

A text's score for a language is the number of its n-grams (with repeats) that the
language contains, less those that its filter would let pass by chance: a filter
with a share f of its bits set passes f^HASHES of what it doesn't hold. The
language of the most n-grams wins, and of equal ones the first by name. Its
probability is its share of the two best.

A text that is null or has no letter is `und`, with a score of 0; so is every text
where nothing could be learnt. A text without any n-gram that a language contains is
given the language with the most n-grams, with a score of 0. Rows with a null lang
aren't learnt from. A null doc_id isn't held out. Repeated rows count
as often as they occur. Columns besides doc_id, text and lang are carried along.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIX, U64, discard, free, keep, mix64, text_chunks

ORDERS = (2, 3, 4)
RARE = 50_000
#: Slots of the table (a power of two of 21 bits at most, so that a hash has HASHES of them); a slot has 64 bits for each 64 languages.
BITS, HASHES = 21, 3
#: The table has 16 MB for each 64 languages, and is sent to all tasks.
MOST_LANGUAGES = 1024
#: Counts that a task holds before it merges equal ones, and distinct ones that it holds before it hands them on.
HELD, MOST_HELD = 2_000_000, 4_000_000
UNKNOWN = "und"


def letters() -> Callable[[np.ndarray], np.ndarray]:
    """Which code points are letters; a table for the first 65,536, and one look at each other one."""
    low = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)

    def of(points: np.ndarray) -> np.ndarray:
        found = low[np.minimum(points, 0xFFFF)]
        high = np.flatnonzero(points > 0xFFFF)
        if len(high):
            each, which = np.unique(points[high], return_inverse=True)
            found[high] = np.array([chr(c).isalpha() for c in each.tolist()])[which]
        return found

    return of


def grams(texts: list[str], is_letter: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order, hashes of all n-grams of texts and the text that each is of."""
    parts = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"\0\0\0\0".join([b"", *parts, b""]), np.uint32)
    doc = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), [1, *(len(p) // 4 + 1 for p in parts)]) - 1
    s = np.where(is_letter(points), points, 0)
    kept = np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]
    s, doc = s[kept].astype(U64), doc[kept]
    inner = s != 0
    of = np.where(inner[:-1], doc[:-1], doc[1:])  # an end of a word is the text's before it
    for n in ORDERS:
        m = len(s) - n + 1
        if m <= 0:
            continue
        ok = inner[1:m + 1].copy() if n > 2 else np.ones(m, bool)
        for i in range(2, n - 1):
            ok &= inner[i : m + i]
        at = np.flatnonzero(ok)
        h = s[at]
        for i in range(1, n):
            h = h * U64(MIX[0]) + s[at + i]
        yield n, mix64(h * U64(MIX[1]) + U64(n)), of[at]


def counted(docs: DataFrame) -> DataFrame:
    """(lang, size, gram, n) of documents (text, lang), counted a task; gram is null for the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, held, size = letters(), {}, 0

        def merged(key: tuple[str, int]) -> int:
            """Counts of equal n-grams added up; how many are left."""
            h, n = (np.concatenate(x) for x in zip(*held[key]))
            order = np.argsort(h)
            h, n = h[order], n[order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            held[key] = [(h[starts], np.add.reduceat(n, starts))]
            return len(starts)

        def out() -> Iterator[pa.RecordBatch]:
            for key in list(held):
                merged(key)
                ((h, n),) = held.pop(key)
                gram = pa.concat_arrays([pa.array(h.view(np.int64)), pa.nulls(1, pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(gram)), pa.array(np.full(len(gram), key[1], np.int32)), gram, pa.array(np.r_[n, n.sum()])], ["lang", "size", "gram", "n"])

        for texts, langs in text_chunks(batches, ["text", "lang"]):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(texts, langs):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                for order, h, _ in grams(own, is_letter):
                    if len(h):
                        h, n = np.unique(h, return_counts=True)
                        held.setdefault((lang, order), []).append((h, n))
                        size += len(h)
            if size > HELD:
                size = sum(map(merged, list(held)))
                if size > MOST_HELD // 2:
                    yield from out()
                    size = 0
        yield from out()

    return docs.mapInArrow(run, "lang string, size int, gram long, n long")


class Filters:
    """All languages' Bloom filters: table[slot] has a bit for each language."""

    def __init__(self, langs: list[str], slots: np.ndarray, masks: np.ndarray, common: int):
        self.langs, self.common = langs, common
        self.table = np.zeros((1 << BITS, masks.shape[1]), U64)
        self.table[slots] = masks
        fill = np.array([(masks[:, i // 64] >> U64(i % 64) & U64(1)).sum() for i in range(len(langs))]) / (1 << BITS)
        self.by_chance = fill**HASHES

    def containing(self, h: np.ndarray) -> np.ndarray:
        """The set of languages that contain each n-gram, as bits."""
        found = self.table[h & U64((1 << BITS) - 1)]
        for i in range(1, HASHES):
            found &= self.table[(h >> U64(i * BITS)) & U64((1 << BITS) - 1)]
        return found

    def counts(self, texts: list[str], is_letter: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Of each text, how many n-grams each language contains, corrected for chance; at least 0."""
        hits, total = np.zeros((len(self.langs), len(texts))), np.zeros(len(texts))
        for _, h, doc in grams(texts, is_letter):
            total += np.bincount(doc, minlength=len(texts))
            found = self.containing(h)
            for i in range(len(self.langs)):
                hits[i] += np.bincount(doc[(found[:, i // 64] >> U64(i % 64) & U64(1)).view(np.int64) == 1], minlength=len(texts))
        chance = self.by_chance[:, None]
        return np.maximum(0, (hits - total * chance) / (1 - chance)).T

    def decide(self, texts: list[str], is_letter: Callable[[np.ndarray], np.ndarray]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        lettered = np.array([any(map(str.isalpha, t)) for t in texts])
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        counts = self.counts(texts, is_letter)
        first = counts.argmax(1)
        top = counts[np.arange(len(texts)), first]
        both = np.sort(counts, axis=1)[:, -2:].sum(1)
        score = np.where(lettered & (top > 0), top / np.maximum(both, 1e-9), 0.0)
        first = np.where(top > 0, first, self.common)
        return [self.langs[i] if y else UNKNOWN for i, y in zip(first.tolist(), lettered.tolist())], score


def fit(docs: DataFrame) -> Filters:
    """The filters of documents (text, lang), without nulls."""
    parts = keep(counted(docs), "grams")
    total = parts.where("gram is null").groupBy("lang", "size").agg(F.sum("n").alias("total"))
    langs = sorted(r["lang"] for r in total.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not langs:
        discard(parts)
        return Filters([], np.zeros(0, np.int64), np.zeros((0, 1), U64), 0)
    # a row for each language and order
    sums = {(r["lang"], r["size"]): r["total"] for r in total.collect()}
    common = int(np.argmax([sum(sums.get((x, n), 0) for n in ORDERS) for x in langs]))
    bits = {lang: i for i, lang in enumerate(langs)}
    least = docs.sparkSession.createDataFrame(
        [(lang, size, bits[lang] // 64, int(U64(1 << bits[lang] % 64).view(np.int64)), -(-n // RARE)) for (lang, size), n in sums.items()], "lang string, size int, word int, mask long, least long"
    )
    contained = parts.where("gram is not null").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).join(F.broadcast(least), ["lang", "size"]).where("n >= least")
    slot = F.explode(F.array(*[F.shiftrightunsigned("gram", i * BITS).bitwiseAND((1 << BITS) - 1) for i in range(HASHES)]))
    set_bits = contained.select(slot.alias("slot"), "word", "mask").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    # a slot's bits, and 2 ** BITS slots at most
    rows = set_bits.toArrow()
    discard(parts)
    slots, at = np.unique(rows.column("slot").to_numpy(), return_inverse=True)
    masks = np.zeros((len(slots), -(-len(langs) // 64)), U64)
    masks[at, rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(U64)
    return Filters(langs, slots, masks, common)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learnt from: a quarter of them."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predicted(docs: DataFrame, filters: Filters, out: str = "language") -> DataFrame:
    """All columns of docs and a struct (lang, score)."""
    # by value, since workers need not have this package
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(filters))

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        is_letter, own = letters(), pickle.loads(sent.value)
        for s in batches:
            langs, scores = [], [np.zeros(0)]
            for (texts,) in text_chunks(iter([pa.RecordBatch.from_arrays([pa.array(s, pa.string())], ["text"])]), ["text"], 1_000_000):
                lang, score = own.decide(texts, is_letter)
                langs += lang
                scores.append(score)
            yield pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": np.concatenate(scores)})

    return docs.withColumn(out, of(F.coalesce("text", F.lit(""))))


def identify(docs: DataFrame, out: str = "language") -> DataFrame:
    """All columns of docs and a struct (lang, score), learnt from the documents with a lang that aren't held out."""
    learnt = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang")
    return predicted(docs, fit(learnt), out)


def judged(docs: DataFrame, language: str = "language") -> DataFrame:
    at = free(docs, "held_out")
    return docs.withColumn(at, held_out()).select("doc_id", F.col(at).alias("held_out"), F.col(f"{language}.lang").alias("lang_pred"), F.col(f"{language}.score").alias("score"))
