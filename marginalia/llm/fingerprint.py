"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ascending array of the k smallest distinct 48-bit hashes of a
text's five-word shingles (a text of fewer words is one shingle; a text without
words has an empty sketch). The sketch of a text in parts is `merge` of the
parts' sketches. Where a text has fewer than k distinct shingles, its sketch
holds them all and the estimates are exact.

Nulls: a null text counts as empty. Two empty sketches are alike (1.0), an
empty and another are not (0.0). A null doc_id sorts last. Rows that share a
doc_id are ordered by a hash of their text. Columns besides doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Hashes, mix64, shingles, text_chunks, words

WORDS = 5
K = 128
BITS = 48
#: Characters of text that one part of the ordered pass holds, about.
PART_CHARS = 8_000_000
#: Parts at most, since the driver holds a bound for each; beyond it they grow, and Spark sorts and streams them from disk.
MOST_PARTS = 20_000


def sketch(text: str | None, hashes: Hashes, k: int = K, width: int = WORDS) -> np.ndarray:
    s = shingles(hashes.of(words(text)), width)
    return np.unique(mix64(s) >> U64(64 - BITS))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of both shingle sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the Jaccard similarity: the share of the union's sketch that is in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right") / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * distinct(merge(a, b, k), k) / distinct(a, k)) if len(b) else 0.0


def encode(a: np.ndarray) -> str:
    return a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes().hex()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BITS // 8 :] = raw
    return wide.reshape(-1).view(">u8").astype(U64)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of docs and the encoded sketch of a text column."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = Hashes()
        for s in batches:
            yield s.map(lambda x: encode(sketch(x, hashes)), na_action=None)

    return docs.withColumn(out, of(F.col(text)))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text dealt into ranges of (doc_id, hash of text), sorted; own is false for a row that only follows a range's last.

    Bounds are quantiles of doc_id. An id that fills several of them, and the rows
    without id, are cut further, by the hash. Each range ends with a copy of the next
    one's first row (the last with the very first), so a task sees every row's
    successor. The driver gets one row a range: its first doc_id and hash.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    chars = F.length("text").cast("long")
    total, bare = rows.agg(F.sum(chars), F.sum(F.when(F.col("doc_id").isNull(), chars))).first()
    n = min(MOST_PARTS, max(1, math.ceil((total or 0) / PART_CHARS)))
    found = rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    often = {b: c + 1 for b, c in Counter(found).items() if c > 1}
    splits = [-math.inf, *(sorted({*found, *often, *(b + 1 for b in often)}) or [0.0]), math.inf]
    # ranges of each bucket of ids; the last bucket is that of rows without id
    cuts = [*(often.get(b, 1) for b in splits[:-1]), max(1, math.ceil((bare or 0) / PART_CHARS))]
    first = [0, *itertools.accumulate(cuts)]
    ranges = F.broadcast(spark.createDataFrame(list(zip(range(len(cuts)), cuts, first)), "bucket int, cuts int, from int"))

    def dealt(df: DataFrame) -> DataFrame:
        d = df.withColumn("at", F.col("doc_id").cast("double"))
        d = Bucketizer(splits=splits, inputCol="at", outputCol="p", handleInvalid="keep").transform(d)
        bucket = F.when(F.col("doc_id").isNull(), len(cuts) - 1).otherwise(F.col("p").cast("int"))
        # the hash's place in its range of 2^64, in as many steps as the bucket has ranges
        within = F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("cuts")), F.col("cuts") - 1)
        return d.withColumn("bucket", bucket).join(ranges, "bucket").withColumn("part", (F.col("from") + within).cast("int")).drop("at", "p", *ranges.columns)

    firsts = sorted((r["part"], r["first"]) for r in dealt(rows).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("first")).collect())
    before = [(firsts[i - 1][0], part, x["doc_id"], x["tie"]) for i, (part, x) in enumerate(firsts)]
    ends = spark.createDataFrame(before, "into int, part int, first long, first_tie long")
    own = dealt(rows).withColumn("own", F.lit(True))
    # only the first rows come back here, one of those alike a range, so the join's small side is the number of ranges
    extra = dealt(rows).join(F.broadcast(ends), "part").where(F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("tie") == F.col("first_tie")))
    extra = extra.dropDuplicates(["part"]).select("doc_id", "text", "tie", F.col("into").alias("part"), F.lit(False).alias("own"))
    # the number of a range is its partition: a hash of it would put several in one
    return own.unionByName(extra).repartitionById(first[-1], F.col("part")).sortWithinPartitions("part", F.desc("own"), F.asc_nulls_last("doc_id"), "tie")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, kept_share double"


def edited_against_next(docs: DataFrame) -> DataFrame:
    """Each document's sketch, the sketch of the text with its last quarter replaced by the next document's
    beginning, and their likeness; kept_share is the estimated containment of the text in its edited form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, done = Hashes(), None, False
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
        for texts, ids, parts, owns in text_chunks(batches, ["text", "doc_id", "part", "own"]):
            out = []
            for text, doc, part, own in zip(texts, ids, parts, owns):
                if last is not None and last[0] != part:
                    last = None
                if last is not None:
                    _, before, before_text, a = last
                    cut = len(before_text) // 4
                    edited = before_text[: len(before_text) - cut] + text[:cut]
                    b = a if edited == before_text else sketch(edited, hashes)
                    c = sketch(text, hashes)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, len(before_text), sha, encode(a), encode(b), resemblance(a, b), resemblance(a, c), distinct(a), containment(a, b)))
                    last = (part, doc, text, c) if own else None
                elif own:
                    last = (part, doc, text, sketch(text, hashes))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names)

    return in_order(docs).mapInArrow(run, SCHEMA)
