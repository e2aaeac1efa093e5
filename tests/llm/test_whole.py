"""Rows that skew, repeat or lack ids: nothing is lost and nothing else goes."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, lines
from marginalia.llm.common import table, unpack

SF = "/root/testdata/sf0.001"


def test_leak_in_a_third_of_rows(spark):
    """A leak that is copied widely is found in each copy."""
    docs, benchmark = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "benchmark")
    item = benchmark.orderBy("item_id").first()
    rows = [(10**6 + i, item["text"]) for i in range(docs.count() // 2)]
    found = decontaminate.contaminated(docs.union(spark.createDataFrame(rows, docs.schema)), benchmark)
    assert {r["doc_id"] for r in found.where((F.col("doc_id") >= 10**6) & (F.col("item_id") == item["item_id"])).collect()} == {i for i, _ in rows}


def test_leak_far_below_the_gate(spark):
    """Copies of which 62 to 80 % is left, of short and long items, amid other text, where the fit reads few documents."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rng = random.Random(8)
    plain = [w for r in docs.collect() if len(w := r["text"].split()) > 150]
    items = [(k, [rng.choice(rng.choice(plain)) + f"q{rng.randrange(40)}" if rng.random() < 0.5 else rng.choice(rng.choice(plain)[:80]) for _ in range((6, 9, 15, 24, 40)[k % 5])]) for k in range(40)]
    rows, want = [], set()
    for i, (k, w) in enumerate(items * 5):
        w = list(w)
        keep = len(w) if len(w) < 15 else int(len(w) * rng.uniform(0.64, 0.8))
        for j in rng.sample(range(len(w) - max(4, len(w) // 4)), len(w) - keep):
            w[j] = f"other{rng.randrange(10**6)}"
        around = rng.choice(plain)[:120]
        cut = rng.randrange(len(around))
        rows.append((10**6 + i, " ".join([*around[:cut], *w, *around[cut:]])))
        item, left = (decontaminate.tokens(" ".join(x)) for x in (items[k][1], w))
        if decontaminate.lcs(item, left) >= 0.6 * len(item) and len(set(item) & set(left)) >= 0.6 * len(set(item)):
            want.add((10**6 + i, k))
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = decontaminate.contaminated(docs.union(spark.createDataFrame(rows, docs.schema)), benchmark)
    got = {(r["doc_id"], r["item_id"]) for r in found.where(F.col("doc_id") >= 10**6).collect()}
    assert len(want) > 180 and want <= got


def test_many_variants_of_a_line(spark):
    """All lines that differ from the first in one word go, however many there are."""
    n = 30_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("all these words stay but for"), F.lit(" x"), F.col("id"), F.lit(" and so on")).alias("text"))
    assert [r["doc_id"] for r in lines.dedupe_lines(docs).where("lines_removed = 0").collect()] == [0]


@pytest.mark.parametrize("i", [None, 7])
def test_rows_that_share_an_id(spark, i):
    """Lines go from the row that repeats them and no other, and of rows alike in all one keeps its lines."""
    same, other = "a line that an earlier row has", "a line that only one row has"
    rows = [(i, same), (i, other), (1, same), (i, "twice here"), (i, "twice here"), (i, "twice here"), (i, "first\nof one"), (i, "other\nof one"), (i, None), (i, " \n"), (None, "no number")]
    out = lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert out.columns == ["doc_id", "text", "lines_removed"]
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    ends = {(i, "first\nof one"), (i, "other"), (i, "other\nof one"), (i, "first")} & set(got)
    assert len(ends) == 2 and sum("of one" in t for _, t in ends) == 1
    want = [(1, same), (i, ""), (i, other), (i, "twice here"), (i, ""), (i, ""), (i, None), (i, " \n"), (None, "no number"), *ends]
    assert sorted(map(str, got)) == sorted(map(str, want))


def shard_lines(packed):
    """Records of lines in each shard's blobs."""
    out = {}
    for r in packed.collect():
        out[r["shard"]] = out.get(r["shard"], 0) + len(unpack(r["blob"])[0])
    return sorted(out.values())


def test_a_hot_line_is_split(spark):
    """A line that all documents share goes once a chunk to its shard."""
    docs = spark.range(60_000).select(F.col("id").alias("doc"), F.lit(0).cast("long").alias("tie"), F.concat(F.lit("the same line in every document that there is\nown line "), F.xxhash64("id")).alias("text"))
    counts = shard_lines(lines.distinct_lines(docs, 16).where("shard >= 0"))
    assert sum(counts) <= 60_000 + 100 and counts[-1] <= 3 * counts[8]
    gone = lines.duplicates(docs)
    assert gone.where("no = 0").count() == 59_999
    assert gone.where("no = 0 and (with_doc >= doc or with_no <> 0)").isEmpty()


def test_pairs_found_are_distinct(spark):
    """Copies of lines in many chunks don't meet again in the shard of each of their gaps."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("tie"), "text").repartition(12)
    found = lines.partners(lines.emit(lines.distinct_lines(docs, 8), lines.LEAST_WORDS, 8)).cache()
    assert 0 < found.count() <= 1.1 * found.distinct().count()
    found.unpersist()
