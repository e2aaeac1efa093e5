"""Nulls, empty and long texts, ties and repeated rows, empty tables, columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, fingerprint, lines, lm, minhash, packing, quality, secrets, toxicity, urls

LONG = "one two three four five six seven eight nine ten eleven twelve\n" * 3000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from home", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from home", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from home", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, LONG, "en"),
    (None, "A text without a number that has some words in it for a while", None),
    (None, None, None),
    (6, "\n\n \n", "en"),
    (7, "x", "en"),
    (8, "déjà vu 😀 naïve password = \"hunter2hunter2\" ok", "fr"),
]
CLASHING = ("class", "shard", "blob", "score", "part", "own", "line", "doc", "no", "bucket", "_gone", "_score", "text_hash", "label", "signature")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (5, 1, 0), (None, 0, 1), (7, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, ""), (None, "a b")], "item_id long, text string")


def ids(df):
    return sorted(((r["doc_id"]) for r in df.collect()), key=lambda x: (x is None, x))


ALL = [1, 2, 2, 3, 4, 5, 6, 7, 8, None, None]


def test_scores_one_row_each(docs, none, labels):
    for found in (quality.scores(docs, labels), toxicity.scores(docs, labels), lm.score(docs)):
        rows = found.collect()
        assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == ALL
        assert all(r["score"] == r["score"] for r in rows)
    for found in (quality.scores(none, labels), toxicity.scores(none, labels), lm.score(none), quality.scores(docs, labels.where("false")).where("false")):
        assert found.count() == 0


def test_near_duplicates(docs, none):
    rows = minhash.near_duplicates(docs).collect()
    assert ids(minhash.near_duplicates(docs)) == ALL
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[3]["kept"]
    assert minhash.near_duplicates(none).count() == 0


def test_lines(docs, none):
    out = lines.dedupe_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    rows = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert len(ids(out)) == len(ALL)
    assert (1, ROWS[0][1]) in rows and (2, "") in rows and (3, None) in rows and (6, "\n\n \n") in rows
    assert next(t for i, t in rows if i == 5).strip() == LONG.split("\n")[0]
    assert lines.dedupe_lines(none).count() == 0


def test_leaks(docs, none, benchmark):
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()} == {(1, 1), (2, 1)}
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs, length=64, grain=4).collect()
    assert sorted({(r["doc_id"] or -1) for r in rows}) == [-1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert all(0 < r["length"] <= 64 for r in rows)
    assert packing.pack_documents(none).count() == 0


def test_fingerprints(docs, none):
    out = fingerprint.edited_against_next(docs)
    assert ids(out) == ALL
    one = fingerprint.edited_against_next(docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.edited_against_next(none).count() == 0
    assert fingerprint.fingerprints(docs).where("text is null and fingerprint <> ''").count() == 0


def test_secrets(docs, none):
    out = secrets.digest(secrets.secrets(docs))
    assert ids(out) == ALL
    text = ROWS[-1][1]
    assert {r["doc_id"]: r["spans"] for r in out.collect()}[8] == f"assign:{text.index('password')}:{text.index(chr(34) + ' ok')}"
    assert secrets.digest(secrets.secrets(none)).count() == 0


def test_urls(spark, labels):
    pages = spark.createDataFrame([(1, "https://A.Example.com/en/7x?q", "c"), (2, None, "c"), (2, "no scheme", None), (3, "http://x.net", None), (None, "http://b.example.net/de/88#f", None), (4, "ftp://com/en/", None)], "page_id long, url string, host string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages, labels).collect()}
    assert got == {
        (1, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "", "", None, "allow"), (3, "x.net", "", None, "allow"),
        (None, "b.example.net", "/de/88", "example.net/de/8", "block"), (4, "com", "/en/", "com/en/", "block"),
    }
    assert urls.judged(pages.where("false"), labels).count() == 0
    assert urls.judged(pages, labels.where("false")).count() == 6


def page_rows(spark, rows):
    """Pages of (host, path, is bad or None), numbered, and their labels."""
    pages = spark.createDataFrame([(i, f"https://{h}{p}") for i, (h, p, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not bad)) for i, (_, _, bad) in enumerate(rows) if bad is not None], "doc_id long, quality int")
    return pages, labels


def test_url_templates_are_rejected(spark, tmp_path):
    """A bad branch beside good ones, at any depth and however many siblings it has; ids are one wildcard; thin branches are left alone. The SQL says the same."""
    import duckdb

    rows = []
    for k in range(8):  # many sections, one of them bad
        rows += [("many.io", f"/s{k}/{i}", k == 3) for i in range(12)]
    for i in range(12):  # two branches that part at the fifth segment
        rows += [("deep.io", f"/a/b/c/d/bad/{i}", True), ("deep.io", f"/a/b/c/d/good/{i}", False)]
    rows += [("thin.io", "/x/1", True), ("thin.io", "/y/1", False), ("thin.io", "/z/1", None)]
    rows += [("tie.io", f"/t/{i}", i % 2 == 0) for i in range(10)]
    rows += [("none.io", "", None), ("none.io", "/", None), ("none.io", "//q//", None), ("none.io", "/" + "/".join("abcdefghijklmnop"), None)]
    rows += [("fill.io", f"/{i}", False) for i in range(200)]
    pages, labels = page_rows(spark, rows)
    found = urls.judged(pages, labels).orderBy("page_id").collect()
    said = {(r["host"], r["path"]): (r["template"], r["verdict"]) for r in found}
    assert said["many.io", "/s3/5"] == ("/s3/*", "block") and said["many.io", "/s4/5"] == ("/*/*", "allow")
    assert said["deep.io", "/a/b/c/d/bad/7"] == ("/a/b/c/d/bad/*", "block") and said["deep.io", "/a/b/c/d/good/7"] == ("/a/b/c/d/good/*", "allow")
    assert [said["thin.io", p] for p in ("/x/1", "/y/1", "/z/1")] == [("/x/1", "allow"), ("/y/1", "allow"), ("/z/1", "allow")]
    assert said["none.io", "/a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p"][0] == "/a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p"
    assert said["none.io", ""][0] == said["none.io", "/"][0] == "" and said["none.io", "//q//"][0] == "/q"
    bad = {p for (h, p), (_, v) in said.items() if v == "block"}
    assert all("/s3/" in p or "/bad/" in p for p in bad)
    con = duckdb.connect()
    for name, df in (("pages", pages), ("labels", labels)):
        df.write.parquet(str(tmp_path / name))
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    told = {(r[0], r[1]): r[2:] for r in con.execute(f"select page_id, host, path, rule, verdict, template, bad_share from ({urls.oracle()})").fetchall()}
    assert told == {(r["page_id"], r["host"]): (r["path"], r["rule"], r["verdict"], r["template"], r["bad_share"]) for r in found}


def test_smoothed_share_at_the_bound(spark):
    """A template whose smoothed share is just REJECT goes."""
    share = 0.5  # as many bad as good overall, so smoothing leaves one half as it is
    rows = [("a.io", f"/x/{i}", i % 2 == 0) for i in range(20)]
    pages, labels = page_rows(spark, rows)
    got = urls.judged(pages, labels).select("template", "verdict", "bad_share").distinct().collect()
    assert [tuple(r) for r in got] == [("/x/*", "block", share)]


def test_short_items_and_blocks(spark, monkeypatch):
    """Items of one to five words leak where they stand in a row; blocks of the benchmark give what one search gives."""
    docs = spark.createDataFrame(
        [(1, "some words then Alpha, beta gamma! and more"), (2, "alpha then beta gamma"), (3, "zeta"), (4, None), (5, "zetas"), (None, "x zeta y alpha beta gamma")], "doc_id long, text string"
    )
    items = [(10, "alpha beta gamma"), (11, "Zeta."), (12, "..."), (None, "beta gamma")]
    items += [(20 + i, " ".join(f"word{i}n{j}" for j in range(12))) for i in range(9)]
    docs = docs.union(spark.createDataFrame([(100 + i, "before " + t + " after") for i, t in items[4:]], docs.schema))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 10), (1, None), (2, None), (3, 11), (None, 10), (None, 11), (None, None)} | {(100 + i, i) for i, _ in items[4:]}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    found = decontaminate.leaks(docs, benchmark)
    assert found.count() == docs.count()
    assert {(r["doc_id"], x["item_id"]) for r in found.collect() for x in r["leaks"]} == want


def test_repeated_items_and_bytes_of_a_block(spark, monkeypatch):
    """Rows of the benchmark that are alike are one item; blocks have no more items, and no more bytes, than they may."""
    alike = spark.range(70_000).select(F.lit(7).cast("long").alias("item_id"), F.lit("quick brown fox jumps over the lazy dog").alias("text"))
    docs = spark.createDataFrame([(1, "a quick brown fox jumps over the lazy dog again"), (2, "none of it")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, alike).collect()] == [(1, 7)]
    monkeypatch.setattr(decontaminate, "BLOCK", 10)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    many = spark.range(300).select((F.col("id") % 50).alias("item_id"), F.expr("repeat('word ', int(id % 60))").alias("text")).repartition(5)
    rows = decontaminate.in_blocks(many.union(spark.createDataFrame([(None, "x" * 5000), (1, None)], many.schema))).collect()
    assert len(rows) == 301
    sizes = {}
    for r in rows:
        n, size = sizes.get(r["block"], (0, 0))
        sizes[r["block"]] = n + 1, size + len(r["text"])
    assert all(n <= 10 and (size <= 1300 or n == 1) for n, size in sizes.values())


def test_long_texts(spark, labels, benchmark):
    """A hundred thousand varied words, and one word of a million letters, go through every operator whole."""
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    varied = " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".\n"]) for _ in range(100_000))
    rows = [(1, varied), (2, "x" * 1_000_000), (3, "password = " + "q" * 100_000), (5, "short"), (7, varied[: len(varied) // 2] + "quick brown fox jumps over the lazy dog and runs away")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for found in (quality.scores(docs, labels), toxicity.scores(docs, labels), lm.score(docs), minhash.near_duplicates(docs), fingerprint.edited_against_next(docs), secrets.digest(secrets.secrets(docs))):
        assert ids(found) == [1, 2, 3, 5, 7]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()} == {(7, 1)}
    n = {r["doc_id"]: (r["n"], r["all"]) for r in packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()}
    assert set(n) == {1, 2, 3, 5, 7} and all(a == b for a, b in n.values())
    left = {r["doc_id"]: r["text"] for r in lines.dedupe_lines(docs).collect()}
    assert left[2] == rows[1][1] and left[1].split("\n")[0] == varied.split("\n")[0] and len(left[7]) < len(rows[4][1])


def test_many_alike_are_dealt_apart(spark, monkeypatch):
    """Rows without id, and pieces alike, are no single task's; results are those of rows in order."""
    monkeypatch.setattr(fingerprint, "PART_CHARS", 400)
    rows = [(None, f"w{i} x y z") for i in range(60)] + [(5, f"v{i} x y z") for i in range(60)] + [(i, f"u{i} a b c") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = fingerprint.in_order(docs).where("own").groupBy("part").count()
    assert dealt.agg(F.max("count")).first()[0] < 100 and fingerprint.in_order(docs).where("own").count() == 160
    assert fingerprint.in_order(docs).where("own").groupBy(F.spark_partition_id()).agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0] == 1
    hashed = docs.withColumn("h", F.xxhash64("text")).collect()
    order = sorted(hashed, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    want = sorted((r["doc_id"] or -1, r["text"][: len(r["text"]) - len(r["text"]) // 4] + s["text"][: len(r["text"]) // 4]) for r, s in zip(order, [*order[1:], order[0]]))
    import hashlib

    got = sorted((r["doc_id"] or -1, r["edited_sha256"]) for r in fingerprint.edited_against_next(docs).collect())
    assert got == sorted((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in want)


def test_empty_rows_alike_are_packed_apart(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    out = packing.pack_documents(docs, length=64, grain=4)
    assert out.count() == 3000
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("c")).where("n > 64 or k <> c").count() == 0
