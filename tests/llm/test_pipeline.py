"""The pipeline's stages one after another, each against what it promises of its own input."""

import itertools
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import decontaminate, packing
from marginalia.llm.common import keep, shared_dir, table, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents").withColumn("_score", F.lit("mine")).withColumn("lines_removed", F.lit(7))
    docs = docs.union(spark.createDataFrame([(None, None, None, None, None, "mine", 7), (10**6, "", "en", "s", 0, "mine", 7)], docs.schema))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    seen = {}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = keep(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns
        assert out.where("_score = 'mine' and lines_removed = 7").count() == out.count() <= docs.count()
        seen[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        docs = out
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in seen["quality"] for i in good) >= 0.97 * len(good)
    assert all(set((t or "").split("\n")) <= set((seen["quality"][i] or "").split("\n")) for i, t in seen["line_dedup"].items())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in seen["near_dedup"].items() if (w := words(t))}
    assert not any(100 * len(a & b) >= 80 * len(a | b) for a, b in itertools.combinations(sets.values(), 2))
    assert set(seen["near_dedup"]) <= set(seen["line_dedup"])
    items = [decontaminate.tokens(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for t in seen["decontamination"].values():
        w = decontaminate.tokens(t)
        assert not any(w[k : k + len(x)] == x for x in items for k in range(len(w) - len(x) + 1))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in rows} == set(seen["decontamination"]) and all(r["n"] == r["all"] for r in rows)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0 and out.agg(F.max("length")).first()[0] <= packing.LENGTH


def test_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = two.replace("b7 ", "other ")
    rows = [(i, one) for i in (None, None, 1, 1, 2)] + [(None, two), (None, two), (None, near)] + [(9, None), (9, None), (None, ""), (5, "alone in all of this")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema).repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    left = sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, SF).collect()), key=str)
    pair = [x for x in left if x in ((None, two), (None, near))]
    assert len(pair) == 1 and left == sorted([(1, one), *pair, (9, None), (9, None), (None, ""), (5, "alone in all of this")], key=str)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs.where("false"), SF)
        assert out.count() == 0, name


def test_tables_of_stages_go(spark):
    before = {p.name for p in Path(shared_dir(spark)).glob("*")}
    corpus_pipeline.run(spark, SF).count()
    left = [p.name for p in Path(shared_dir(spark)).glob("*") if p.name not in before and p.name.rsplit("-", 1)[0] in ("quality", "line_dedup", "near_dedup")]
    assert not left
