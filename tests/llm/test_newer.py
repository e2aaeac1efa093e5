"""Language identification, fill in the middle and hard negatives, against brute force and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import language, middle, negatives

ODD = ["", None, "\n", "\n\n", "one line", "one\n", "a\nb", "a\nb\n", "déjà\n😀 vu\n", "has <P> in\nit", "<S>", "x\r\ny\r", "copy\nof\na\ntext\n"]
CLASHING = ("_ends", "_digest", "_bytes", "_n", "_cuts", "n", "form", "first", "ends", "digest", "bytes")


@pytest.mark.parametrize("n", [0, 1, 2, 9, 700])
def test_lists_of_ends(n):
    rng = random.Random(n)
    for top in (1, 7, 5000, 3_000_000):
        ends = np.array(sorted(rng.choices(range(1, top + 1), k=n)), np.int64)
        blob = middle.encode(ends)
        assert [middle.select(blob, i) for i in range(-1, n)] == [0, *ends.tolist()]


def plainly(doc_id, text, rate, spm):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 90), (0, 0)])
def test_fill_in_middle(spark, rate, spm):
    rng = random.Random(rate)
    rows = [(i, "".join(rng.choices(["ab", "é", "\n", " ", "😀\n"], k=rng.randrange(40)))) for i in range(150)]
    rows += list(enumerate(ODD, 150)) + [(None, "no id\nat all"), (None, None), (3, "an id\ntwice\n")] + [(i, ODD[-1]) for i in range(200, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(5)
    cut = middle.transform(docs, rate, spm)
    assert cut.columns == [*docs.columns, "fim"]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    got = sorted((tuple(r) for r in cut.select("doc_id", "fim.*").collect()), key=key)
    assert got == sorted((plainly(i, t, rate, spm) for i, t in rows), key=key)
    digests = collections.Counter((r["doc_id"], r["restored_sha256"]) for r in middle.digest(cut).collect())
    assert digests == collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert middle.digest(middle.transform(docs.where("false"))).count() == 0


def test_one_list_a_text(spark):
    docs = spark.createDataFrame([(i, "the same\ntext\n" if i % 3 else f"own {i}") for i in range(300)], "doc_id long, text string").repartition(8)
    lines = docs.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.octet_length("text").cast("long"), F.length("text").cast("long"), F.transform(F.split("text", "\n", -1), F.length))
    found = middle.index(lines.toDF("digest", "bytes", "chars", "lengths")).collect()
    assert len(found) == 101
    assert sorted(r["n"] for r in found) == [1] * 100 + [2]


def mined(rows, anchors, rule=negatives.Rule()):
    """Brute force over (id, label, q)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (name, label, q) in enumerate(rows):
        if not anchors(name):
            continue
        scored = sorted(((-dot(q, v), other, j, mark) for j, (other, mark, v) in enumerate(rows) if j != i))
        for s, pid, _, _ in [x for x in scored if x[3] == label][: rule.positives]:
            fits = [x for x in scored if x[3] != label and rule.low * -s <= 100 * -x[0] <= rule.high * -s][: rule.negatives]
            out += [(name, pid, rank, other, -s, -t) for rank, (t, other, _, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("labels, copies, scale", [(3, 0, 10), (1, 0, 10), (40, 5, 10), (2, 60, 3), (4, 3, 500_000_000)])
def test_hard_negatives(spark, monkeypatch, labels, copies, scale):
    for name, value in (("ROWS", 16), ("ANCHORS", 4), ("DIMS", 5), ("GRID_ROWS", 2), ("GRID_ANCHORS", 2)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(labels)
    rows = [(i, rng.randrange(labels), [rng.randrange(-scale // 3, scale) for _ in range(rng.choice((12, 12, 12, 7, 0)))]) for i in range(150)]
    rows += [(1000 + i, rng.randrange(labels), rows[7][2]) for i in range(copies)]
    df = spark.createDataFrame(rows, "id long, label long, q array<long>").repartition(4)
    got = negatives.mine(df, F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, lambda i: i % 10 == 0)


def test_repeated_ids_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 2, [0.9, 0.5]), (3, 2, [0.9, 0.5]), (3, 2, [0.9, 0.5])]
    rows += [(4, None, [1.0, 0.5]), (5, 2, None), (6, 2, [nan, 0.5]), (7, 2, [1.0, inf]), (8, 2, [None, 0.5]), (None, 2, [1.0, 0.5]), (9, 2, []), (10, 2, [-0.001])]
    df = spark.createDataFrame(rows, "vec_id int, label int, embedding array<float>").withColumns({c: F.lit(1) for c in ("row", "id", "q", "block", "score", "rank")})
    held = negatives.quantised(df)
    assert sorted((r["id"], r["q"]) for r in held.collect()) == [(0, [256, 128])] * 2 + [(1, [256, 102]), (2, [230, 128]), (3, [230, 128]), (3, [230, 128]), (9, []), (10, [-1])]
    rows = [(r["id"], r["label"], r["q"]) for r in held.collect()]
    assert sorted(tuple(r) for r in negatives.mine(held, F.col("id") == 0).collect()) == mined(rows, lambda i: i == 0)
    assert negatives.mine(held.where("false"), F.col("id") == 0).count() == 0
    assert negatives.mine(held, F.col("id") < 0).count() == 0


def contained(rows):
    """The n-grams of each language, as sets, by the rule of the operator."""
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        for g in runs(text):
            counts[lang, len(g)][g] += 1
    sets = collections.defaultdict(set)
    for (lang, _), c in counts.items():
        sets[lang] |= {g for g, n in c.items() if n * language.RARE >= sum(c.values())}
    return sets


def runs(text):
    words = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in text.lower()).split())} "
    return [g for n in language.ORDERS for i in range(len(words) - n + 1) if " " not in (g := words[i : i + n])[1:-1] and g.strip()]


SYLLABLES = {"en": "the ing ly ed er", "de": "ung sch ein ß ch", "el": "ος και α 𐐀𐐁", "zh": "的 是 不 了"}


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(4)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 30))), lang) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]


def test_language(spark, spoken, monkeypatch):
    monkeypatch.setattr(language, "RARE", 300)
    monkeypatch.setattr(language, "HELD", 500)
    monkeypatch.setattr(language, "MOST_HELD", 1000)
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string").repartition(3)
    learnt = [r for r in spoken if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    sets = contained(learnt)
    found = {r["doc_id"]: r for r in language.judged(language.identify(docs)).collect()}
    assert len(found) == len(spoken)
    for i, text, lang in spoken:
        counts = {x: sum(g in sets[x] for g in runs(text)) for x in sorted(SYLLABLES)}
        best, second = sorted(counts.values())[-1:-3:-1]
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert counts[found[i]["lang_pred"]] == best
        assert math.isclose(found[i]["score"], best / (best + second), abs_tol=0.01)
    held = [r for r in spoken if found[r[0]]["held_out"]]
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held)


def test_sets_of_languages(spark, spoken):
    """A look returns every language that contains an n-gram, and hardly any other; with over 64 languages too."""
    many = [(i, text, f"{lang}-{k}") for k in range(20) for i, text, lang in spoken[:60]]
    filters = language.fit(spark.createDataFrame(many, "doc_id long, text string, lang string").select("text", "lang"))
    sets = contained(many)
    assert filters.langs == sorted(sets) and len(filters.langs) == 80
    is_letter = language.letters()
    texts = [text for _, text, _ in many[:60]]
    for h, g in zip(itertools.chain.from_iterable(h for _, h, _ in language.grams(texts[:1], is_letter)), runs(texts[0])):
        mask = filters.containing(np.array([h]))[0]
        got = {x for i, x in enumerate(filters.langs) if int(mask[i // 64]) >> (i % 64) & 1}
        assert got == {x for x in sets if g in sets[x]}


def test_odd_texts(spark, spoken):
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 345 ²!", "en"), (None, "the edly ing", None), (1003, "ж", "en"), (1003, "ж", "en"), (1004, "the " * 50_000, None)]
    docs = spark.createDataFrame([*spoken, *odd], "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("held_out", "gram", "slot", "word", "mask", "score", "lang_pred")})
    rows = language.identify(docs.where("lang is null or doc_id < 1003")).where("doc_id is null or doc_id >= 1000").select("doc_id", "language.*").collect()
    by = {r["doc_id"]: (r["lang"], r["score"]) for r in rows}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert by[None][0] == by[1004][0] == "en"
    unknown = language.predicted(docs.where("doc_id = 1003"), language.fit(docs.where("doc_id < 400").select("text", "lang"))).select("language.*").collect()
    assert len(unknown) == 2 and all(r["score"] == 0.0 and r["lang"] in SYLLABLES for r in unknown)
    nothing = language.judged(language.identify(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert language.judged(language.identify(docs.where("false"))).count() == 0
