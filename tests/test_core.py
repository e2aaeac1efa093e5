"""Every query against its SQL on the smallest tables; folds against plain walks; edges of the functions."""

import math
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia import catalog
from marginalia.functions import numbers, text
from marginalia.operators import commands, identity, layout, log, ranges, tree, validate
from marginalia.sources import documents

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in found.fetchall())
    got = sorted(tuple(plain(v) for _, v in sorted(zip(df.columns, r))) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_undo_redo(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.choice(["commit", "commit", "undo", "redo"]), 100 * d + i) for d in range(8) for i in range(40)]
    want = {}
    for d in range(8):
        done, undone, ignored = [], [], 0
        for _, _, k, c in [r for r in rows if r[0] == d]:
            if k == "commit":
                done, undone = [*done, c], []
            elif k == "undo" and done:
                undone.append(done.pop())
            elif k == "redo" and undone:
                done.append(undone.pop())
            else:
                ignored += 1
        want[d] = (len(done), len(undone), ignored, done[-1] if done else None)
    df = spark.createDataFrame(rows, "d long, i long, k string, c long")
    got = {r["d"]: (r["applied"], r["redoable"], r["ignored"], None if r["top"] is None else int(r["top"])) for r in log.undo_redo(df, "d", "i", "k", "c").collect()}
    assert got == want


def test_pagination_rules(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.choice(["paragraph", "paragraph", "heading", "pageBreak"]), rng.randrange(1, 30)) for d in range(6) for i in range(25)]
    df = spark.createDataFrame([(d, i, k, 1 if k == "heading" else n) for d, i, k, n in rows], "doc_id long, ordinal long, kind string, lines long")
    lines = {(r["doc_id"], r["ordinal"]): (r["kind"], r["lines"]) for r in df.collect()}
    out = layout.paginate(df, 10).collect()
    used, covered, at = {}, {}, {}
    for r in out:
        n = r["last_line"] - r["first_line"]
        used[r["doc_id"], r["page"]] = used.get((r["doc_id"], r["page"]), 0) + n
        key = (r["doc_id"], r["ordinal"])
        assert r["first_line"] == covered.get(key, 0) or lines[key][0] == "pageBreak"
        covered[key] = r["last_line"]
        at.setdefault(key, []).append((r["page"], n))
    assert max(used.values()) <= 10
    assert all(covered[k] == n for k, (kind, n) in lines.items() if kind != "pageBreak")
    for key, pieces in at.items():
        kind, n = lines[key]
        if kind == "paragraph" and n >= 4 and len(pieces) > 1:
            assert pieces[0][1] >= 2 and pieces[-1][1] >= 2
        following = lines.get((key[0], key[1] + 1))
        if kind == "heading" and following and following[0] == "paragraph":
            assert at[key[0], key[1] + 1][0][0] == pieces[-1][0]


def test_reading_blocks(spark):
    rng = random.Random(3)
    rows = [(p, i, rng.randrange(300), rng.randrange(2000), 50, rng.randrange(10, 40)) for p in range(5) for i in range(30)]
    want = {}
    for p in range(5):
        boxes: list[list[int]] = []
        for _, i, x, y, _, h in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[3], r[2], r[1])):
            if boxes:
                left, low, high = boxes[-1]
                tall = max(h, high - low)
                if max(0, low - y - h) <= 2 * tall and abs(x - left) <= 4 * tall:
                    boxes[-1] = [min(left, x), min(low, y), max(high, y + h)]
                    want[p, i] = len(boxes)
                    continue
            boxes.append([x, y, y + h])
            want[p, i] = len(boxes)
    df = spark.createDataFrame(rows, "page long, line long, x long, y long, width long, height long")
    assert {(r["page"], r["line"]): r["block"] for r in layout.reading_blocks(df).collect()} == want


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text_edges(spark):
    t = F.lit("a😀é́b")
    r = one(
        spark, u=text.utf16_length(t), b=text.utf16_to_bytes(t, F.lit(3)), split=text.utf16_to_bytes(t, F.lit(2)), back=text.bytes_to_utf16(t, F.lit(5)), inside=text.bytes_to_utf16(t, F.lit(3)),
        g=text.graphemes(t), empty=text.find_all(F.lit("abc"), "  "), none=text.find_all(F.lit("abc"), "x"), hits=text.find_all(F.lit("😀A.a.A"), "a."), null=text.utf16_length(F.lit(None).cast("string")),
        d1=text.is_decimal(F.lit("1.")), d2=text.is_decimal(F.lit("+.5")), d3=text.is_decimal(F.lit(".5")), d4=text.is_decimal(F.lit("+")), d5=text.is_decimal(F.lit(None).cast("string")),
        l1=text.is_iso_date(F.lit("2024-02-29")), l2=text.is_iso_date(F.lit("2023-02-29")), l3=text.is_iso_date(F.lit("0000-01-01")), z=text.is_utc_timestamp(F.lit("2024-02-29T23:59:59Z")), zz=text.is_utc_timestamp(F.lit("2024-02-29T24:00:00Z")),
    )
    assert (r.u, r.b, r.split, r.back, r.inside, len(r.g), r.empty, r.none, r.hits, r.null) == (6, 5, None, 3, None, 4, [], [], [2, 4], None)
    assert (r.d1, r.d2, r.d3, r.d4, r.d5) == (True, True, False, False, False)
    assert (r.l1, r.l2, r.l3, r.z, r.zz) == (True, False, False, True, False)


def test_numbers(spark):
    n = lambda a, b: numbers.half_away(F.lit(a).cast("long"), F.lit(b).cast("long"))
    r = one(spark, a=n(5, 2), b=n(-5, 2), c=n(4, 3), d=n(1, 0), e=numbers.to_units(F.lit(2**62).cast("long"), F.lit(1).cast("long")), f=numbers.times(F.lit(-96).cast("long"), F.lit(1).cast("long")))
    assert tuple(r) == (3, -3, 1, None, None, -2)


def test_identity(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, None)], "k long, c string")
    good, bad = identity.dedupe(rows, ["k"], F.col("c"))
    assert sorted(r["k"] for r in good.collect()) == [1, 3] and [r["k"] for r in bad.collect()] == [2]


def test_point_in_range(spark):
    points = spark.createDataFrame([(1, x) for x in (0, 5, 7, 10, 11, 20)], "k long, at long")
    spans = spark.createDataFrame([(1, 0, 5, "a"), (1, 5, 10, "b"), (1, 12, 15, "c")], "k long, s long, e long, n string")
    for forward, want in ((True, {0: "a", 5: "b", 7: "b", 10: "b", 11: None, 20: None}), (False, {0: None, 5: "a", 7: "b", 10: "b", 11: None, 20: None})):
        got = {r["at"]: r["n"] for r in ranges.point_in_range(points, spans, "k", "at", "s", "e", "n", forward).collect()}
        assert {k: v for k, v in got.items() if k or forward} == {k: v for k, v in want.items() if k or forward}


def test_tree_cycle(spark):
    nodes = spark.createDataFrame([(1, "a", None, 0), (1, "b", "a", 1), (1, "x", "y", 0), (1, "y", "x", 0)], "d long, n string, p string, o long")
    assert {r["n"] for r in tree.paths(nodes, "d", "n", "p", "o").collect()} == {"a", "b"}


def test_commands_edges(spark):
    blocks = spark.createDataFrame([(1, 0, "n", "heading", "abc"), (2, 0, "m", "paragraph", "")], "doc_id long, ordinal long, node string, kind string, text string")
    cmd = spark.createDataFrame([(1, 0)], "doc_id long, at long")
    assert commands.delete(blocks, cmd).count() == 2
    out = commands.split_block(blocks, cmd.withColumn("offset", F.lit(3))).orderBy("doc_id", "ordinal").collect()
    assert [(r["kind"], r["text"]) for r in out] == [("heading", "abc"), ("paragraph", ""), ("paragraph", "")]
    far = cmd.withColumn("start", F.lit(2)).withColumn("stop", F.lit(9)).withColumn("new", F.lit("x"))
    assert {r["text"] for r in commands.replace_text(blocks, far).collect()} == {"abc", ""}


def test_validation_empty(spark):
    rows = spark.createDataFrame([], "k long, o long, v long")
    assert validate.suite(validate.failing(rows, ["k"], "a", F.col("v") > 1), validate.duplicated(rows, ["k"], "v", "b"), validate.not_increasing(rows, "k", "o", "v", "c")).count() == 0


def test_depth(spark):
    r = one(spark, a=documents.depth(F.lit('{"a":"[[[","b":[1,[2]]}')), b=documents.depth(F.lit("")), long=documents.depth(F.concat(F.lit('["'), F.repeat(F.lit('[x'), 200_000), F.lit('"]'))), c=documents.depth(F.lit('["\\"[",{}]')))
    assert (r.a, r.b, r.long, r.c) == (3, 0, 1, 2)
