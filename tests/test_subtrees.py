"""Subtrees as intervals, against walks over the tree."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import subtrees

NAMES = ("doc", "node", "parent", "ordinal")


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(8)
    rows = []
    for d in range(5):
        names = []
        for i in range(rng.choice((1, 20, 60))):
            up = rng.choice([*names, None]) if names else None
            rows.append((d, f"n{i}", up, i, rng.randrange(9)))
            names.append(f"n{i}")
    return rows, subtrees.intervals(spark.createDataFrame(rows, "doc long, node string, parent string, ordinal long, w long").repartition(3), *NAMES, weight=F.col("w")).cache()


def under(rows, d, node):
    out = {node}
    while more := {r[1] for r in rows if r[0] == d and r[2] in out} - out:
        out |= more
    return out


def above(rows, d, node):
    up = {(r[0], r[1]): r[2] for r in rows}
    while node:
        yield node
        node = up[d, node]


def test_intervals(forest):
    rows, labelled = forest
    found = {(r["doc"], r["node"]): r for r in labelled.collect()}
    assert len(found) == len(rows)
    for d, node, *_ in rows:
        mine = under(rows, d, node)
        r = found[d, node]
        assert {n for (e, n), x in found.items() if e == d and r["enter"] <= x["enter"] <= r["leave"]} == mine
        assert (r["size"], r["weight"]) == (len(mine), sum(x[4] for x in rows if x[0] == d and x[1] in mine))


@pytest.mark.parametrize("limit", [subtrees.PREIMAGE, 30])
def test_delete(spark, forest, monkeypatch, limit):
    monkeypatch.setattr(subtrees, "PREIMAGE", limit)
    rows, labelled = forest
    rng = random.Random(limit)
    asked = {(d, n): k for k, (d, n, *_) in enumerate(rng.sample(rows, 14))} | {(rows[0][0], "n0"): 50}
    commands = spark.createDataFrame([(d, n, k) for (d, n), k in asked.items()] + [(0, "nowhere", 99)], "doc long, node string, command long")
    left, gone, codes = subtrees.delete(labelled, commands, *NAMES)
    weight = {(r["doc"], r["node"]): r["weight"] for r in labelled.collect()}
    fits = {x for x in asked if weight[x] <= limit}
    want = {(d, n): top[-1] for d, n, *_ in rows if (top := [a for a in above(rows, d, n) if (d, a) in fits])}
    assert {(r["doc"], r["node"]): r["root"] for r in gone.collect()} == want
    assert all(r["command"] == asked[r["doc"], r["root"]] for r in gone.collect())
    stay = {(d, n) for d, n, *_ in rows} - set(want)
    empty = {d for d, *_ in rows} - {d for d, _ in stay}
    assert {(r["doc"], r["node"]) for r in left.collect()} == stay | {(d, "fallback") for d in empty}
    for r in codes.collect():
        at = r["doc"], r["node"]
        assert r["code"] == ("unknown_node" if at not in asked else "preimage_too_large" if at not in fits else "covered" if want[at] != at[1] else None)


def test_replace_children(spark, forest):
    rows, labelled = forest
    kids = lambda d, n: [r[1] for r in sorted(rows, key=lambda r: r[3]) if r[0] == d and r[2] == n]
    d, node = max(((r[0], r[1]) for r in rows), key=lambda x: len(kids(*x)))
    now = kids(d, node)
    other = next((r[1] for r in rows if r[0] == d and r[1] not in under(rows, d, node)), node)
    schema = "doc long, node string, expected array<string>, replacement array<string>"
    for expected, new, code in [(now, [*now[:0:-1], "new"], None), (now, [], None), (now[:-1], [], "children_changed"), (now, [other], "duplicate_node"), (now, ["a", "a"], "duplicate_node")]:
        after, codes = subtrees.replace_children(labelled, spark.createDataFrame([(d, node, expected, new)], schema), *NAMES)
        assert [r["code"] for r in codes.collect()] == [code]
        got = {(r["doc"], r["node"]): (r["parent"], r["ordinal"]) for r in after.collect()}
        want = {(r[0], r[1]): (r[2], r[3]) for r in rows}
        if code is None:
            lost = set().union(*[under(rows, d, n) for n in now if n not in new], set())
            want = {k: v for k, v in want.items() if k[0] != d or k[1] not in lost} | {(d, n): (node, i) for i, n in enumerate(new)}
        assert got == want
    assert [r["code"] for r in subtrees.replace_children(labelled, spark.createDataFrame([(d, "nowhere", [], [])], schema), *NAMES)[1].collect()] == ["unknown_node"]
