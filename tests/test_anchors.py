"""Maps of anchors: composition against one edit after another."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import anchors

NODES = ["a", "b", "c", "d"]


def random_edit(rng, i):
    n, m, k = rng.sample(NODES, 3)
    x = [rng.randrange(12) for _ in range(4)]
    return rng.choice([
        ("text", n, x[0], rng.randrange(4), rng.randrange(4)), ("text", n, x[0], 0, 2), ("split", n, f"s{i}" if rng.random() < 0.3 else m, x[0]), ("merge", n, m, x[0]),
        ("delete", n), ("across", n, x[0], x[0] + x[1], m, x[2], [k], x[3]),
    ])


def moved(edit, at):
    """Where a (node, offset, affinity) goes by one edit, by the rules in words; None when it's deleted."""
    kind, node, *args = edit
    n, o, side = at
    forward = side == "forward"
    if kind == "text" and n == node:
        start, removed, new = args
        end = start + removed
        if o < start or (removed == 0 and o == start and not forward):
            return at
        if o > end or removed == 0:
            return n, o + new - removed, side
        if o == start:
            return at if not forward else (n, start + new, "backward") if new else None
        if o == end:
            return (n, start + new, "forward") if forward else (n, start, "forward") if new else None
        return None
    if kind == "split" and n == node and (o > args[1] or (o == args[1] and forward)):
        return args[0], o - args[1], side
    if kind == "merge" and n == args[0]:
        return node, o + args[1], side
    if kind == "delete" and n == node:
        return None
    if kind == "across":
        start, end, last, last_end, gone, new = args
        if n in gone:
            return None
        if n == node:
            if o < start or (o == start and not forward):
                return at
            if o == start:
                return n, start + new, side
            return None if o < end else (n, start + new + o - end, side)
        if n == last:
            return None if o < last_end else (node, start + new + o - last_end, side)
    return at


def column(edit):
    kind, *args = edit
    args = [F.array(*map(F.lit, a)) if isinstance(a, list) else F.lit(a) for a in args]
    return {"text": anchors.text_edit, "split": anchors.split, "merge": anchors.merge, "delete": anchors.delete, "across": anchors.across}[kind](*args)


@pytest.fixture(scope="module")
def edits(spark):
    """Edits with their maps."""
    rng = random.Random(3)
    made = [random_edit(rng, i) for i in range(160)]
    one = spark.range(1).select(*[column(e).alias(f"m{i}") for i, e in enumerate(made)]).first()
    return list(zip(made, [anchors.by_node(p.asDict() for p in m) for m in one]))


PLACES = [(n, o, side) for n in [*NODES, "s1"] for o in range(30) for side in ("backward", "forward")]


def looked_up(m, at):
    n, o, side = at
    p = 2 * o + (side == "forward")
    for lo, hi, to, shift in m.get(n, []):
        if lo <= p <= hi:
            return None if to is None else (to, (p + shift) // 2, "forward" if (p + shift) % 2 else "backward")
    return at


def test_each_edit(edits):
    for edit, m in edits:
        for at in PLACES:
            assert looked_up(m, at) == moved(edit, at), (edit, at)
        for parts in m.values():  # a node that is named is whole
            assert parts[0][0] == 0 and parts[-1][1] == anchors.LAST
            assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("seed", range(15))
def test_composition_is_one_after_another_in_any_grouping(edits, seed):
    rng = random.Random(seed)
    chain = rng.choices(edits, k=rng.randrange(2, 14))
    maps = [m for _, m in chain]
    whole = {}
    for m in maps:
        whole = anchors.compose(whole, m)
    groups = list(maps)
    while len(groups) > 1:
        i = rng.randrange(len(groups) - 1)
        groups[i : i + 2] = [anchors.compose(groups[i], groups[i + 1])]
    for at in PLACES:
        there = at
        for e, _ in chain:
            there = there and moved(e, there)
        assert looked_up(whole, at) == looked_up(groups[0], at) == there
    assert anchors.compose(whole, {}) == whole == anchors.compose({}, whole)


def test_any_anchor_at_any_revision(spark, edits):
    rng = random.Random(5)
    log, places = [], []
    for doc in range(4):
        for r in range(1, rng.choice((1, 9, 22)) + 1):
            for seq in range(rng.choice((0, 1, 1, 3))):
                e, m = rng.choice(edits)
                log.append((doc, r, seq, anchors.rows_of(m), e))
        for _ in range(60):
            at = rng.randrange(23)
            places.append((doc, *rng.choice(PLACES), at, rng.randrange(at, 24)))
    maps = anchors.revisions(spark.createDataFrame([x[:4] for x in log], f"doc long, revision long, seq long, map array<{anchors.PIECE}>").repartition(3), "doc", "revision", "seq", F.col("map"))
    table = spark.createDataFrame(places, "doc long, node string, offset long, affinity string, at long, upto long")
    found = anchors.resolve(table, anchors.spans(maps, "doc", "revision", 22), "doc", 22)
    assert found.count() == len(places)
    for r in found.collect():
        there = r["node"], r["offset"], r["affinity"]
        for _, _, _, _, e in sorted((x for x in log if x[0] == r["doc"] and r["at"] < x[1] <= r["upto"]), key=lambda x: x[1:3]):
            there = there and moved(e, there)
        assert (there or (None, None, None)) == (r["to_node"], r["to_offset"], r["to_affinity"])
        assert (there is None) == (r["deleted_in"] is not None)


def test_documents_in_one_task_and_by_levels_agree(spark, edits, monkeypatch):
    rng = random.Random(8)
    log = [(doc, r, seq, anchors.rows_of(rng.choice(edits)[1])) for doc in range(5) for r in range(1, 3 + 5 * doc) for seq in range(rng.choice((0, 1, 1, 3)))]
    places = [(doc, *rng.choice(PLACES), at, rng.randrange(at, 26)) for doc in range(6) for at in [rng.randrange(24) for _ in range(30)]]
    places += [(1, "s1", None, "forward", 0, 4), (1, "s1", 2, "backward", None, 4), (1, None, 2, "backward", 0, 4)]
    log = spark.createDataFrame(log, f"doc long, revision long, seq long, map array<{anchors.PIECE}>").repartition(3)
    table = spark.createDataFrame(places, "doc long, node string, offset long, affinity string, at long, upto long")
    want = anchors.resolve(table, anchors.spans(anchors.revisions(log, "doc", "revision", "seq", F.col("map")), "doc", "revision", 22), "doc", 22)
    want = sorted(map(tuple, want.collect()), key=str)
    for most in (0, 45, 50_000):
        monkeypatch.setattr(anchors, "DOCUMENT", most)
        got = anchors.chained(table, log, "doc", "revision", "seq", "map", 22)
        assert got.columns == [*table.columns, "to_node", "to_offset", "to_affinity", "deleted_in"]
        assert sorted(map(tuple, got.collect()), key=str) == want, most
