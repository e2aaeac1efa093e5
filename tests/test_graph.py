"""Audits of trees and references against walks, and frames of bytes one by one."""

import random

from pyspark.sql import functions as F

from marginalia.operators import graph
from marginalia.sources import envelope


def test_trees_with_cycles_and_missing_parents(spark):
    rng = random.Random(3)
    rows = []
    for d in range(30):
        n = rng.choice((1, 2, 9, 40))
        rows += [(d, i, None if rng.random() < 0.1 else rng.randrange(-1, n) if rng.random() < 0.3 else max(0, i - 1)) for i in range(n)]
    want = set()
    parent = {(d, i): p for d, i, p in rows}
    for d, i, _ in rows:
        at, seen = i, []
        while at is not None and (d, at) in parent and at not in seen:
            seen.append(at)
            at = parent[d, at]
        if at is None:
            want.add((d, i, len(seen) - 1, seen[-1], "too_deep" if len(seen) - 1 > 5 else None))
        elif (d, at) in parent:
            want.add((d, i, None, None, "cycle" if at == i else "under_cycle"))
        else:
            want.add((d, i, len(seen) - 1, seen[-1], "dangling" if len(seen) == 1 else "unreachable"))
    got = graph.audit_tree(spark.createDataFrame(rows, "doc long, node long, parent long"), "doc", "node", "parent", 5)
    assert set(map(tuple, got.select("doc", "node", "depth", "top", "code").collect())) == want
    assert len({w[-1] for w in want}) == 6


def test_references_too_deep_and_none(spark):
    nodes = spark.range(60).select(F.lit(1).alias("doc"), F.col("id").alias("node"))
    edges = nodes.where("node < 59").select("doc", F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    codes = lambda layers: {r["code"] for r in graph.audit_references(nodes, edges, "doc", "node", "a", "b", layers).collect()}
    assert codes(4) == {None, "too_deep"} and codes(64) == {None}
    assert graph.audit_references(nodes.limit(0), edges.limit(0), "doc", "node", "a", "b").count() == 0
    assert graph.audit_tree(nodes.limit(0).withColumn("parent", F.col("node")), "doc", "node", "parent").count() == 0


def test_references_by_document_and_by_joins_agree(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(d, rng.randrange(12), rng.randrange(14)) for d in range(40) for _ in range(rng.choice((0, 3, 9, 20)))]
    edges += [(50, i, i + 1) for i in range(60)] + [(None, 1, 2), (1, None, 2), (1, 2, None)]
    nodes = [(d, n) for d in range(40) for n in range(12)] + [(50, i) for i in range(61)] + [(None, 1), (1, None), (1, 3), (1, 3)]
    nodes, edges = spark.createDataFrame(nodes, "doc long, node long"), spark.createDataFrame(edges, "doc long, a long, b long")
    found = []
    for most, rows in ((0, 10), (40, 50), (100_000, 10), (100_000, 100_000)):
        monkeypatch.setattr(graph, "DOCUMENT", most)
        monkeypatch.setattr(graph, "ROWS", rows)
        found.append(sorted(map(tuple, graph.audit_references(nodes, edges, "doc", "node", "a", "b", 8).collect()), key=str))
    assert found[0] == found[1] == found[2] == found[3]
    assert {r[2] for r in found[0]} == {None, "cycle", "dangling", "too_deep"}


def test_references_of_small_documents_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "peel", None)
    nodes = spark.range(5).select(F.lit(1).alias("doc"), F.col("id").cast("string").alias("node"))
    edges = spark.createDataFrame([(1, "0", "1"), (1, "1", "0"), (1, "2", "9")], "doc int, a string, b string")
    got = graph.audit_references(nodes, edges, "doc", "node", "a", "b").collect()
    assert sorted(map(tuple, got)) == [(1, "0", "cycle"), (1, "1", "cycle"), (1, "2", "dangling"), (1, "3", None), (1, "4", None)]


def test_frames_of_a_folder(spark, tmp_path):
    import hashlib

    def frame(man, payload):
        return envelope.MAGIC + len(man).to_bytes(4, "big") + len(payload).to_bytes(4, "big") + man + payload

    def man(payload, doc=5):
        h = hashlib.sha256(payload).hexdigest()
        return f'{{"document_id":{doc},"revision":2,"source_hash":"{h}","payload_hash":"{h}"}}'.encode()

    good = frame(man(b"a\xffb"), b"a\xffb")
    big = (envelope.MANIFEST_BYTES + 1).to_bytes(4, "big")
    cases = {
        "good": (good, None), "short": (good[:-1], "truncated"), "head": (good[: len(envelope.MAGIC) + 3], "truncated"), "stub": (good[:5], "truncated"),
        "long": (good + b"\0", "length"), "swapped": (frame(man(b"one"), b"two"), "hash_mismatch"), "magic": (b"x" + good[1:], "magic"),
        "spaces": (frame(man(b"a").replace(b":", b": "), b"a"), "noncanonical_manifest"), "order": (frame(b'{"revision":1}', b"a"), "invalid_manifest"),
        "bytes": (frame(b"\xff\xfe", b"a"), "invalid_manifest"), "bare": (frame(man(b""), b""), "missing_payload"), "limit": (envelope.MAGIC + big + b"\0" * 4, "manifest_limit"),
        "pdf": (b"%PDF-1.7\n", "external"), "huge": (good + b"\0" * envelope.FRAME_BYTES, "frame_limit"),
    }
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    found = {r["path"].split("/")[-1]: r["decoded"] for r in envelope.frames(spark, str(tmp_path)).collect()}
    assert {k: v["code"] for k, v in found.items()} == {k: c for k, (_, c) in cases.items()}
    assert bytes(found["good"]["payload"]) == b"a\xffb" and found["good"]["document_id"] == 5
    rows = spark.createDataFrame([(5, 2, bytearray(good)), (6, 2, bytearray(good)), (5, 3, bytearray(good)), (None, None, bytearray(good)), (5, 2, bytearray()), (5, 2, None)], "d long, r long, f binary")
    out = envelope.decode(rows, "f")
    assert [r[0] for r in out.select(envelope.recovered(out, F.col("d"), F.col("r"))).collect()] == [None, "document_mismatch", "revision_mismatch", None, "missing", "missing"]
    made = spark.createDataFrame([(5, 2, bytearray(b"a\xffb"))], "d long, r long, p binary")
    assert bytes(made.select(envelope.encode(envelope.manifest(F.col("d"), F.col("r"), F.col("p")), F.col("p"))).first()[0]) == good
