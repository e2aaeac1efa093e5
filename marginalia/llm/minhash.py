"""MinHash near-duplicates: signatures, banding, checks on full sets, connected components.

Documents with equal shingle sets form one class, and only classes are
compared. Classes that share a band are gathered into families (connected
components of each band's star). Inside a family, pairs whose signatures are
near enough are checked on the full sets, nearest first, and a pair is skipped
only when its ends are already connected, so the components are those of all
links. A large family is dealt into blocks: blocks are joined on their own, then
dealt anew and joined again; then every class outside its family's largest
component meets all blocks. Nothing is capped.

At a similarity of just the threshold, a link is missed when no band agrees
(below 1e-7 for 32 bands of 4) or when the signature is four standard errors
low (3e-5); a component needs one of its links only.

Null or wordless texts have no shingles and are linked with nothing. Rows with
equal doc_id are each given a row; component_id ignores null ids, and a null
doc_id is kept only if all of its component are null. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, U64, Hashes, by_shard, keep, mix64, pack, partitions, shingles, side, text_chunks, unpack, words
from .components import components

BLOCK = 1024
FILTER_BITS, FILTER_PARTS = 1 << 26, 64


@dataclass(frozen=True)
class Rule:
    """Documents are linked when 100 * intersection >= percent * union of their sets of `width`-word shingles."""

    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    seed: int = 11

    @property
    def k(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Signature positions that must agree for a check on full sets."""
        j = self.percent / 100
        return math.floor(self.k * (j - 4 * math.sqrt(j * (1 - j) / self.k)))


def sets_of(texts: list[str | None], width: int, hashes: Hashes) -> list[np.ndarray]:
    return [np.unique(shingles(hashes.of(words(t)), width)) for t in texts]


def class_of(s: np.ndarray) -> int:
    """A set's class: a signed 64-bit hash of it."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signatures(sets: list[np.ndarray], rule: Rule) -> np.ndarray:
    """16 bits of each universal hash's minimum, for non-empty sets."""
    rng = np.random.default_rng(rule.seed)
    a = rng.integers(0, 2**63, rule.k, np.int64).astype(U64) * U64(2) + U64(1)
    b = rng.integers(0, 2**63, rule.k, np.int64).astype(U64)
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, t = np.empty((len(sets), rule.k), np.uint16), np.empty_like(x)
    for i in range(rule.k):
        np.multiply(x, a[i], out=t)
        np.add(t, b[i], out=t)
        out[:, i] = (mix64(np.minimum.reduceat(t, starts)) >> U64(48)).astype(np.uint16)
    return out


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_hash, n_shingles, class, signature (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for texts, ids, marks in text_chunks(batches, ["text", "doc_id", "text_hash"]):
            sets = sets_of(texts, rule.width, hashes)
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full, rule)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(marks, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "class", "signature"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class long, signature binary")


def star_edges(found: DataFrame, rule: Rule) -> DataFrame:
    """Edges from each class of a band's bucket to the bucket's smallest class."""
    n = partitions(found.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cls = batch.column(0).to_numpy(zero_copy_only=False)
            _, first = np.unique(cls, return_index=True)
            first = [i for i in first if cls[i] not in seen]
            if not first:
                continue
            seen.update(cls[first].tolist())
            sig = np.frombuffer(b"".join(batch.column(1).take(pa.array(first)).to_pylist()), np.uint16).reshape(len(first), rule.bands, rule.rows)
            key = np.zeros((len(first), rule.bands), U64)
            for r in range(rule.rows):
                key = mix64(key * U64(65599) + sig[:, :, r] + U64(1))
            key = mix64(key + np.arange(rule.bands, dtype=U64)).reshape(-1)
            own = np.repeat(cls[first], rule.bands)
            out = [(s, pack(key[i], own[i])) for s, i in by_shard(key % U64(n), n)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["shard", "blob"])

    def join(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in t.column("blob").to_pylist()]
        key, own = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(own[starts], np.diff(np.r_[starts, len(key)]))
        other = least != own
        pairs = np.unique(np.stack([own[other], least[other]]), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    packed = found.where("class is not null").select("class", "signature").mapInArrow(deal, PACKED)
    return packed.groupBy("shard").applyInArrow(join, "a long, b long")


MEMBER = "a long, b long"


def linked(members: DataFrame, rule: Rule) -> DataFrame:
    """Edges from each component of a (family, task) group to the smallest that the group's links join it with.

    members: family, task, class, component, query, signature, full. Pairs of
    one component are skipped; where a group has query rows, so are pairs
    without one. Many small groups share a call.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("family", "ascending"), ("task", "ascending"), ("class", "ascending")])
        fam, task, comp, query = (t.column(c).to_numpy() for c in ("family", "task", "component", "query"))
        sig, full = t.column("signature"), t.column("full")
        starts = np.flatnonzero(np.r_[True, (fam[1:] != fam[:-1]) | (task[1:] != task[:-1])])
        out: list[tuple[int, int]] = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(fam)]):
            if hi - lo < 2:
                continue
            q = query[lo:hi]
            s = np.frombuffer(b"".join(sig.slice(lo, hi - lo).to_pylist()), np.uint16).reshape(hi - lo, rule.k)
            rows = np.flatnonzero(q) if q.any() else np.arange(hi - lo)
            sets = [np.frombuffer(x, U64) for x in full.slice(lo, hi - lo).to_pylist()]
            size = np.array([len(x) for x in sets])
            top = {x: x for x in comp[lo:hi].tolist()}

            def root(x: int, top: dict[int, int] = top) -> int:
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            cand = []
            for i in rows:  # one row against all: the group is a block of bounded size
                equal = (s == s[i]).sum(1)
                ok = (equal >= rule.least_equal) & (100 * np.minimum(size, size[i]) >= rule.percent * np.maximum(size, size[i])) & (comp[lo:hi] != comp[lo + i])
                if not q.any():
                    ok[: i + 1] = False
                js = np.flatnonzero(ok)
                cand.append(np.stack([equal[js], np.full(len(js), i), js]))
            pairs = np.concatenate(cand, axis=1)
            for _, i, j in pairs[:, np.argsort(-pairs[0], kind="stable")].T.tolist():
                x, y = root(comp[lo + i].item()), root(comp[lo + j].item())
                if x == y:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= rule.percent * (size[i] + size[j] - both):
                    top[max(x, y)] = min(x, y)
            out += [(x, root(x)) for x in top if root(x) != x]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    groups = 8 * partitions(members.sparkSession)
    dealt = members.withColumn("group", F.pmod(F.xxhash64("family", "task"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, MEMBER)


def class_filter(classes: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS bits (its size is fixed) with the bit of each class set; more classes only make it less choosy."""

    def run(t: pa.Table) -> pa.Table:
        bits = np.zeros(FILTER_BITS // FILTER_PARTS, np.uint8)
        bits[t.column("bit").to_numpy() % len(bits)] = 1
        return pa.table({"part": t.column("part")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bit = F.shiftrightunsigned("class", 64 - FILTER_BITS.bit_length() + 1).alias("bit")
    parts = classes.select(bit).withColumn("part", F.expr(f"bit div {FILTER_BITS // FILTER_PARTS}")).distinct()
    found = {r["part"]: r["bits"] for r in parts.groupBy("part").applyInArrow(run, "part long, bits binary").collect()}
    return b"".join(found.get(i, bytes(FILTER_BITS // FILTER_PARTS // 8)) for i in range(FILTER_PARTS))


def full_sets(docs: DataFrame, rule: Rule, classes: DataFrame) -> DataFrame:
    """class and full set of the classes named, and of a few more; once a task for each class."""
    wanted = docs.sparkSession.sparkContext.broadcast(class_filter(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, bits = Hashes(), set(), wanted.value
        for (texts,) in text_chunks(batches, ["text"]):
            new = {}
            for s in sets_of(texts, rule.width, hashes):
                if len(s) and (c := class_of(s)) not in seen:
                    at = (c & (1 << 64) - 1) >> (64 - FILTER_BITS.bit_length() + 1)
                    if bits[at >> 3] >> (at & 7) & 1:
                        seen.add(c)
                        new[c] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.binary())], ["class", "full"])

    return docs.select("text").mapInArrow(run, "class long, full binary")


def links(docs: DataFrame, found: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """(node, component), at least of all classes that aren't their component's smallest."""
    families = keep(components(star_edges(found, rule)), "families")
    n = families.count()
    sizes = families.groupBy(F.col("component").alias("family")).agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / block))
    member = keep(families.select(F.col("node").alias("class"), F.col("component").alias("family")).join(side(sizes, n), "family"), "member")
    one = found.join(side(member.select("class"), n), "class", "left_semi").groupBy("class").agg(F.first("signature").alias("signature"))
    full = full_sets(docs, rule, member.select("class")).join(member.select("class").hint("merge"), "class", "left_semi").groupBy("class").agg(F.first("full").alias("full"))
    member = keep(member.join(side(one, n), "class").join(side(full, n), "class"), "members")
    many = member.where("blocks > 1")

    def joined(rows: DataFrame) -> DataFrame:
        return keep(linked(rows.select("family", "task", "class", "component", "query", "signature", "full"), rule), "links")

    alone = F.col("class").alias("component"), F.lit(False).alias("query")
    first = joined(member.select("*", F.pmod(F.xxhash64("class"), "blocks").alias("task"), *alone))
    # a class is in one block, so these are its block's components as they stand; those of families of one block are done
    if many.isEmpty():
        return side(first.select(F.col("a").alias("node"), F.col("b").alias("component")), n)
    label = F.coalesce("b", "class").alias("component")
    labels = keep(member.select("family", "class", "blocks").join(side(first, n), F.col("class") == F.col("a"), "left").select("family", "class", "blocks", label), "labels")
    done = labels.where("blocks = 1").select(F.col("class").alias("node"), "component")

    def merged(rows: DataFrame, edges: DataFrame) -> DataFrame:
        """rows with their components joined as the edges between components say."""
        c = components(edges).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        return rows.join(side(c, n), "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")

    task = F.pmod(F.xxhash64("class", F.lit(1)), "blocks")
    some = labels.where("blocks > 1").withColumn("query", F.lit(False))
    second = joined(some.withColumn("task", task).join(side(many.select("class", "signature", "full"), n), "class"))
    rows = keep(merged(some, second).select("family", "class", "component", "query", "blocks"), "labels")
    largest = rows.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    rest = rows.join(largest, "family").where("component <> largest").drop("largest")
    chunks = rest.groupBy("family").agg(F.ceil(F.count("*") / block).alias("chunks"))
    chunk = F.pmod(F.xxhash64("class", F.lit(2)), "chunks")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = rest.join(chunks, "family").withColumn("query", F.lit(True)).withColumn("chunk", chunk).withColumn("block", every("blocks"))
    there = rows.join(chunks, "family").withColumn("block", task).withColumn("chunk", every("chunks"))
    there = there.join(side(asked.select("class", "block", "chunk"), n), ["class", "block", "chunk"], "left_anti")
    cols = ["family", "class", "component", "query", F.concat_ws(":", "block", "chunk").alias("task")]
    last = asked.select(cols).unionByName(there.select(cols)).join(side(member.select("class", "signature", "full"), n), "class")
    return side(done.union(merged(rows, joined(last)).select("class", "component")), n)


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of text) and component (its smallest class, null without shingles) for each row of docs."""
    found = keep(sketches(docs, rule), "sketches")
    names = ["doc_id", "text_hash", "n_shingles", "class"]
    some, none = found.where("class is not null").select(names), found.where("class is null").select(names)
    rows = some.join(links(docs, found, rule, block).withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(side(ids, found.count()), "component")
    # rows without shingles meet no join, so that many of them are no single task's
    alone = none.select(*names, F.col("class").alias("component"), F.col("doc_id").alias("component_id"))
    out = out.select(*alone.columns).union(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "component")
