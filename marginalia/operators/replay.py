"""Documents as folds of typed operations: commits with stored inverses, undo and redo, snapshots, recovery.

An operation says all that it changes, so its inverse is a rearrangement of its
own columns (`inverse`) and needs no document:

| type | node | other | place | to | before | after |
|---|---|---|---|---|---|---|
| text | block | | code point | | text removed | text put there |
| insert, remove | block | kind | ordinal | | (remove) text | (insert) text |
| move | block | | from | to | | |
| kind | block | | | | kind | kind |
| split, merge | first | second | code point | | (merge) second's kind | (split) second's kind |

A transaction is a list of operations under one revision, done whole or not at
all, with the document's hash before and after. An undo is a transaction of the
inverses in reverse order, a redo one of the entry's own operations, each a revision
of its own.

Rows are dealt by document and streamed through a task in order (`fold`); what is
held is one document's blocks and history, never its log. A fold over one document
is sequential by nature: a document with many revisions takes its time in
one task, and a snapshot is what shortens it. A document that fails stops
alone, with a code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OP = "struct<type:string,node:string,other:string,place:long,to:long,before:string,after:string>"
BLOCK = "struct<node:string,kind:string,text:string>"
ENTRY = f"struct<request:long,forward:array<{OP}>,before_hash:string,after_hash:string>"
INVERSES = {"text": "text", "insert": "remove", "remove": "insert", "move": "move", "kind": "kind", "split": "merge", "merge": "split"}
#: What stands between a block's parts, and how long a history may be.
PART, HISTORY = "\x1f", 10_000


def inverse(op: Column) -> Column:
    """The operation that takes another one back."""
    kind = F.coalesce(*[F.when(op["type"] == a, b) for a, b in INVERSES.items()])
    turned = op["type"] == "move"
    names = {"type": kind, "node": op["node"], "other": op["other"], "place": F.when(turned, op["to"]).otherwise(op["place"]), "to": F.when(turned, op["place"]).otherwise(op["to"]), "before": op["after"], "after": op["before"]}
    return F.struct(*[c.alias(n) for n, c in names.items()])


def inverses(ops: Column) -> Column:
    """What takes a list of operations back: their inverses, last first."""
    return F.reverse(F.transform(ops, inverse))


def digest(blocks: Column) -> Column:
    """A document's hash: of its blocks' hashes in order."""
    one = lambda b: F.sha2(F.concat(b["node"], F.lit(PART), b["kind"], F.lit(PART), b["text"]).cast("binary"), 256)
    return F.sha2(F.array_join(F.transform(blocks, one), ",").cast("binary"), 256)


def inverted(op: dict) -> dict:
    """`inverse` for one operation at hand."""
    turned = op["type"] == "move"
    return op | {"type": INVERSES[op["type"]], "place": op["to"] if turned else op["place"], "to": op["place"] if turned else op["to"], "before": op["after"], "after": op["before"]}


class Refused(Exception):
    """An operation or a transaction that can't be done; its code is the first argument."""


class Document:
    """One document's blocks in order, while a task folds it."""

    def __init__(self, blocks: list[dict]):
        self.order = [b["node"] for b in blocks]
        self.block = {b["node"]: (b["kind"], b["text"]) for b in blocks}
        self.hashes: dict[str, str] = {}
        if len(self.block) < len(self.order):
            raise Refused("duplicate_node")

    def blocks(self) -> list[dict]:
        return [{"node": n, "kind": self.block[n][0], "text": self.block[n][1]} for n in self.order]

    def hash(self) -> str:
        for n in self.order:
            if n not in self.hashes:
                self.hashes[n] = hashlib.sha256(PART.join((n, *self.block[n])).encode()).hexdigest()
        return hashlib.sha256(",".join(self.hashes[n] for n in self.order).encode()).hexdigest()

    def put(self, node: str, kind: str, text: str) -> None:
        self.block[node] = kind, text
        self.hashes.pop(node, None)

    def drop(self, place: int) -> None:
        node = self.order.pop(place)
        del self.block[node]
        self.hashes.pop(node, None)

    def apply(self, op: dict) -> None:
        """Do one operation if the document is as it says, else refuse."""
        kind, node, other, place, to, before, after = (op[c] for c in ("type", "node", "other", "place", "to", "before", "after"))
        there = self.block.get(node)
        if (there is None) != (kind == "insert"):
            raise Refused("invalid_target")
        if kind == "text":
            if there[1][place : place + len(before)] != before or not 0 <= place <= len(there[1]):
                raise Refused("unexpected_text")
            self.put(node, there[0], there[1][:place] + after + there[1][place + len(before) :])
        elif kind == "insert":
            if not 0 <= place <= len(self.order):
                raise Refused("invalid_place")
            self.order.insert(place, node)
            self.put(node, other, after)
        elif kind == "remove":
            if self.order[place : place + 1] != [node] or there != (other, before):
                raise Refused("unexpected_block")
            if len(self.order) == 1:
                raise Refused("last_block")
            self.drop(place)
        elif kind == "move":
            if self.order[place : place + 1] != [node] or not 0 <= to < len(self.order):
                raise Refused("invalid_place")
            self.order.insert(to, self.order.pop(place))
        elif kind == "kind":
            if there[0] != before:
                raise Refused("unexpected_kind")
            self.put(node, after, there[1])
        elif kind == "split":
            if other in self.block or not 0 <= place <= len(there[1]):
                raise Refused("invalid_place")
            self.order.insert(self.order.index(node) + 1, other)
            self.put(other, after, there[1][place:])
            self.put(node, there[0], there[1][:place])
        elif kind == "merge":
            at = self.order.index(node) + 1
            if self.order[at : at + 1] != [other] or len(there[1]) != place or self.block[other][0] != before:
                raise Refused("unexpected_block")
            self.put(node, there[0], there[1] + self.block[other][1])
            self.drop(at)
        else:
            raise Refused("unknown_type")

    def apply_all(self, ops: list[dict]) -> None:
        """Do all operations, or none: those done before one that is refused are taken back."""
        done = []
        try:
            for op in ops:
                self.apply(op)
                done.append(op)
        except Refused:
            for op in reversed(done):
                self.apply(inverted(op))
            raise

    def derive(self, c: dict) -> dict:
        """The operation that a command (type, place, start, length, to, text, node) asks for, on the document as it is."""
        op = dict.fromkeys(("type", "node", "other", "place", "to", "before", "after")) | {"type": c["type"]}
        n, place = len(self.order), c["place"]
        if place is None or not 0 <= place < n + (c["type"] == "insert"):
            raise Refused("invalid_target")
        if c["type"] == "insert":
            return op | {"node": c["node"], "other": c["kind"] or "paragraph", "place": place, "after": c["text"] or ""}
        node = self.order[place]
        kind, text = self.block[node]
        if c["type"] == "text":
            start, length, new = c["start"], c["length"] or 0, c["text"] or ""
            if start is None or start < 0 or length < 0 or start + length > len(text):
                raise Refused("invalid_range")
            if text[start : start + length] == new:
                raise Refused("no_op")
            return op | {"node": node, "place": start, "before": text[start : start + length], "after": new}
        if c["type"] == "remove":
            return op | {"node": node, "other": kind, "place": place, "before": text}
        if c["type"] == "move":
            if c["to"] == place:
                raise Refused("no_op")
            return op | {"node": node, "place": place, "to": c["to"]}
        if c["type"] == "kind":
            if c["kind"] == kind:
                raise Refused("no_op")
            return op | {"node": node, "before": kind, "after": c["kind"]}
        if c["type"] == "split":
            if c["start"] is None or not 0 <= c["start"] <= len(text):
                raise Refused("invalid_range")
            # a heading that is split at its end goes on as a paragraph
            return op | {"node": node, "other": c["node"], "place": c["start"], "after": "paragraph" if kind == "heading" and c["start"] == len(text) else kind}
        if c["type"] == "merge":
            if place + 1 >= n or self.block[self.order[place + 1]][0] != kind:
                raise Refused("invalid_target")
            return op | {"node": node, "other": self.order[place + 1], "place": len(text), "before": kind}
        raise Refused("unknown_type")


class History:
    """Entries that undo and redo go through, and the number of those that are applied."""

    def __init__(self, entries: list[dict] | None = None, cursor: int | None = None):
        self.entries = list(entries or [])
        self.cursor = len(self.entries) if cursor is None else cursor

    def commit(self, entry: dict) -> None:
        if self.cursor >= HISTORY:
            raise Refused("history_full")
        self.entries[self.cursor :] = [entry]
        self.cursor += 1

    def undo(self) -> tuple[dict, list[dict]]:
        if not self.cursor:
            raise Refused("undo_empty")
        entry = self.entries[self.cursor - 1]
        return entry, [inverted(op) for op in reversed(entry["forward"])]

    def redo(self) -> tuple[dict, list[dict]]:
        if self.cursor >= len(self.entries):
            raise Refused("redo_empty")
        entry = self.entries[self.cursor]
        return entry, entry["forward"]

    def follow(self, t: dict) -> None:
        """What a transaction of the log does to the history."""
        if t["effect"] in ("undo", "redo"):
            entry, ops = self.undo() if t["effect"] == "undo" else self.redo()
            if entry["request"] != t["entry"] or ops != t["forward"]:
                raise Refused("history_conflict")
            self.cursor += 1 if t["effect"] == "redo" else -1
        else:
            self.commit({"request": t["entry"], "forward": t["forward"], "before_hash": t["before_hash"], "after_hash": t["after_hash"]})


def fold(rows: DataFrame, doc: str, order: list[str], step: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Each document's rows in order through `step`, which takes them one by one and gives rows; a task holds no more than a batch besides."""
    # dealt by a hash of its own, so that no earlier dealing by document, which may differ between the parts of a union, is taken for this one
    dealt = rows.repartition(F.xxhash64(doc)).sortWithinPartitions(doc, *order)
    # types are parsed here: workers have no session
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        held: list[dict] = []
        for row in by_document(each(), doc, step):
            held.append(row)
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return dealt.mapInArrow(run, schema)


def by_document(rows: Iterator[dict], doc: str, step: Callable[[Iterator[dict]], Iterator[dict]]) -> Iterator[dict]:
    """`step` over each run of rows of one document; rows that it leaves are passed over."""
    ahead = next(rows, None)

    def own(key: object) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[doc] == key:
            row, ahead = ahead, None
            yield row
            if ahead is None:
                ahead = next(rows, None)

    while ahead is not None:
        key, before = ahead[doc], ahead
        mine = own(key)
        yield from step(mine)
        for _ in mine:
            pass
        if ahead is before:
            ahead = next(rows, None)


TRANSACTION = f"doc_id long, request long, code string, revision long, effect string, entry long, forward array<{OP}>, before_hash string, after_hash string, snapshot struct<blocks:array<{BLOCK}>,entries:array<{ENTRY}>,cursor:int>"
COMMAND = ("type", "place", "start", "length", "to", "kind", "text", "node")


def commit(documents: DataFrame, commands: DataFrame, every: int = 0, histories: bool = True) -> DataFrame:
    """The transactions that commands make of documents.

    documents: doc_id, blocks (an array in order), at revision 0. commands: doc_id, request
    (the order of requests, one number for all commands of a batch), seq (order
    within it), type (undo, redo, or that of an operation), place, start, length, to, kind,
    text, node. Each request gives a row: code is null and revision the new one, or
    code says why nothing was done. Every so many revisions, and at 0, the row has a snapshot;
    revision 0 has a row of its own. Commands of an unknown document give none. Without `histories` a snapshot's
    entries are null, as the log has them: with them, snapshots of a long log are together as large as its square.
    """
    first = documents.select("doc_id", F.lit(-1).cast("long").alias("request"), F.lit(0).cast("long").alias("seq"), "blocks", *[F.lit(None).cast("string" if c in ("type", "kind", "text", "node") else "long").alias(c) for c in COMMAND])
    then = commands.select("doc_id", F.col("request").cast("long"), F.col("seq").cast("long"), F.lit(None).cast(f"array<{BLOCK}>").alias("blocks"), *[F.col(c).cast("string" if c in ("type", "kind", "text", "node") else "long").alias(c) for c in COMMAND])

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        start = next(rows)
        if start["blocks"] is None:
            return
        history, revision = History(), 0
        out = {"doc_id": start["doc_id"], "request": None, "code": None, "revision": 0, "effect": "create", "entry": None, "forward": [], "before_hash": None}
        snap = lambda: {"blocks": document.blocks(), "entries": list(history.entries) if histories else None, "cursor": history.cursor}
        try:
            document = Document(start["blocks"])
        except Refused as e:
            yield out | {"code": e.args[0], "after_hash": None, "snapshot": None}
            return
        now = document.hash()
        yield out | {"after_hash": now, "snapshot": snap()}
        for request, batch in batches_of(rows):
            entry, effect = None, batch[0]["type"] if batch[0]["type"] in ("undo", "redo") else "commit"
            try:
                if effect == "commit":
                    ops = []
                    try:
                        for c in batch:
                            op = document.derive(c)
                            document.apply(op)
                            ops.append(op)
                    except Refused:
                        for op in reversed(ops):
                            document.apply(inverted(op))
                        raise
                    after = document.hash()
                    history.commit(entry := {"request": request, "forward": ops, "before_hash": now, "after_hash": after})
                else:
                    if len(batch) > 1:
                        raise Refused("batch_of_history")
                    entry, ops = history.undo() if effect == "undo" else history.redo()
                    document.apply_all(ops)
                    after = document.hash()
                    if after != entry["before_hash" if effect == "undo" else "after_hash"]:
                        raise Refused("history_conflict")
                    history.cursor += 1 if effect == "redo" else -1
            except Refused as e:
                yield out | {"request": request, "code": e.args[0], "revision": revision, "effect": effect, "before_hash": now, "after_hash": now, "snapshot": None}
                continue
            revision += 1
            yield out | {"request": request, "revision": revision, "effect": effect, "entry": entry["request"], "forward": ops, "before_hash": now, "after_hash": after, "snapshot": snap() if every and revision % every == 0 else None}
            now = after

    return fold(first.union(then), "doc_id", ["request", "seq"], step, TRANSACTION)


def batches_of(rows: Iterator[dict]) -> Iterator[tuple[int, list[dict]]]:
    """Commands of one request together."""
    held: list[dict] = []
    for row in rows:
        if held and held[0]["request"] != row["request"]:
            yield held[0]["request"], held
            held = []
        held.append(row)
    if held:
        yield held[0]["request"], held


RECOVERED = f"doc_id long, code string, base long, revision long, replayed long, applied long, redoable long, hash string, blocks array<{BLOCK}>"


def recover(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """Each document at the head of its log, from its newest snapshot whose hash holds.

    snapshots: doc_id, revision, hash, blocks, entries, cursor. log: doc_id, revision, effect, entry,
    forward, before_hash, after_hash. Only what comes after the snapshot is
    replayed; a log that ends with a snapshot needs none. Where a snapshot's entries are null, they are those
    that the log up to it leaves, which must be there from revision 1. Rows of one revision that are alike count once. What is wrong stops a document with a
    code, and it has no blocks: no_snapshot, revision_gap, revision_conflict (two transactions of a
    revision), hash_conflict (it isn't the one before's successor), hash_mismatch
    (it doesn't lead to the hash it says), history_conflict (an undo or redo that isn't the history's
    next), or what refused an operation.
    """
    chosen = snapshots.where(digest(F.col("blocks")).eqNullSafe(F.col("hash"))).groupBy("doc_id").agg(F.max_by(F.struct("revision", "hash", "blocks", "entries", "cursor"), "revision").alias("s"))
    null = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    start = chosen.select("doc_id", F.lit(0).alias("phase"), "s.revision", *null("string", "effect"), *null("long", "entry"), *null(f"array<{OP}>", "forward"), *null("string", "before_hash"), F.col("s.hash").alias("after_hash"), "s.blocks", "s.entries", "s.cursor")
    later = log.select("doc_id", F.lit(1).alias("phase"), "revision", "effect", "entry", "forward", "before_hash", "after_hash", *null(f"array<{BLOCK}>", "blocks"), *null(f"array<{ENTRY}>", "entries"), *null("int", "cursor"))

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        first = next(rows)
        out = {"doc_id": first["doc_id"], "code": "no_snapshot", "base": None, "revision": None, "replayed": 0, "applied": None, "redoable": None, "hash": None, "blocks": None}
        if first["blocks"] is None:
            yield out
            return
        out |= {"base": first["revision"], "code": None}
        revision, replayed, now, last = first["revision"], 0, first["after_hash"], None
        try:
            told = first["entries"] is None and first["cursor"] is not None
            document, history = Document(first["blocks"]), History() if told else History(first["entries"], first["cursor"])
            below = 0
            for t in rows:
                if t["revision"] <= first["revision"]:
                    if told and t["revision"] != below:
                        if t["revision"] != below + 1:
                            raise Refused("revision_gap")
                        history.follow(t)
                        below += 1
                    continue
                if told and (below, history.cursor) != (first["revision"], first["cursor"]):
                    raise Refused("revision_gap" if below < first["revision"] else "history_conflict")
                told = False
                if last is not None and t["revision"] == revision:
                    if t != last:
                        raise Refused("revision_conflict")
                    continue
                if t["revision"] != revision + 1:
                    raise Refused("revision_gap")
                if t["before_hash"] != now:
                    raise Refused("hash_conflict")
                history.follow(t)
                document.apply_all(t["forward"])
                now = document.hash()
                if now != t["after_hash"]:
                    raise Refused("hash_mismatch")
                revision, replayed, last = t["revision"], replayed + 1, t
            if told and (below, history.cursor) != (first["revision"], first["cursor"]):
                raise Refused("revision_gap" if below < first["revision"] else "history_conflict")
        except Refused as e:
            yield out | {"code": e.args[0], "revision": revision, "replayed": replayed}
            return
        yield out | {"revision": revision, "replayed": replayed, "applied": history.cursor, "redoable": len(history.entries) - history.cursor, "hash": now, "blocks": document.blocks()}

    return fold(start.union(later), "doc_id", ["phase", "revision"], step, RECOVERED)


def snapshots_of(transactions: DataFrame) -> DataFrame:
    """The snapshots that `commit` made."""
    return transactions.where("snapshot is not null").select("doc_id", "revision", F.col("after_hash").alias("hash"), "snapshot.*")


def log_of(transactions: DataFrame) -> DataFrame:
    """What `commit` did after revision 0, without the requests that were refused."""
    return transactions.where("code is null and revision > 0").select("doc_id", "revision", "effect", "entry", "forward", "before_hash", "after_hash")


def blocks_of(recovered: DataFrame) -> DataFrame:
    """Blocks of the documents that could be recovered, a row each."""
    return recovered.where("code is null").select("doc_id", F.posexplode("blocks").alias("ordinal", "block")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "block.*")
