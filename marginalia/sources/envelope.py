"""Source envelopes: a manifest and a payload in one byte string, of exact length and checked by hash.

magic | length of manifest, length of payload (unsigned 32-bit, big-endian) | manifest (canonical JSON) | payload

All is done by column expressions, so a table of frames is encoded, decoded and classified
where it lies; `frames` reads a folder of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The first bytes of a frame, and the most bytes of a manifest, of a payload and of a frame.
MAGIC = b"MARGINALIA\0SOURCE\0v1\0"
MANIFEST_BYTES, PAYLOAD_BYTES, FRAME_BYTES = 256 * 1024, 8 * 1024 * 1024, 8 * 1024 * 1024
#: A manifest's fields, in canonical order.
MANIFEST = "document_id long, revision long, source_hash string, payload_hash string"


def u32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def manifest(document: Column, revision: Column, payload: Column) -> Column:
    """The canonical manifest of a payload (binary)."""
    h = F.sha2(payload, 256)
    return F.to_json(F.struct(document.cast("long").alias("document_id"), revision.cast("long").alias("revision"), h.alias("source_hash"), h.alias("payload_hash")))


def encode(manifest: Column, payload: Column) -> Column:
    """A frame; null where a limit is passed or an argument is null."""
    head = F.encode(manifest, "UTF-8")
    total = F.octet_length(head) + F.octet_length(payload) + len(MAGIC) + 8
    fits = (F.octet_length(head) <= MANIFEST_BYTES) & (F.octet_length(payload) <= PAYLOAD_BYTES) & (total <= FRAME_BYTES)
    return F.when(fits, F.concat(F.lit(MAGIC), u32(F.octet_length(head)), u32(F.octet_length(payload)), head, payload))


def decode(frames: DataFrame, frame: str, out: str = "decoded") -> DataFrame:
    """frames with a struct of code, document_id, revision, payload; the last three are null unless code is.

    Codes, the first that holds: missing (null or empty), external (another format's file), frame_limit, truncated,
    magic, manifest_limit, payload_limit, length (bytes after the end), invalid_manifest, noncanonical_manifest, missing_payload,
    hash_mismatch.
    """
    m = len(MAGIC)
    f = F.col(frame)
    size = F.octet_length(f).cast("long")
    number = lambda at: F.conv(F.hex(F.substring(f, m + at + 1, 4)), 16, 10).cast("long")
    rows = frames.withColumn("_m", F.when(size >= m + 8, number(0))).withColumn("_p", F.when(size >= m + 8, number(4)))
    end = F.lit(m + 8) + F.col("_m") + F.col("_p")
    code = F.when(size.isNull() | (size == 0), "missing").when(F.substring(f, 1, 5) == F.lit(b"%PDF-"), "external").when(size > FRAME_BYTES, "frame_limit")
    code = code.when(size < m, "truncated").when(F.substring(f, 1, m) != F.lit(MAGIC), "magic").when(size < m + 8, "truncated")
    code = code.when(F.col("_m") > MANIFEST_BYTES, "manifest_limit").when(F.col("_p") > PAYLOAD_BYTES, "payload_limit")
    rows = rows.withColumn("_code", code.when(end > size, "truncated").when(end < size, "length"))
    part = lambda at, n: F.when(F.col("_code").isNull(), F.substring(f, at.cast("int"), n.cast("int")))
    rows = rows.withColumn("_text", part(F.lit(m + 9), F.col("_m")).cast("string")).withColumn("_payload", part(F.lit(m + 9) + F.col("_m"), F.col("_p")))
    rows = rows.withColumn("_json", F.when(F.is_valid_utf8("_text"), F.from_json("_text", MANIFEST)))
    whole = F.col("_json").isNotNull()
    for name in ("document_id", "revision", "source_hash", "payload_hash"):
        whole = whole & F.col(f"_json.{name}").isNotNull()
    h = F.sha2("_payload", 256)
    code = F.when(F.col("_code").isNotNull(), F.col("_code")).when(~whole, "invalid_manifest").when(F.to_json("_json") != F.col("_text"), "noncanonical_manifest")
    code = code.when(F.col("_p") == 0, "missing_payload").when((F.col("_json.payload_hash") != h) | (F.col("_json.source_hash") != h), "hash_mismatch")
    rows = rows.withColumn("_code", code)
    good = lambda c: F.when(F.col("_code").isNull(), c)
    fields = F.struct(F.col("_code").alias("code"), good(F.col("_json.document_id")).alias("document_id"), good(F.col("_json.revision")).alias("revision"), good(F.col("_payload")).alias("payload"))
    return rows.withColumn(out, fields).select(*frames.columns, out)


def recovered(decoded: DataFrame, document: Column, revision: Column, out: str = "decoded") -> Column:
    """A decoded frame's code, or document_mismatch or revision_mismatch where it isn't the expected one; a null expectation asks nothing."""
    d = decoded[out]
    return F.when(d["code"].isNotNull(), d["code"]).when(d["document_id"] != document, "document_mismatch").when(d["revision"] != revision, "revision_mismatch")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder, decoded: path, length, decoded. A file is one frame; larger ones than a frame may be are read no further, and Spark lists no empty ones."""
    rows = spark.read.format("binaryFile").load(folder)
    small = rows.where(F.col("length") <= FRAME_BYTES).select("path", "length", "content")
    large = rows.where(F.col("length") > FRAME_BYTES).select("path", "length")
    found = decode(small, "content").drop("content")
    kind = found.schema["decoded"].dataType
    return found.unionByName(large.withColumn("decoded", F.struct(F.lit("frame_limit").alias("code"), *(F.lit(None).alias(x.name) for x in kind.fields[1:])).cast(kind)))
