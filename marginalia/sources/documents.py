"""Documents as JSON text: preflight, closed decoding, canonical encoding, versions and their migration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of a document's text, and the version that documents have now.
BYTES, DEPTH, CURRENT = 64 * 1024 * 1024, 128, 3

RUN = "struct<text:string,bold:boolean>"
BLOCKS = {
    0: "array<struct<id:string,kind:string,text:string>>",
    1: "array<struct<id:string,kind:string,styleId:string,text:string>>",
    2: f"array<struct<id:string,kind:string,styleId:string,runs:array<{RUN}>>>",
    3: f"array<struct<id:string,kind:string,styleId:string,runs:array<{RUN}>>>",
}
SCHEMAS = {v: f"schemaVersion int, documentId string, {'sections array<struct<id:string,startNodeId:string>>, ' if v == 3 else ''}content {b}" for v, b in BLOCKS.items()}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path and raw text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def depth(raw: Column) -> Column:
    """How deep brackets nest outside of strings; escapes are minded. Only brackets and quotes are walked over."""
    # escapes first, then strings: neither pattern recurses, however long a string is
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?s)\\.", ""), '"[^"]*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def preflight(rows: DataFrame) -> DataFrame:
    """rows (raw) with code: too large, too deep, not JSON, no version, a version to come, or null."""
    version = F.get_json_object("raw", "$.schemaVersion").try_cast("int")
    code = (
        F.when(F.octet_length("raw") > BYTES, "too_large")
        .when(depth(F.col("raw")) > DEPTH, "too_deep")
        .when(F.try_parse_json("raw").isNull(), "not_json")
        .when(version.isNull(), "no_version")
        .when(version > CURRENT, "future_version")
    )
    return rows.withColumn("version", version).withColumn("code", code)


def fields(version: int) -> list[str]:
    """The keys that a document of a version may have."""
    return [c.strip().split(" ")[0] for c in SCHEMAS[version].split(", ") if " " in c.strip()]


def decoded(raw: Column, version: int) -> Column:
    """A document as a struct; strict, so a malformed one is an error."""
    return F.from_json(raw, SCHEMAS[version], {"mode": "FAILFAST"})


def encode(document: Column) -> Column:
    """Compact JSON text with keys in declared order."""
    return F.to_json(document, {"ignoreNullFields": "false"})


def _to_1(d: Column) -> Column:
    block = lambda b: F.struct(b["id"].alias("id"), b["kind"].alias("kind"), F.lit("body").alias("styleId"), b["text"].alias("text"))
    return F.struct(F.lit(1).alias("schemaVersion"), d["documentId"].alias("documentId"), F.transform(d["content"], block).alias("content"))


def _to_2(d: Column) -> Column:
    runs = lambda b: F.when(b["text"] == "", F.array().cast(f"array<{RUN}>")).otherwise(F.array(F.struct(b["text"].alias("text"), F.lit(False).alias("bold"))))
    block = lambda b: F.struct(b["id"].alias("id"), b["kind"].alias("kind"), b["styleId"].alias("styleId"), runs(b).alias("runs"))
    return F.struct(F.lit(2).alias("schemaVersion"), d["documentId"].alias("documentId"), F.transform(d["content"], block).alias("content"))


def _to_3(d: Column) -> Column:
    one = F.array(F.struct(F.concat(d["documentId"], F.lit("-s0")).alias("id"), F.lit(None).cast("string").alias("startNodeId")))
    return F.struct(F.lit(3).alias("schemaVersion"), d["documentId"].alias("documentId"), one.alias("sections"), d["content"].alias("content"))


#: Hop k takes a document of version k to k + 1.
HOPS: dict[int, Callable[[Column], Column]] = {0: _to_1, 1: _to_2, 2: _to_3}


def migrate(rows: DataFrame) -> DataFrame:
    """Documents of any version (raw, version, code) at the current one: canonical text, and the hops that led there.

    In one pass: a row's version picks its schema, the keys that it may have and
    its hops. Rows with a code, and those with a key that their version doesn't
    have, are left out.
    """
    more = canonical = F.lit(None)
    keys = F.json_object_keys("raw")
    for v in SCHEMAS:
        is_v = F.col("version") == v
        d = decoded(F.col("raw"), v)
        for k in range(v, CURRENT):
            d = HOPS[k](d)
        more = F.when(is_v, F.size(F.array_except(keys, F.array(*map(F.lit, fields(v)))))).otherwise(more)
        canonical = F.when(is_v, encode(d)).otherwise(canonical)
    good = rows.where(F.col("code").isNull() & F.col("version").isin(*SCHEMAS)).where(more == 0)
    return good.withColumn("canonical", canonical).withColumn("hops", F.lit(CURRENT) - F.col("version"))


def envelope(rows: DataFrame) -> DataFrame:
    """Each record's physical key: the hash of its canonical JSON, fields sorted by name."""
    return rows.withColumn("physical_key", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256))
