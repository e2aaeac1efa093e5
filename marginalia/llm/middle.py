"""Fill in the middle over an index of distinct texts.

A text's cut places are the ends of its lines. They are found once for each
distinct text: texts are grouped by content (SHA-256 and length in bytes), the
first of a task's equal texts gives the list of its line ends in Elias-Fano
form, and lists of equal texts are merged before they are joined back to the
documents. A document's two cuts are seeded by its doc_id and are selects on that
list, so copies of a text are cut in different places without being split again.

Only digests, lengths and lists cross the shuffle of the index; a text crosses one, to
meet its list. Copies of one text, however many, are a skewed side of that join,
which adaptive execution splits, and the other side has one row for them.

A text is plain (returned as it is) when it is empty, holds one of the marks, or
isn't drawn at the given rate. A null text counts as empty and a null doc_id as
the empty string; rows that share a doc_id are cut by the same draws. Other
columns may have any name and are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Distinct contents that a task remembers; a content forgotten is listed once more and merged later.
REMEMBERED = 100_000


def encode(ends: np.ndarray) -> bytes:
    """A non-decreasing list of numbers in Elias-Fano form: its length, the low bits' width, the high bits in unary, the low bits packed."""
    n = len(ends)
    if not n:
        return b""
    low = max(0, (int(ends[-1]) // n).bit_length() - 1)
    unary = np.zeros((int(ends[-1]) >> low) + n, np.uint8)
    unary[(ends >> low) + np.arange(n)] = 1
    upper = np.packbits(unary, bitorder="little")
    bits = (ends[:, None] >> np.arange(low)) & 1
    head = np.array([n, low, len(upper)], "<u4").tobytes()
    return head + upper.tobytes() + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def select(ends: bytes, i: int) -> int:
    """The i-th number of a list; 0 before the first (i = -1)."""
    if i < 0:
        return 0
    n, low, size = np.frombuffer(ends, "<u4", 3).tolist()
    upper = np.frombuffer(ends, np.uint8, size, 12)
    ones = np.cumsum(np.bitwise_count(upper), dtype=np.int64)
    byte = int(np.searchsorted(ones, i, "right"))
    before = int(ones[byte - 1]) if byte else 0
    place = byte * 8 + int(np.flatnonzero(np.unpackbits(upper[byte : byte + 1], bitorder="little"))[i - before])
    bit = low * i
    packed = int.from_bytes(ends[12 + size + bit // 8 : 12 + size + (bit + low) // 8 + 1], "little") >> (bit % 8)
    return (place - i << low) + (packed & ((1 << low) - 1))


def index(contents: DataFrame) -> DataFrame:
    """Of rows (digest, bytes, chars, lengths of lines) one a content: digest, bytes, number of lines, their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            digests, sizes, chars, lengths = (batch.column(i) for i in range(4))
            flat, offsets = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths.offsets.to_numpy() - lengths.offsets[0].as_py()
            for k, (digest, size, total) in enumerate(zip(digests.to_pylist(), sizes.to_pylist(), chars.to_pylist())):
                if digest in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(digest)
                parts = flat[offsets[k] : offsets[k + 1]]
                # the last line has no line feed, and is none when it's empty
                ends = np.minimum(np.cumsum(parts + 1), total)[: len(parts) - (parts[-1] == 0)]
                rows.append((digest, size, len(ends), encode(ends)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["digest", "bytes", "n", "ends"])

    found = contents.mapInArrow(run, "digest binary, bytes long, n long, ends binary")
    return found.groupBy("digest", "bytes").agg(F.min("n").alias("n"), F.min("ends").alias("ends"))


def draw(doc_id: str | Column, group: int, seed: int = SEED) -> Column:
    """The group-th number (from 1) of a document: eight hexadecimal digits of a seeded hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = SEED, out: str = "fim") -> DataFrame:
    """docs and a struct: n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output (the text to train on).

    rate is the share of texts in a hundred that are cut, spm the share of those
    with the suffix first.
    """

    @F.pandas_udf("first long, second long")
    def selected(lists: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for found, *both in lists:
            yield pd.DataFrame({name: [select(e, i - 1) for e, i in zip(found, of)] for name, of in zip(("first", "second"), both)}, dtype="int64")

    ends, digest, size, n, cuts = (free(docs, x) for x in ("_ends", "_digest", "_bytes", "_n", "_cuts"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({digest: F.unhex(F.sha2(text.cast("binary"), 256)), size: F.octet_length(text).cast("long")})
    lines = index(keyed.select(digest, size, F.length(text).cast("long"), F.transform(F.split(text, "\n", -1), F.length)).toDF("digest", "bytes", "chars", "lengths"))
    rows = keyed.join(lines.toDF(digest, size, n, ends), [digest, size])

    first, second = (F.pmod(draw("doc_id", k, seed), F.col(n) + 1) for k in (1, 2))
    rows = rows.withColumn(cuts, selected(ends, F.least(first, second), F.greatest(first, second)))
    a, b = F.col(f"{cuts}.first").cast("int"), F.col(f"{cuts}.second").cast("int")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (draw("doc_id", 3, seed) % 100 >= rate), "plain").when(draw("doc_id", 4, seed) % 100 < spm, "spm").otherwise("psm")
    prefix, middle, suffix = F.substr(text, F.lit(1), a), F.substr(text, a + 1, b - a), F.substr(text, b + 1)
    output = (
        F.when(F.col(f"{cuts}.form") == "plain", text)
        .when(F.col(f"{cuts}.form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    rows = rows.withColumn(cuts, F.struct(f"{cuts}.first", f"{cuts}.second", form.alias("form")))
    cut = F.col(f"{cuts}.form") != "plain"
    rows = rows.withColumn(
        out,
        F.struct(
            F.col(n).alias("n"),
            F.col(f"{cuts}.form").alias("form"),
            F.when(cut, a.cast("long")).alias("prefix_chars"),
            F.when(cut, (b - a).cast("long")).alias("middle_chars"),
            output.alias("output"),
        ),
    )
    return rows.drop(ends, digest, size, n, cuts)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone: a text that is cut holds no mark, so the marks part it."""
    parts = F.split(output, "<[PSM]>", -1)
    prefix, suffix, middle = (F.when(form == "psm", F.get(parts, F.lit(i))).otherwise(F.get(parts, F.lit(j))) for i, j in ((1, 2), (2, 1), (3, 3)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def digest(cut: DataFrame, fim: str = "fim") -> DataFrame:
    """What tells outputs apart: sizes and hashes."""
    at = lambda name: F.col(f"{fim}.{name}")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return cut.select("doc_id", at("n"), at("form"), at("prefix_chars"), at("middle_chars"), sha(at("output")).alias("output_sha256"), sha(restored(at("output"), at("form"))).alias("restored_sha256"))


def oracle(seed: int = SEED) -> str:
    h = lambda k: f"('0x' || substr(sha256('{seed}:' || CAST(doc_id AS VARCHAR)), {8 * k - 7}, 8))::BIGINT"
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts, {h(1)} AS h1, {h(2)} AS h2, {h(4)} AS h4 FROM documents
), lined AS (
  SELECT *, len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS n FROM split
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM lined
), placed AS (
  SELECT *, least(length(t), length(array_to_string(parts[1:a], chr(10))) + CASE WHEN a > 0 THEN 1 ELSE 0 END)::BIGINT AS pa, least(length(t), length(array_to_string(parts[1:b], chr(10))) + CASE WHEN b > 0 THEN 1 ELSE 0 END)::BIGINT AS pb
  FROM cut
), made AS (
  SELECT *, substr(t, 1, pa) AS p, substr(t, pa + 1, pb - pa) AS m, substr(t, pb + 1) AS s FROM placed
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN pa END AS prefix_chars, CASE WHEN form <> 'plain' THEN pb - pa END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM made"""
