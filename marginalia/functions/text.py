"""Text functions as column expressions. Offsets name their unit: code points, UTF-16 units, or UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the text functions.
HITS, TRANSCRIPT_BYTES, EMAIL_BYTES, DECIMAL_CHARS = 64, 4096, 320, 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(numbers: Column) -> Column:
    """For an array of whole numbers, the sum of those before each; summed up in blocks, so that a long array takes little more than linear time."""
    block = 256
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(xs: Column) -> Column:
        part = lambda b: F.slice(xs, b * block + 1, F.lit(block))
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / block).cast("int")), lambda b: total(part(b)))
        earlier = let(sums, lambda s: F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i))))

        def within(before: Column, b: Column) -> Column:
            start = F.struct(before.alias("at"), F.array().cast("array<bigint>").alias("out"))
            return F.aggregate(part(b), start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]

        return F.flatten(F.transform(earlier, within))

    return let(numbers, of)


def utf16_length(text: Column) -> Column:
    """Number of UTF-16 code units; null for null."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def utf8_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def utf16_to_bytes(text: Column, offset: Column) -> Column:
    """The UTF-8 byte offset of a UTF-16 offset; null where it is out of range or splits a surrogate pair."""
    units = F.transform(F.split(text, ""), lambda c: F.struct(utf16_length(c).alias("u"), utf8_length(c).alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("b"))
    at = F.aggregate(units, start, lambda a, c: F.when(a["u"] >= offset, a).otherwise(F.struct((a["u"] + c["u"]).alias("u"), (a["b"] + c["b"]).alias("b"))))
    return F.when((offset >= 0) & (at["u"] == offset), at["b"])


def bytes_to_utf16(text: Column, offset: Column) -> Column:
    """The UTF-16 offset of a byte offset; null where it isn't a character boundary."""
    units = F.transform(F.split(text, ""), lambda c: F.struct(utf16_length(c).alias("u"), utf8_length(c).alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("b"))
    at = F.aggregate(units, start, lambda a, c: F.when(a["b"] >= offset, a).otherwise(F.struct((a["u"] + c["u"]).alias("u"), (a["b"] + c["b"]).alias("b"))))
    return F.when((offset >= 0) & (at["b"] == offset), at["u"])


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters in order (by the tables of the JVM)."""
    return F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1))


def replace_units(text: Column, start: Column, stop: Column, new: Column, expected: Column | None = None) -> tuple[Column, Column]:
    """text with [start, stop) in UTF-16 units replaced, and why that can't be done (null where it can; the text is then as it was).

    invalid_range: not a range of the text; invalid_utf16_boundary: an end splits
    a surrogate pair; invalid_grapheme_boundary: an end splits a cluster;
    broken_invariant: the range doesn't hold `expected`; no_op: it holds new.
    """

    def of(clusters: Column) -> Column:
        lengths = F.transform(clusters, utf16_length)
        bounds = F.array_append(sums_before(lengths), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x))

        def place(b: Column) -> Column:
            i, j = (F.array_position(b, x.cast("long")).cast("int") for x in (start, stop))
            end = F.element_at(b, F.lit(-1))
            old = F.array_join(F.slice(clusters, F.greatest(i, F.lit(1)), F.greatest(j - i, F.lit(0))), "")
            splits = lambda x: ~utf16_to_bytes(text, x.cast("long")).isNotNull()
            code = (
                F.when(~F.coalesce((start >= 0) & (start <= stop) & (stop <= end), F.lit(False)), "invalid_range")
                .when(splits(start) | splits(stop), "invalid_utf16_boundary")
                .when((i == 0) | (j == 0), "invalid_grapheme_boundary")
                .when(old != (F.lit(None).cast("string") if expected is None else expected), "broken_invariant")
                .when(old == new, "no_op")
            )
            done = F.concat(F.array_join(F.slice(clusters, F.lit(1), F.greatest(i - 1, F.lit(0))), ""), new, F.array_join(F.slice(clusters, F.greatest(j, F.lit(1)), F.size(clusters)), ""))
            return F.struct(F.when(code.isNull(), done).otherwise(text).alias("text"), code.alias("code"))

        return let(bounds, place)

    found = let(graphemes(text), of)
    return found["text"], found["code"]


def find_all(text: Column, query: str, most: int | None = None) -> Column:
    """UTF-16 starts, in the lower-cased text, of a query's matches from left to right without overlap; of the first `most` of them."""
    q = query.strip().lower()
    if not q:
        return F.array().cast("array<bigint>")
    parts = F.split(F.lower(text), re.escape(q).replace("\\ ", " "), -1 if most is None else most + 1)
    own = len(q.encode("utf-16-le")) // 2
    # a match begins after all parts and matches before it
    lengths = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), utf16_length)
    return let(lengths, lambda xs: F.zip_with(xs, sums_before(F.transform(xs, lambda x: x + own)), lambda x, before: before + x))


def runs(text: Column) -> Column:
    """A text as runs of letters and runs of others, in turn."""
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))


def normalise_transcript(text: Column) -> Column:
    """White space squeezed, ends trimmed, lower case; null over the size limit."""
    out = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(F.octet_length(out) <= TRANSCRIPT_BYTES, out)


def is_iso_date(text: Column) -> Column:
    """YYYY-MM-DD of a day that exists, after year 0."""
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~text.startswith("0000") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_utc_timestamp(text: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of a second that exists."""
    clock = F.substring(text, 12, 8).rlike("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$")
    return F.coalesce((F.length(text) == 20) & is_iso_date(F.substring(text, 1, 10)) & (F.substring(text, 11, 1) == "T") & clock & (F.substring(text, 20, 1) == "Z"), F.lit(False))


def is_decimal(text: Column) -> Column:
    """A sign or none, digits with at most one point that isn't first; 1. and +.5 count."""
    return F.coalesce((F.length(text) <= DECIMAL_CHARS) & text.rlike(r"^[+-]?[0-9]*\.?[0-9]*$") & ~text.startswith(".") & text.rlike("[0-9]"), F.lit(False))


def is_email(text: Column) -> Column:
    """One @, something before it, and after it a point that isn't at an end; no white space."""
    return F.coalesce((F.octet_length(text) <= EMAIL_BYTES) & text.rlike(r"^[^@\s]+@[^@\s.]([^@\s]*[^@\s.])?$") & F.split(text, "@").getItem(1).contains("."), F.lit(False))


def colour(text: Column) -> Column:
    """#RRGGBB in upper case to three numbers; null for others."""
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("int")
    return F.when(text.rlike("^#[0-9A-F]{6}$"), F.array(part(2), part(4), part(6)))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of columns as JSON text, keys in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def stable_uuid(kind: str, seed: Column, index: Column) -> Column:
    """A version-4 shaped identifier from a kind, a seed and an index."""
    h = F.sha2(F.concat_ws("|", F.lit(kind), seed, index.cast("string")), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def language(locale: Column, explicit: Column) -> Column:
    """The explicit language, else what stands before the locale's first hyphen."""
    return F.coalesce(explicit, F.split(locale, "-").getItem(0))
