"""Queries over text: search, lengths, runs, checks of typed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..registry import query, read

U16 = "(length({0}) + length(regexp_replace({0}, '[\\x{{0000}}-\\x{{FFFF}}]', '', 'g')))"


@query(
    f"""
WITH p AS (SELECT doc_id, string_split(lower(text), 'th') AS parts FROM documents),
k AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS hit FROM p),
s AS (SELECT doc_id, hit, array_to_string(parts[1:hit], 'th') AS before FROM k WHERE hit <= 64)
SELECT doc_id, hit::BIGINT AS hit, {U16.format("before")}::BIGINT AS utf16_start FROM s"""
)
def find_all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 case-insensitive matches of each document (the limit is the feature)."""
    docs = read(spark, sf_dir, "documents")
    hits = text.find_all(F.col("text"), " Th ", text.HITS)
    return docs.select("doc_id", F.posexplode(hits).alias("n", "utf16_start")).select("doc_id", (F.col("n") + 1).cast("long").alias("hit"), "utf16_start")


@query(
    f"""
SELECT doc_id, {U16.format("text")}::BIGINT AS utf16_units, octet_length(encode(text))::BIGINT AS utf8_bytes, length(text)::BIGINT AS code_points,
length_grapheme(text)::BIGINT AS graphemes FROM documents"""
)
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", text.utf16_length(t).alias("utf16_units"), text.utf8_length(t).alias("utf8_bytes"), F.length(t).cast("long").alias("code_points"), F.size(text.graphemes(t)).cast("long").alias("graphemes")
    )


@query(
    """
WITH g AS (SELECT conv_id, turn, role, text, unnest(range(1, length(text) + 1)) AS i FROM conversations)
SELECT conv_id, turn, role, (i - 1)::BIGINT AS utf16_start, i::BIGINT AS utf16_end, sum(octet_length(encode(substr(text, i, 1)))) OVER (PARTITION BY conv_id, turn, role, text ORDER BY i)::BIGINT AS utf8_end FROM g"""
)
def grapheme_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the clusters of every turn, in UTF-16 units and bytes: sums of what stands before, within the row."""

    def spans(g):
        units, size = F.transform(g, text.utf16_length), F.transform(g, text.utf8_length)
        return F.arrays_zip(units.alias("units"), size.alias("size"), text.sums_before(units).alias("start"), text.sums_before(size).alias("bytes"))

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(text.let(text.graphemes(F.col("text")), spans)).alias("x"))
    x = F.col("x")
    return rows.select("conv_id", "turn", "role", x["start"].alias("utf16_start"), (x["start"] + x["units"]).alias("utf16_end"), (x["bytes"] + x["size"]).alias("utf8_end"))


@query(
    """
WITH r AS (SELECT doc_id, regexp_extract_all(text, '\\p{L}+|\\P{L}+') AS runs FROM documents),
u AS (SELECT doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS i FROM r),
s AS (SELECT doc_id, run, i, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT doc_id, start::BIGINT AS start, (start + length(run))::BIGINT AS stop FROM s WHERE regexp_matches(run, '^\\p{L}')"""
)
def word_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(start, stop) in code points of maximal runs of letters."""
    # lengths alone are shuffled; a fold within the row would be interpreted, which takes longer than the window
    runs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.runs(F.col("text"))).alias("i", "run"))
    runs = runs.select("doc_id", "i", F.length("run").alias("n"), F.col("run").rlike(r"^\p{L}").alias("word"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")
    return runs.withColumn("start", start).where("word").select("doc_id", "start", (F.col("start") + F.col("n")).alias("stop"))


@query(
    """
WITH n AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN octet_length(encode(t)) <= 4096 THEN t END AS phrase FROM n"""
)
def transcript_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalise_transcript(F.col("text")).alias("phrase"))


VARIANT = "CASE o_orderkey % 5 WHEN 0 THEN d WHEN 1 THEN replace(d, '-', '/') WHEN 2 THEN left(d, 5) || '13' || substr(d, 8) WHEN 3 THEN left(d, 8) || '31' ELSE left(d, 5) || '02-29' END"


@query(
    f"""
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
v AS (SELECT o_orderkey, {VARIANT} AS d FROM o)
SELECT o_orderkey, d AS value, regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_cast(d AS DATE) IS NOT NULL AS is_date,
regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_cast(d AS DATE) IS NOT NULL AND o_orderkey % 3 <> 0 AS is_timestamp FROM v"""
)
def date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))
    rows = rows.select("o_orderkey", F.expr(VARIANT.replace("left(d, 5)", "substr(d, 1, 5)").replace("left(d, 8)", "substr(d, 1, 8)")).alias("value"))
    stamp = F.concat("value", F.when(F.col("o_orderkey") % 3 == 0, "T24:00:00Z").otherwise("T23:59:59Z"))
    return rows.select("o_orderkey", "value", text.is_iso_date(F.col("value")).alias("is_date"), text.is_utc_timestamp(stamp).alias("is_timestamp"))


DECIMALS = "CASE o_orderkey % 6 WHEN 0 THEN t WHEN 1 THEN '+' || t WHEN 2 THEN t || '.' WHEN 3 THEN '.' || t WHEN 4 THEN '-.' || t ELSE t || '.1.2' END"


@query(
    f"""
WITH o AS (SELECT o_orderkey, o_custkey::VARCHAR AS t FROM orders), v AS (SELECT o_orderkey, {DECIMALS} AS t FROM o)
SELECT o_orderkey, t AS value, length(t) <= 128 AND regexp_matches(t, '^[+-]?[0-9]*\\.?[0-9]*$') AND NOT starts_with(t, '.') AND regexp_matches(t, '[0-9]') AS is_decimal FROM v"""
)
def decimal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("t")).select("o_orderkey", F.expr(DECIMALS).alias("value"))
    return rows.select("o_orderkey", "value", text.is_decimal(F.col("value")).alias("is_decimal"))


MAILS = "CASE c_custkey % 6 WHEN 0 THEN n || '@example.com' WHEN 1 THEN n || '@example' WHEN 2 THEN '@example.com' WHEN 3 THEN n || '@a@b.c' WHEN 4 THEN n || '@.com' ELSE n || ' x@b.c' END"


@query(
    f"""
WITH o AS (SELECT c_custkey, replace(c_name, '#', '.') AS n, '#' || upper(right(sha256(c_name), 6)) AS c FROM customer), v AS (SELECT c_custkey, {MAILS} AS m, CASE WHEN c_custkey % 4 = 0 THEN lower(c) ELSE c END AS c FROM o)
SELECT c_custkey, m AS email, regexp_matches(m, '^[^@\\s]+@[^@\\s.]([^@\\s]*[^@\\s.])?$') AND strpos(string_split(m, '@')[2], '.') > 0 AS is_email,
regexp_matches(c, '^#[0-9A-F]{{6}}$') AS is_colour, CASE WHEN regexp_matches(c, '^#[0-9A-F]{{6}}$') THEN ('0x' || substr(c, 2, 2))::INT + 256 * ('0x' || substr(c, 4, 2))::INT + 65536 * ('0x' || substr(c, 6, 2))::INT END AS packed FROM v"""
)
def contact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail and colour checks; the colour's three numbers packed into one."""
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.replace("c_name", F.lit("#"), F.lit(".")).alias("n"), F.concat(F.lit("#"), F.upper(F.right(F.sha2("c_name", 256), F.lit(6)))).alias("c")
    )
    rows = rows.select("c_custkey", F.expr(MAILS).alias("email"), F.when(F.col("c_custkey") % 4 == 0, F.lower("c")).otherwise(F.col("c")).alias("c"))
    rgb = text.colour(F.col("c"))
    return rows.select("c_custkey", "email", text.is_email(F.col("email")).alias("is_email"), rgb.isNotNull().alias("is_colour"), (rgb[0] + 256 * rgb[1] + 65536 * rgb[2]).alias("packed"))


@query(
    """
WITH v AS (SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * round(l_extendedprice * 100))::BIGINT AS n, round(l_quantity * 7)::BIGINT AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, n AS cents, d AS divisor, (CASE WHEN n < 0 THEN -1 ELSE 1 END * ((abs(n)::HUGEINT * 64 * 2 + d) // (2 * d)))::BIGINT AS units,
(CASE WHEN n < 0 THEN -1 ELSE 1 END * ((abs(n)::HUGEINT * d * 2 + 64) // 128))::BIGINT AS product,
CASE WHEN n > 0 AND n % 3 = 0 THEN NULL ELSE n + 1 END AS checked FROM v"""
)
def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion to 1/64 units, products, and an addition that overflows for some rows."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (sign * F.round(F.col("l_extendedprice") * 100)).cast("long").alias("cents"), F.round(F.col("l_quantity") * 7).cast("long").alias("divisor")
    )
    n, d = F.col("cents"), F.col("divisor")
    far = F.when((n > 0) & (n % 3 == 0), F.lit(2**63 - 1)).otherwise(F.lit(1))
    return rows.select("*", numbers.to_units(n, d).alias("units"), numbers.times(n, d).alias("product"), F.try_add(n, far).alias("checked"))


@query(
    """
SELECT doc_id, sha256(text) AS text_sha256, upper(hex(encode(text))) AS text_hex,
(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha256('node|' || source || '|' || doc_id::VARCHAR) AS h)) AS node_uuid,
coalesce(CASE WHEN doc_id % 3 = 0 THEN 'uk' END, string_split(lang || '-XX', '-')[1]) AS language FROM documents"""
)
def identity_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash, hex codec (there and back), derived identifier, language of a locale."""
    coded = F.hex(F.encode("text", "UTF-8"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), F.hex(F.unhex(coded)).alias("text_hex"), text.stable_uuid("node", F.col("source"), F.col("doc_id")).alias("node_uuid"),
        text.language(F.concat("lang", F.lit("-XX")), F.when(F.col("doc_id") % 3 == 0, F.lit("uk"))).alias("language"),
    )


# Spoken phrases and what they mean, for each locale.
PHRASES = (("en", "the", "article"), ("en", "of", "preposition"), ("en", "a", "article"), ("de", "der", "article"), ("de", "und", "conjunction"), ("fr", "la", "article"), ("fr", "le", "article"), ("es", "el", "article"), ("es", "la", "article"), ("es", "la", "pronoun"))


@query(
    f"""
WITH w AS (SELECT doc_id, lang, lower(string_split_regex(trim(text), '\\s+')[1]) AS phrase FROM documents),
p(locale, phrase, intent) AS (VALUES {", ".join(str(x) for x in PHRASES)}),
m AS (SELECT locale, phrase, count(*) AS n, min(intent) AS intent FROM p GROUP BY ALL)
SELECT doc_id, w.phrase, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE intent END AS resolved FROM w LEFT JOIN m ON locale = lang AND m.phrase = w.phrase"""
)
def phrase_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words against a phrase table: its size is fixed, so it goes to every task."""
    table = spark.createDataFrame(PHRASES, "locale string, phrase string, intent string").groupBy("locale", "phrase").agg(F.count("*").alias("n"), F.min("intent").alias("intent"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("locale"), F.lower(F.split(F.trim("text"), r"\s+").getItem(0)).alias("phrase"))
    said = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise(F.col("intent"))
    return rows.join(F.broadcast(table), ["locale", "phrase"], "left").select("doc_id", "phrase", said.alias("resolved"))


# Code ranges to text (low, high, first code point).
RANGES = ((32, 47, 32), (48, 57, 0x660), (65, 90, 0x410), (97, 122, 0x430))


@query(
    f"""
WITH r(low, high, first) AS (VALUES {", ".join(str(x) for x in RANGES)}), m AS (SELECT unnest(range(low, high + 1)) AS code, low, first FROM r),
c AS (SELECT c_custkey, unnest(string_split(c_name, '')) AS ch, unnest(range(length(c_name))) AS pos FROM customer)
SELECT c_custkey, pos::BIGINT AS pos, ord(ch)::BIGINT AS code, (first + code - low)::BIGINT AS mapped FROM c LEFT JOIN m ON ord(ch) = code"""
)
def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code ranges expanded to single codes and looked up for each character."""
    ranges = spark.createDataFrame(RANGES, "low long, high long, first long")
    codes = ranges.select(F.explode(F.sequence("low", "high")).alias("code"), "low", "first").select("code", (F.col("first") + F.col("code") - F.col("low")).alias("mapped"))
    chars = read(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.split("c_name", "")).alias("pos", "ch"))
    return chars.select("c_custkey", F.col("pos").cast("long").alias("pos"), F.ascii("ch").cast("long").alias("code")).join(F.broadcast(codes), "code", "left").select("c_custkey", "pos", "code", "mapped")


@query(
    """
WITH v AS (SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT * 640 AS x, l_quantity::BIGINT * 64 AS y, l_suppkey % 9 + 1 AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, (2 * x + 64)::BIGINT AS x1, (3 * y - 64)::BIGINT AS y1, greatest(0, least(x + 640, y + 320) - greatest(x, y))::BIGINT AS overlap,
greatest(0, greatest(x, y) - least(x + 640, y + 320))::BIGINT AS distance,
CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN greatest(0, 3000 - x) // 2 ELSE greatest(0, 3000 - x) END::BIGINT AS aligned FROM v"""
)
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affine transforms composed, overlap and distance of intervals, alignment offsets."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber").cast("long") * 640).alias("x"), (F.col("l_quantity").cast("long") * 64).alias("y"))
    lit = lambda *v: tuple(F.lit(x).cast("long") for x in v)
    x1, y1 = numbers.affine(numbers.compose(lit(2, 0, 0, 3, 0, 0), lit(1, 0, 0, 1, 64, -64)), F.col("x"), F.col("y"))
    ends = F.col("x"), F.col("x") + 640, F.col("y"), F.col("y") + 320
    how = F.element_at(F.array(F.lit("start"), F.lit("center"), F.lit("end")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", x1.alias("x1"), y1.alias("y1"), numbers.overlap(*ends).alias("overlap"), numbers.distance(*ends).alias("distance"), numbers.aligned(how, F.lit(3000).cast("long"), F.col("x")).alias("aligned"))
