"""URL filters: fixed rules, then a path-template tree judged by labelled purity. DataFrame functions only.

Each host has a tree of path segments. Level by level, a node's child is judged
against its siblings where both have LEAST labelled pages or more: it differs
when its share of bad pages does (a two-proportion test at Z), else it is alike.
Children become one wildcard when they are alike, and where they vary (at least
FAN different ones, none with half of the rows) also those that can't be judged.
A child that differs stays literal however many siblings it has, and so does one
that can't be judged beside few. Levels go on until no path has a further
segment; those past LEVELS are one. Templates are the resulting paths; one is
rejected when its bad share, smoothed with PRIOR rows of the overall share, is at
least REJECT.

Counting works on distinct (host, path) rows, so a host with a third of all
pages is reduced before any shuffle by partial sums. Null urls and urls without
:// have empty host and path, and one template. Repeated rows are each judged.
A page without a label counts for variety only. No labels: nothing is rejected.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

# Fixed values: (verdict, host and all its subdomains, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
LEVELS, FAN, LEAST, Z, PRIOR, REJECT = 12, 5, 5, 2.0, 5.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """host and path of a url."""
    there = F.instr(url, "://") > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(there, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(there, path).otherwise("")


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (like net/de/), and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame) -> DataFrame:
    """paths (host, path, n, labelled, bad; host and path distinct) with each one's template."""
    rows = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    whole = []
    for level in range(LEVELS):
        whole.append(rows.where(F.size("segments") <= level).drop("segments"))
        rows = rows.where(F.size("segments") > level)
        if level and rows.isEmpty():  # kept below, so this only looks for a row
            break
        rows = rows.withColumn("child", F.get("segments", F.lit(level)) if level < LEVELS - 1 else F.array_join(F.slice("segments", level + 1, 1 << 30), "/"))
        nodes = rows.groupBy("host", "template", "child").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        up = nodes.groupBy("host", "template").agg(
            F.count("*").alias("fan"), F.sum("n").alias("all"), F.max("n").alias("top"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
        )
        rest = F.col("all_labelled") - F.col("labelled")
        p = F.col("all_bad") / F.col("all_labelled")
        gap = F.col("bad") / F.col("labelled") - (F.col("all_bad") - F.col("bad")) / rest
        spread = p * (1 - p) * (1 / F.col("labelled") + 1 / rest)
        known = (F.col("labelled") >= LEAST) & (rest >= LEAST)
        differs = known & F.when(known, (spread > 0) & (gap * gap >= Z * Z * spread)).otherwise(False)
        varied = (F.col("fan") >= FAN) & (2 * F.col("top") < F.col("all"))
        segment = F.when((known | varied) & ~differs, F.lit("/*")).otherwise(F.concat(F.lit("/"), "child"))
        found = nodes.join(up, ["host", "template"]).select("host", "template", "child", segment.alias("segment"))
        rows = rows.join(found, ["host", "template", "child"]).withColumn("template", F.concat("template", "segment")).drop("segment", "child")
        rows = keep(rows, "templates")
    return functools.reduce(DataFrame.unionByName, whole, rows.drop("segments"))


def judged(pages: DataFrame, labels: DataFrame, bad: str = "quality", bad_value: int = 0) -> DataFrame:
    """page_id, host, path, rule, verdict, template and its smoothed bad share, for each page."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.where(F.col(bad).isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.min((F.col(bad) == bad_value).cast("long")).alias("is_bad"))
    counted = rows.join(marks, "page_id", "left").groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad")
    )
    found = templates(keep(counted, "paths"))
    overall = found.agg(F.sum("bad"), F.sum("labelled")).first()
    share = (overall[0] or 0) / overall[1] if overall[1] else 0.0
    purity = (F.sum("bad") + PRIOR * share) / (F.sum("labelled") + PRIOR)
    each = found.groupBy("host", "template").agg(purity.alias("bad_share"))
    of_path = found.select("host", "path", "template").join(each, ["host", "template"])
    rule, verdict = ruled(F.col("host"), F.col("path"))
    method = F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")
    return rows.join(of_path, ["host", "path"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", F.round("bad_share", 9).alias("bad_share"))


def oracle() -> str:
    """The same in SQL."""
    levels = ""
    for k in range(LEVELS):
        child = f"segments[{k + 1}]" if k < LEVELS - 1 else f"array_to_string(segments[{k + 1}:], '/')"
        levels += f"""
, c{k} AS MATERIALIZED (SELECT *, {child} AS child FROM t{k} WHERE len(segments) > {k})
, n{k} AS MATERIALIZED (SELECT host, template, child, sum(n) n, sum(labelled) labelled, sum(bad) bad FROM c{k} GROUP BY ALL)
, u{k} AS MATERIALIZED (SELECT host, template, count(*) fan, sum(n) al, max(n) top, sum(labelled) al_l, sum(bad) al_b FROM n{k} GROUP BY ALL)
, v{k} AS MATERIALIZED (SELECT n{k}.*, labelled >= {LEAST} AND al_l - labelled >= {LEAST} AS known, fan >= {FAN} AND 2 * top < al AS varied,
  bad / labelled - (al_b - bad) / (al_l - labelled) AS gap, al_b / al_l * (1 - al_b / al_l) * (1 / labelled + 1 / (al_l - labelled)) AS spread FROM n{k} JOIN u{k} USING (host, template))
, w{k} AS MATERIALIZED (SELECT host, template, child, CASE WHEN (known OR varied) AND NOT (known AND coalesce(spread > 0 AND gap * gap >= {Z * Z} * spread, false)) THEN '/*' ELSE '/' || child END AS segment FROM v{k})
, t{k + 1} AS MATERIALIZED (SELECT host, path, n, labelled, bad, segments, template || segment AS template FROM c{k} JOIN w{k} USING (host, template, child)
  UNION ALL SELECT * FROM t{k} WHERE len(segments) <= {k})"""
    rule = verdict = "NULL"
    for what, of, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{start}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{of}{start}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)
, p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r)
, m AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS is_bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)
, t0 AS MATERIALIZED (SELECT host, path, count(*)::DOUBLE n, count(is_bad)::DOUBLE labelled, coalesce(sum(is_bad), 0)::DOUBLE bad, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, '' AS template FROM p LEFT JOIN m USING (page_id) GROUP BY host, path)
{levels}
, o AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS share FROM t{LEVELS})
, e AS (SELECT host, template, (sum(bad) + {PRIOR} * any_value(share)) / (sum(labelled) + {PRIOR}) AS bad_share FROM t{LEVELS}, o GROUP BY host, template)
SELECT page_id, p.host AS host, p.path AS path, {rule.replace("host", "p.host").replace("path,", "p.path,")} AS rule,
  coalesce({verdict.replace("host", "p.host").replace("path,", "p.path,")}, CASE WHEN bad_share >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, t.template AS template, round(bad_share, 9) AS bad_share
FROM p JOIN t{LEVELS} t ON p.host = t.host AND p.path = t.path JOIN e ON e.host = t.host AND e.template = t.template"""
