"""Queries over anchors under chains of edits. A user's events are a document's revisions, one edit each, and each event is an anchor too, set at its revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors
from ..registry import query, read  # noqa: F401
from .log_queries import LOG, log_of


def edits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, revision, seq, map): text edits, splits, merges, deletions and replacements across blocks."""
    e = F.col("event_id")
    node = lambda k: F.concat(F.lit("n"), F.pmod(F.floor(e / 6) + k, F.lit(9)).cast("string"))
    number = lambda n: e % n
    kind = e % 6
    made = (
        F.when(kind < 2, anchors.text_edit(node(0), number(40), number(4), number(5)))
        .when(kind == 2, anchors.split(node(0), F.concat(F.lit("e"), e.cast("string")), number(30)))
        .when(kind == 3, anchors.merge(node(0), node(1), number(50)))
        .when((kind == 4) & (e % 7 == 0), anchors.delete(node(0)))
        .when(kind == 5, anchors.across(node(0), number(10), number(10) + number(15), node(1), number(12), F.array(node(2)), number(6)))
        .otherwise(F.array().cast(f"array<{anchors.PIECE}>"))
    )
    return log_of(spark, sf_dir).select("user_id", "revision", F.lit(0).alias("seq"), made.alias("map"))


STEP = """CASE WHEN t < 2 AND node = n0 AND r = 0 THEN CASE WHEN p <= 2 * s THEN [node, p] ELSE [node, p + 2 * m] END
WHEN t < 2 AND node = n0 THEN CASE WHEN p <= 2 * s THEN [node, p] WHEN p = 2 * s + 1 AND m > 0 THEN [node, p + 2 * m - 1] WHEN p = 2 * (s + r) AND m > 0 THEN [node, 2 * s + 1] WHEN p > 2 * (s + r) THEN [node, p + 2 * (m - r)] END
WHEN t = 2 AND node = n0 AND p > 2 * c THEN ['e' || event_id, p - 2 * c]
WHEN t = 3 AND node = n1 THEN [n0, p + 2 * g]
WHEN t = 4 AND node = n0 AND event_id % 7 = 0 THEN NULL
WHEN t = 5 AND node = n0 THEN CASE WHEN p <= 2 * a THEN [node, p] WHEN p = 2 * a + 1 THEN [node, p + 2 * k] WHEN p < 2 * b THEN NULL ELSE [node, p + 2 * (a + k - b)] END
WHEN t = 5 AND node = n1 THEN CASE WHEN p < 2 * f THEN NULL ELSE [n0, p + 2 * (a + k - f)] END
WHEN t = 5 AND node = n2 THEN NULL ELSE [node, p] END"""
for _word in ("node, ", "n0, ", "'e' || event_id, "):
    STEP = STEP.replace("[" + _word, "struct_pack(node := " + _word.removesuffix(", ") + ", p := ")
STEP = STEP.replace("]", ")")


@query(
    "WITH RECURSIVE "
    + LOG.strip().removeprefix("WITH ")
    + f""", heads AS (SELECT user_id, max(revision) AS head FROM log GROUP BY user_id),
edits AS (SELECT user_id, revision, event_id, event_id % 6 AS t, 'n' || ((event_id // 6) % 9) AS n0, 'n' || ((event_id // 6 + 1) % 9) AS n1, 'n' || ((event_id // 6 + 2) % 9) AS n2, event_id % 40 AS s, event_id % 4 AS r, event_id % 5 AS m,
event_id % 30 AS c, event_id % 50 AS g, event_id % 10 AS a, event_id % 10 + event_id % 15 AS b, event_id % 12 AS f, event_id % 6 AS k FROM log),
w AS (SELECT user_id, event_id AS anchor, revision AS i, CASE WHEN event_id % 3 = 0 THEN revision + (head - revision) // 2 ELSE head END AS upto, 'n' || (event_id % 9) AS node, (event_id % 60) * 2 + event_id % 2 AS p FROM log JOIN heads USING (user_id)
UNION ALL SELECT user_id, anchor, i, upto, z.node, z.p FROM (SELECT w.user_id, w.anchor, e.revision AS i, w.upto, {STEP} AS z FROM (SELECT *, node AS _n FROM w) w JOIN edits e ON e.user_id = w.user_id AND e.revision = w.i + 1 AND w.i < w.upto AND w.node IS NOT NULL) x)
SELECT anchor, arg_max(node, i) FILTER (node IS NOT NULL AND i = upto) AS to_node, max(p // 2) FILTER (node IS NOT NULL AND i = upto) AS to_offset,
max(CASE WHEN p % 2 = 1 THEN 'forward' ELSE 'backward' END) FILTER (node IS NOT NULL AND i = upto) AS to_affinity FROM w GROUP BY anchor"""
)
def anchor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's anchor at its document's head (for every third, half way there), by composed maps of runs of revisions."""
    rows = log_of(spark, sf_dir)
    heads = rows.groupBy("user_id").agg(F.max("revision").alias("head"))
    most = heads.agg(F.max("head")).first()[0] or 1
    e = F.col("event_id")
    upto = F.when(e % 3 == 0, F.col("revision") + F.floor((F.col("head") - F.col("revision")) / 2)).otherwise(F.col("head"))
    places = rows.join(heads, "user_id").select(
        "user_id", e.alias("anchor"), F.concat(F.lit("n"), (e % 9).cast("string")).alias("node"), (e % 60).alias("offset"), F.when(e % 2 == 1, "forward").otherwise("backward").alias("affinity"), F.col("revision").alias("at"), upto.alias("upto")
    )
    return anchors.chained(places, edits_of(spark, sf_dir), "user_id", "revision", "seq", "map", most).select("anchor", "to_node", "to_offset", "to_affinity")
