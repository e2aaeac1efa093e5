"""Metamorphic and property tests: laws that hold whatever the rows are."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import commands, identity, log

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
WORDS = st.text(alphabet="aé😀b \n", max_size=12)


@FEW
@given(st.lists(st.tuples(WORDS, st.integers(0, 12), st.integers(0, 5), WORDS), min_size=1, max_size=12))
def test_splice_has_an_inverse(spark, rows):
    """A replacement undone by its inverse gives the text again."""
    rows = [(t, min(s, len(t)), min(s + n, len(t)), new) for t, s, n, new in rows]
    df = spark.createDataFrame(rows, "t string, s int, e int, new string")
    after = commands.splice(F.col("t"), F.col("s"), F.col("e"), F.col("new"))
    old = F.substring("t", F.col("s") + 1, F.col("e") - F.col("s"))
    df = df.withColumn("after", after).withColumn("back", commands.splice(F.col("after"), F.col("s"), F.col("s") + F.length("new"), old))
    for r in df.collect():
        assert r["after"] == r["t"][: r["s"]] + r["new"] + r["t"][r["e"] :]
        assert r["back"] == r["t"]


@FEW
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["a", "b", None])), max_size=20))
def test_dedupe_is_idempotent(spark, rows):
    df = spark.createDataFrame(rows, "k long, c string")
    good, bad = identity.dedupe(df, ["k"], F.col("c"))
    again, none = identity.dedupe(good, ["k"], F.col("c"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, good.collect()), key=str) and none.count() == 0
    assert {r["k"] for r in good.collect()} | {r["k"] for r in bad.collect()} == {k for k, _ in rows}


@FEW
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=25), st.sets(st.integers(1, 25), min_size=1))
def test_checkpoints_never_change_the_head(spark, values, marks):
    """Recovery from any snapshot gives what replaying all gives."""
    rows = [(1, i + 1, v, sum(values[: i + 1])) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc long, revision long, v long, state long")
    snapshots = df.where(F.col("revision").isin(sorted(marks)))
    newest = log.newest_valid(snapshots, "doc", [F.desc("revision")], F.lit(True)).select("doc", F.col("revision").alias("base_revision"), "state")
    for r in log.recover(df, newest, "doc", "revision", F.col("v")).collect():
        assert (r["revision"], r["state"]) == (len(values), sum(values))


@FEW
@given(st.lists(st.tuples(WORDS, st.sampled_from(["x", "y", None])), max_size=8), st.integers(0, 20), st.integers(0, 20))
def test_marks_keep_the_text(spark, runs, a, b):
    a, b = min(a, b), max(a, b)
    df = spark.createDataFrame([(runs,)], f"runs {commands.RUNS}")
    out = df.select(commands.mark_runs(F.col("runs"), F.lit(a), F.lit(b), F.lit("new")).alias("r")).first()["r"]
    whole = "".join(t for t, _ in runs)
    assert "".join(r["text"] for r in out) == whole
    marks = [m for t, m in runs for _ in t]
    assert [r["mark"] for r in out for _ in r["text"]] == ["new" if a <= i < b else m for i, m in enumerate(marks)]
    assert all(p["mark"] != q["mark"] for p, q in zip(out, out[1:])) and all(r["text"] for r in out)


@FEW
@given(st.lists(WORDS, min_size=1, max_size=10))
def test_offsets_go_there_and_back(spark, texts):
    df = spark.createDataFrame([(t, i) for t in texts for i in range(len(t.encode("utf-16-be")) // 2 + 2)], "t string, o long")
    rows = df.withColumn("b", text.utf16_to_bytes(F.col("t"), F.col("o"))).withColumn("back", text.bytes_to_utf16(F.col("t"), F.col("b"))).collect()
    for r in rows:
        units = r["t"].encode("utf-16-be")
        try:
            want = len(units[: 2 * r["o"]].decode("utf-16-be").encode()) if 2 * r["o"] <= len(units) else None
        except UnicodeDecodeError:
            want = None
        assert r["b"] == want and (want is None or r["back"] == r["o"])


@FEW
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=20))
def test_anchors_follow_their_character(spark, rows):
    """An offset after an edit stands before the same character as it did."""
    df = spark.createDataFrame(rows, "o long, s long, r long, i long")
    for row in df.withColumn("to", commands.map_offset(F.col("o"), F.lit("forward"), F.col("s"), F.col("r"), F.col("i"))).collect():
        o, s, r, i, to = row
        chars = list(range(40))
        edited = chars[:s] + [None] * i + chars[s + r :]
        if s < o < s + r:
            assert to is None
        elif not (o == s and r > 0):
            assert edited[to] == o
