"""Queries on small tables written for the case, against their SQL or against each other."""

import duckdb

import __spark_entry__ as entry


def tables(folder, **sql):
    c = duckdb.connect()
    for name, select in sql.items():
        c.execute(f"COPY ({select}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return c


def both(spark, folder, name, c):
    got = entry.queries()[name](spark, str(folder))
    want = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    return sorted(map(tuple, got.select(*columns).collect()), key=str), sorted(want.fetchall(), key=str)


def test_lines_alike_have_one_order(spark, tmp_path):
    lines = "SELECT 1::BIGINT AS l_orderkey, 1 AS l_linenumber, 7::BIGINT AS l_partkey, q::DOUBLE AS l_quantity, 'R' AS l_returnflag FROM (VALUES {}) t(q)"
    found = []
    for i, values in enumerate(("(3), (5), (8)", "(8), (3), (5)", "(5), (8), (3)")):
        (tmp_path / str(i)).mkdir()
        tables(tmp_path / str(i), lineitem=lines.format(values))
        found.append(sorted(r["room"] for r in entry.queries()["keep_with_next"](spark, str(tmp_path / str(i))).collect()))
    assert found == [[8, 8, 13]] * 3


def test_receipts_round_seconds(spark, tmp_path):
    at = "(0, 1, 'view', 400000), (1, 1, 'click', 300600000), (2, 2, 'view', 500000), (3, 2, 'click', 300500000), (4, 3, 'view', 1500000), (5, 3, 'click', 302400000), (6, 4, 'view', 700000), (7, 4, 'click', 301300000)"
    c = tables(tmp_path, events=f"SELECT i::BIGINT AS event_id, make_timestamp(1704067200000000 + us::BIGINT) AS ts, u::BIGINT AS user_id, k AS event_type FROM (VALUES {at}) t(i, u, k, us)")
    got, want = both(spark, tmp_path, "stream_receipts", c)
    assert got == want and {r[2] for r in got} == {"issued", "ok", "expired"}
