"""Tables over pages, and pages kept by signature, against rules and full pagination."""

import random

from marginalia.operators import layout

SCHEMA = "doc_id long, ordinal long, kind string, lines long, table long, header boolean"


def test_header_rows_are_repeated_and_rows_stay_whole(spark):
    rows = [(1, 0, "paragraph", 6, None, None), *[(1, i, "row", 3, 7, i == 1) for i in range(1, 8)], (1, 8, "row", 25, 7, False)]
    out = sorted(map(tuple, layout.paginate_tables(spark.createDataFrame(rows, SCHEMA), 10).collect()), key=lambda r: (r[2], not r[5], r[1]))
    assert [(r[1], r[2], r[4] - r[3], r[5], r[6]) for r in out] == [
        (0, 1, 6, False, None), (1, 1, 3, False, None),
        (1, 2, 3, True, None), (2, 2, 3, False, None), (3, 2, 3, False, None),
        (1, 3, 3, True, None), (4, 3, 3, False, None), (5, 3, 3, False, None),
        (1, 4, 3, True, None), (6, 4, 3, False, None), (7, 4, 3, False, None),
        (1, 5, 3, True, None), (8, 5, 25, False, "overflow"),
    ]


def test_a_chain_of_headings_stays_with_what_follows(spark):
    rows = [(1, 0, "paragraph", 6, None, None), (1, 1, "heading", 1, None, None), (1, 2, "heading", 1, None, None), (1, 3, "row", 3, 1, True)]
    out = {r["ordinal"]: r["page"] for r in layout.paginate_tables(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    assert out == {0: 1, 1: 2, 2: 2, 3: 2}


def test_a_first_header_row_is_not_repeated_on_its_own_page(spark):
    rows = [(1, 0, "paragraph", 9, None, None), (1, 1, "row", 3, 1, True), (1, 2, "row", 3, None, True), (1, 3, "pageBreak", 0, None, None), (1, 4, "row", None, 1, True)]
    out = sorted((r["ordinal"], r["page"], r["derived"]) for r in layout.paginate_tables(spark.createDataFrame(rows, SCHEMA), 10).collect())
    assert out == [(0, 1, False), (1, 2, False), (2, 2, False), (3, 2, False), (4, 3, False)]


def test_kept_pages_and_a_folded_rest_are_full_pagination(spark):
    rng = random.Random(5)
    kinds = ["paragraph"] * 5 + ["heading"] * 2 + ["pageBreak"]
    before = [(d, i, k := rng.choice(kinds), 0 if k == "pageBreak" else rng.randint(1, 14)) for d in range(60) for i in range(rng.choice((1, 3, 40)))]
    after = []
    for d, i, k, n in before:
        cut = {0: None, 1: 0, 2: 20, 3: 37, 4: 1, 5: 2}[d % 6]
        if cut is not None and i == cut and rng.random() < 0.8:
            k, n = rng.choice([("paragraph", 3), ("heading", 2), ("pageBreak", 0)])
        if d % 6 == 4 and i == 39:
            continue
        if d != 59:
            after.append((d, i, k, n))
    after += [(100, i, "paragraph", 5) for i in range(4)]
    schema = "doc_id long, ordinal long, kind string, lines long"
    a, b = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    pages, used = layout.repaginate(a, layout.paginate(a, 10), b, 10)
    assert sorted(map(tuple, pages.select("doc_id", "ordinal", "page", "first_line", "last_line").collect())) == sorted(map(tuple, layout.paginate(b, 10).collect()))
    folded = {r["doc_id"]: (r["blocks"], r["folded"]) for r in used.collect()}
    assert all(folded[d][1] == 0 for d in range(0, 54, 6))
    assert all(n < m / 2 for d, (m, n) in folded.items() if d % 6 == 3 and d < 59 and m == 40)
    assert folded[100] == (4, 4) and 59 not in folded
