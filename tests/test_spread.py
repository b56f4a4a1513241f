"""Work of long rows is dealt out to all tasks, steps are computed once and words move seldom."""

import os

import pytest

import __spark_entry__
from paperledger.functions import text as X
from paperledger.operators import extract

SF = "/root/testdata/sf0.001"


def test_texts_of_a_small_file_are_spread(spark):
    """A file of few bytes is one task, and all its texts were searched in it."""
    docs = spark.range(8).coalesce(1).selectExpr("id as doc_id", "'Итого 5,00' as text")
    assert extract.extract_fields(docs).rdd.getNumPartitions() >= 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_confidence_extracts_once(spark):
    """Fields were extracted for themselves and again as the rules' fields."""
    plan = __spark_entry__.queries()["r9_confidence"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("locate(") == 0


def test_lines_are_lowered_with_their_text(spark):
    rows = spark.createDataFrame([("Ёлка\nИТОГО: Σ\n\n№ 5",), ("",), (None,)], "t string")
    got = [r.x for r in rows.select(X.lines_and_low("t").alias("x")).collect()]
    assert [(a.line, a.low) for a in got[0]] == [("Ёлка", "елка"), ("ИТОГО: Σ", "итого: σ"), ("", ""), ("№ 5", "№ 5")]
    assert [(a.line, a.low) for a in got[1]] == [("", "")] and got[2] is None
    for captions in (extract.VAT_SUMS, extract.NET_SUMS, extract.TITLES):
        both = rows.select(X.behind(X.F.col("t"), captions).alias("a"), X.behind(X.F.col("t"), captions, X.lower_e(X.F.col("t"))).alias("b")).collect()
        assert all(r.a == r.b for r in both)


def words(spark):
    return spark.createDataFrame([(d, 1, k, f"w{k}", 100.0 * (k % 5), 40.0 * (k // 5), 100.0 * (k % 5) + 50, 40.0 * (k // 5) + 20) for d in range(3) for k in range(20)], "doc_id bigint, page_no int, seq bigint, text string, x0 double, y0 double, x1 double, y1 double")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bands_deal_words_out_twice(spark):
    """Slopes came by joins of a page's words, so they were dealt out eight times: for their rows and by page is enough."""
    from paperledger.operators import columns, geometry

    assert exchanges(columns.find_table_band(columns.page_rows(geometry.straight_rows(words(spark))))) == 2


def test_written_tables_lie_by_page(spark):
    """What was written by page was dealt out again by each step that read it."""
    from paperledger.cluster import materialize, spread
    from paperledger.operators import geometry

    kept = materialize(spread(words(spark), *geometry.PAGE), "test-words", geometry.PAGE)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, words(spark).collect()))
    assert exchanges(geometry.column_bands(kept)) == 0 and exchanges(kept.join(geometry.page_metrics(kept), list(geometry.PAGE))) == 0


def test_drift_deals_no_items_out_again(spark):
    """Items met their rows' kinds and their bands' sizes by joins of other keys than the page."""
    from paperledger.cluster import materialize, spread
    from paperledger.operators import columns, geometry

    items = words(spark).selectExpr("*", "cast(seq div 5 as int) as row_no", "cast(seq % 5 as int) as band", "(y0 + y1) / 2 as c")
    kept = materialize(spread(items, *geometry.PAGE), "test-items", geometry.PAGE)
    both = columns.nearest_row_shift(kept, columns.row_pitch(kept))
    assert exchanges(both) <= 4  # shifts and sizes of bands, no items


def test_slopes_of_the_page_pass_equal_the_columns(spark):
    """straight_rows takes slopes from its pass over a page, deskew from joins."""
    import random

    from paperledger.operators import geometry

    r = random.Random(3)
    rows = []
    for doc in range(30):
        k = r.choice([0, 0.03, -0.03, 0.022, 0.06])
        for s in range(r.choice([1, 3, 30, 90])):
            x = float(r.choice([40, 200, 400, 700, 1100, r.randint(0, 1500)]))
            y = float(40 * (s // 5) + r.choice([0, 0, 0, 1, 7])) + k * x
            rows.append((doc, 1 + s % 2 if doc % 7 == 0 else 1, s if doc % 5 else s // 2, f"w{s}", x, y, x + 60, y + r.choice([20, 20, 20, 0, 30])))
    df = spark.createDataFrame(rows, "doc_id bigint, page_no int, seq bigint, text string, x0 double, y0 double, x1 double, y1 double")
    got = geometry.by_page(df, geometry._straighter, geometry.ROWS.replace("row_no int", "code int, k double"), ("y0", "y1", "x0", "seq"), "code", "k").collect()
    ours = sorted((x.doc_id, x.text, x.y0 - (0.0 if x.k is None else x.k * x.x0)) for x in got)
    assert ours == sorted((x.doc_id, x.text, x.y0) for x in geometry.deskew(df).collect())
    assert sum(x.k is not None for x in got) > 300


def test_sums_in_words_are_read_once(spark):
    """Two finders read each text for sums in words; texts without roubles were taken apart too."""
    from paperledger.operators import recovery

    cells = spark.createDataFrame([(1, 0, "name", "", "a", False)], "doc_id long, row_no int, role string, title string, value string, in_totals boolean")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    fields = spark.createDataFrame([(1, "total", "1.00", "rule")], "doc_id long, key string, value string, source string")
    plan = recovery.recover_totals(cells, docs, fields)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_spans(") == 0
    assert recovery.word_sums("Итого: 5,00 " * 9) == [] and recovery.word_sums("Итого: пять РУБЛЕЙ 1 копейка")[0][2:] == (501, "total")


def test_common_cells_take_the_short_way(spark):
    """Sums with two decimals, names that head no numbering, and rows that don't begin like the header."""
    from decimal import Decimal

    from paperledger.functions.money import cents
    from paperledger.operators import tables as T

    sums = ["5.00", "05.10", "123456789012345.67", "1234567890123456.78", "99999999999999999999.00", "5", "5,1", "", " ", "5.000", "-1.50", "5.00\n", None]
    want = [None if x in ("", " ", "5.000", None) or len(x) > 20 else int(Decimal(x.strip().replace(",", ".")) * 100) for x in sums]
    assert [r.c for r in spark.createDataFrame([(x,) for x in sums], "x string").coalesce(1).select(cents(X.F.col("x")).alias("c")).collect()] == want
    rows = spark.createDataFrame([(["1", "2", "3"], ["a"]), (["Болт", "1", "2"], ["болт", "1", "2"]), (["", "1", "2", "3."], None), ([], []), (None, ["a"])], "c array<string>, t array<string>").coalesce(1)
    got = [tuple(r) for r in rows.select(T.is_numbering_row(X.F.col("c")), T._equals_header(X.F.col("c"), X.F.col("t"))).collect()]
    assert got[:3] == [(True, False), (False, True), (True, None)] and got[3] == (False, False)
