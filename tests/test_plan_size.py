"""Plans compute a step once, and searches for a first row end there."""

import os

import pytest
from pyspark.sql import functions as F

from paperledger.functions.text import first_where
from paperledger.operators import lines as L
from paperledger.operators import tables as T


def counts(df, *words):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [plan.count(w) for w in words]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, layout string")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, "m", ["a"], ["name"], [["a"]], [["b"]])], f"doc_id long, source string, titles array<string>, roles array<string>, rows {T.ROWS}, totals {T.ROWS}")


def test_lines_from_text_computes_steps_once(docs):
    """Filters on the last step were copied through all steps before (314 patterns)."""
    assert counts(L.lines_from_text(docs), "RLIKE")[0] <= 40


def test_captions_are_lowered_once(docs, table):
    """Each of the words that a cell is compared with lowered it again (80 to 108 times a cell)."""
    for df in (T.table_from_layout(docs), T.free_table_from_layout(docs), T.clean_table(table), T.absorb_header_rows(table)):
        assert counts(df, "lower(")[0] <= 16


def test_first_where_stops(spark):
    """Entries behind the first that passes are not looked at: 1 / 0 there does no harm."""
    df = spark.createDataFrame([([0, 5, 1],), ([0, 1, 2],), ([],), (None,)], "a array<int>")
    got = df.select(first_where(F.col("a"), lambda x: F.when(x == 1, F.raise_error(F.lit("tested"))).otherwise(x == 5)).alias("k"))
    assert got.limit(1).first().k == 2
    assert [r.k for r in df.select(first_where(F.col("a"), lambda x: x == 1).alias("k")).collect()] == [3, 2, 0, 0]


def test_letter_diff_counts_letters_with_repetition(spark):
    from collections import Counter

    words = ["итого", "ИТОГО", "итог", "всего", "ёёвсе", "ооооо", "", "итого1", "вссго", "а"]
    brute = lambda a, b: 99 if not (a == "" or a.isalpha()) else sum(((Counter(a.lower().replace("ё", "е")) - Counter(b)) + (Counter(b) - Counter(a.lower().replace("ё", "е")))).values())
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for b in T.PLAIN_TOTALS:
        assert [r.d for r in df.select(T.letter_diff(F.col("w"), b).alias("d")).collect()] == [brute(w, b) for w in words]


def test_fields_share_their_steps(docs):
    """Number and total were computed for the value and again for its confidence, contracts' numbers three times."""
    from paperledger.operators import extract

    assert counts(extract.extract_fields(docs), "locate(")[0] <= 100


def test_frames_end_at_the_row(spark):
    """Frames to the end of a page or band were summed up anew for each row, and a band's items read five times."""
    from paperledger.operators import columns as C

    items = spark.createDataFrame([(1, 1, 1, 1, 0.0)], "doc_id long, page_no int, band int, seq long, c double")
    pitch = items.select("doc_id", "page_no", "c").withColumnRenamed("c", "pitch")
    shifts = C.nearest_row_shift(items, pitch)
    facts = "doc_id long, page_no int, row_no int, n int, text string, roles array<string>, total boolean, ends boolean, money boolean, digits boolean, captions boolean, prose boolean"
    band = C.find_table_band(spark.createDataFrame([], facts))
    for df in (shifts, band):
        assert counts(df, "currentrow$(), unboundedfollowing$()", "1, unboundedfollowing$()") == [0, 0]
    assert counts(band, "LogicalRDD", "Relation")[0] == 1


def test_columns_with_a_role_are_not_searched_for_names(spark, table):
    """texts of all columns were counted and parsed as numbers, and where no column was free the first
    one could become the name."""
    assert counts(T.fix_name_column(table), "split(") == [0]
    taken = table.select("doc_id", "source", F.array(F.lit("Ед."), F.lit("Товар")).alias("titles"), F.array(F.lit("unit"), F.lit("name")).alias("roles"), F.array(F.array(F.lit("килограмм"), F.lit("чай"))).alias("rows"), "totals")
    assert T.fix_name_column(taken).first().roles == ["unit", "name"]


def test_clean_cells_stay(spark):
    """cells that are clean as they stand aren't taken apart; all others are."""
    from paperledger.functions import money

    said = {"чай 2 зеленый": "чай 2 зеленый", "12.50": "12.50", "": "", " чай  2": "чай 2", "1 250,5": "1250.5", "12\n": "12", "1О": "10", "|чай": "чай", "12.": "12.", "О": "О"}
    df = spark.createDataFrame([(c,) for c in said], "c string")
    assert {r.c: r.d for r in df.select("c", money.clean_cell(F.col("c")).alias("d")).collect()} == said
    assert [r.c for r in df.where(F.col("c").rlike(money.CLEAN_CELL)).collect()] == ["чай 2 зеленый", "12.50", ""]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_orders_meet_suppliers_by_equal_keys(spark):
    """each order was compared with each supplier; only one row with their number may meet all orders."""
    from paperledger.plans import queries
    from paperledger.plans.projections import run_sql

    plan = run_sql(spark, "/root/testdata/sf0.001", "SELECT * FROM party_records")
    text = plan._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "BroadcastNestedLoopJoin" in line or "CartesianProduct" in line]
    assert len(joins) == 1 and "at#" not in joins[0] and "BroadcastHashJoin [place#" in text
    assert "s.at = o_orderkey % s.n" in queries.ORACLE_SQL["r7_resolve_parties"]


def exchanges(spark, name):
    """Times that a query's rows are dealt out by keys, and joins by sorting."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return [plan.count(w) for w in ("Exchange hashpartitioning", "SortMergeJoin")]


needs_tables = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")


@needs_tables
def test_lines_are_dealt_out_once(spark):
    """lines were numbered by l_orderkey and dealt out again by doc_id; rows' cells were made in the aggregate, by Java's formatter."""
    from paperledger.plans import queries

    assert exchanges(spark, "w23_absorb_header_rows") == [1, 0]
    assert "row_number() OVER (PARTITION BY l_orderkey" in queries.ORACLE_SQL["w23_absorb_header_rows"]
    sums = spark.createDataFrame([(0,), (5,), (-5,), (100,), (-12345,), (123456789012,), (None,)], "c long")
    from paperledger.functions import money

    assert [r.s for r in sums.select(money.format_cents(F.col("c")).alias("s")).collect()] == ["0.00", "0.05", "-0.05", "1.00", "-123.45", "1234567890.12", None]


def test_middles_of_words_are_computed_once(spark):
    """characters before a word were counted anew for each word, and its middle twice for each band."""
    from paperledger.operators import columns as C

    tokens = spark.createDataFrame([(1, 1, 0, "ab  cd 12 34", 0.0, 110.0), (1, 1, 1, "ab cd", 0.0, 40.0), (1, 1, 2, "x", 90.0, 100.0), (1, 1, 3, "", 90.0, 100.0)], "doc_id long, page_no int, seq long, text string, x0 double, x1 double")
    bands = spark.createDataFrame([(1, 1, [(0.0, 55.0), (55.0, 85.0), (85.0, 120.0)])], f"doc_id long, page_no int, bands {C.BANDS}")
    cut = C.split_across_bands(tokens, bands)
    assert counts(cut, "slice(", "aggregate(") == [0, 1]
    assert sorted((r.seq, r.part, r.band, r.text) for r in cut.collect()) == [(0, 0, 0, "ab cd"), (0, 1, 1, "12"), (0, 2, 2, "34"), (1, 0, 0, "ab cd"), (2, 0, 2, "x"), (3, 0, 2, "")]


@needs_tables
def test_line_boxes_move_once(spark):
    """words were dealt out by line, again to meet their lines, and again by page."""
    assert exchanges(spark, "w14_split_line_boxes") == [1, 0]


@needs_tables
def test_pages_move_once(spark):
    """F25 F29 F31 F33: words met their page's widths by a join, and words that lay by document were dealt out again by page."""
    for name in ("w3_rows_by_top", "w4_layout_text", "w6_column_bands"):
        assert exchanges(spark, name) == [1, 0]
    assert exchanges(spark, "j13_words_to_bands")[0] <= 2


def test_bands_of_nested_and_missing_boxes(spark):
    from paperledger.operators import geometry as G

    boxes = [(0.0, 100.0), (10.0, 20.0), (60.0, 70.0), (200.0, 210.0), (None, 300.0), (250.0, 260.0)]
    words = spark.createDataFrame([(d, 1, k, "a", a, b) for d, n in ((1, 6), (2, 3)) for k, (a, b) in enumerate(boxes[:n])], "doc_id long, page_no int, seq long, text string, x0 double, x1 double")
    assert [(r.doc_id, r.band, r.lo, r.hi) for r in G.column_bands(words).collect()] == [(1, 0, -10.0, 310.0)]
    shown = G.column_bands(words.where("x0 is not null")).orderBy("band").collect()
    assert [(r.band, r.lo, r.hi) for r in shown] == [(0, -10.0, 150.0), (1, 150.0, 230.0), (2, 230.0, 270.0)]


def test_roles_by_arithmetic_read_cells_once(spark):
    """a table's facts were joined to its cells three times, and cells read anew for each."""
    shape = "doc_id long, source string, row_no int, col_no int, role string, value string, is_total boolean"
    rows = [("чай", "1.20", "1.00", "0.20"), ("сок", "2.40", "2.00", "0.40")]
    cells = [(d, s, r, c, role[c], v, r == 2) for d, s, role, more in ((1, "m", ("name", "amount", "other", None), []), (2, "m", ("name", "amount", "vat", "amount"), [("", "9", "9", "9")]), (3, "m", ("name", "qty", "other", ""), [])) for r, row in enumerate(rows + more) for c, v in enumerate(row)]
    cells += [(None, "m", 0, c, "other", v, False) for c, v in enumerate(rows[0])]
    found = T.infer_roles_by_arithmetic(spark.createDataFrame(cells, shape))
    assert counts(found, "Join ", "LogicalRDD") == [0, 1]
    assert [(r.doc_id, r.net_col, r.vat_col, r.total_col) for r in found.orderBy("doc_id").collect()] == [(1, 2, 3, 1), (2, 2, 3, 1)]
