"""Rules with exceptions: amounts in words, footers, shared boxes, the name's column, roles by sums."""

from pyspark.sql import functions as F

from paperledger.operators import evidence, tables

from .test_positions import table


def test_spelled_amount(spark):
    cases = {"сто рублей": True, "Тридцать шесть рублей 78 копеек": True, "цена в рублях": False, "сумма рублей и копеек": False, "двадцать штук": False, "«Пять» руб.": False, "(пять) копеек": True, "стол за рубль": False, "": False}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", tables.is_spelled_amount(F.col("c")).alias("x")).collect()
    assert {r.c: r.x for r in got} == cases


def test_footer(spark):
    lines = ["Итого", None, "страница 1,00", "Сумма прописью: сто рублей", "в т. ч. НДС", "к  оплате 5", "Отпустил всего", "всего"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)] + [(2, k, "всего 1") for k in range(12)] + [(3, 0, "М.П."), (3, 1, "итого")], "doc_id bigint, line_no int, text string")
    got = {}
    for r in evidence.clean_footer(df).orderBy("line_no").collect():
        got.setdefault(r.doc_id, []).append(r.line_no)
    assert got == {1: [0, 3, 4, 5], 2: list(range(8))}


def test_line_boxes(spark):
    words = [(1, 0, 10.0, 0.0, 110.0, 9.0, "ab"), (1, 1, 12.0, 1.0, 60.0, 9.0, "cdef"), (1, 2, 10.0, 40.0, 60.0, 49.0, "x yz"), (1, 3, 300.0, 40.0, 330.0, 49.0, "one"), (1, 4, 5.0, 80.0, 5.0, 90.0, "p q"), (1, 5, 0.0, 99.0, 9.0, 108.0, " ")]
    df = spark.createDataFrame([(d, 1, s, *r) for d, s, *r in words], "doc_id bigint, page_no int, seq bigint, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r.seq, r.part): (r.text, round(r.x0, 2), round(r.x1, 2)) for r in evidence.split_line_boxes(df).collect()}
    per = 100 / 7
    assert got == {(0, 0): ("ab", 10, round(10 + 2 * per, 2)), (1, 0): ("cdef", round(10 + 3 * per, 2), 110), (2, 0): ("x", 10, 22.5), (2, 1): ("yz", 35, 60), (3, 0): ("one", 300, 330), (4, 0): ("p", 5, 5), (4, 1): ("q", 5, 5)}


def roles(spark, given, rows):
    return tables.fix_name_column(table(spark, ["t"] * len(given), rows, given)).first().roles


def test_name_column(spark):
    codes = [["17", "Труба", "5"], ["18", "Кран", "6"], ["19", "Муфта", "7"]]
    assert roles(spark, ["name", "other", "qty"], codes) == ["index", "name", "qty"]
    assert roles(spark, ["name", "amount", "qty"], codes) == ["name", "amount", "qty"]  # no column that has a role
    mixed = [["Лист", "Труба", "5"], ["Брус", "Кран", "6"], ["19", "Муфта", "7"]]
    assert roles(spark, ["name", "other", "qty"], mixed) == ["name", "other", "qty"]  # one and a half times is not more
    assert roles(spark, ["name", "other", "qty"], [["Лист", "Труба", "5"], *codes[1:]]) == ["other", "name", "qty"]
    assert roles(spark, ["qty", "", "other"], [["1", "абв", "Труба"], ["2", "где", "Кран"]]) == ["qty", "", "name"]  # three letters are none
    assert roles(spark, ["name", "other"], []) == ["name", "other"]


def inferred(spark, given, rows):
    got = tables.infer_roles_by_arithmetic(tables.cells_long(table(spark, ["t"] * len(given), rows, given))).collect()
    return tuple(got[0][2:]) if got else None


def test_roles_by_sums(spark):
    rows = [["a", "10.00", "2.00", "12.00"], ["b", "5.00", "1.00", "6.00"]]
    assert inferred(spark, ["name", "other", "other", "other"], rows) == (1, 2, 3)
    assert inferred(spark, ["name", "qty", "other", "other"], rows) is None
    assert inferred(spark, ["name", "amount", "vat", "amount"], rows) is None  # they reconcile already
    assert inferred(spark, ["name", "amount", "amount", "vat"], rows) == (1, 2, 3)
    assert inferred(spark, ["name", "other", "other", "other"], [[n, a, "0", a] for n, a, *_ in rows]) is None  # zeros count for nothing
    assert inferred(spark, ["name", "other", "other", "other"], [[n, a[:-3], v[:-3], t[:-3]] for n, a, v, t in rows]) is None  # no money
    assert inferred(spark, ["name", "other", "other", "other"], [*rows, *[["c", "1.00", "1.00", "9.00"]] * 2]) is None  # half of the rows
