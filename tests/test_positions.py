"""Positions on several lines, values under wrong captions, and tables of models."""

import itertools
import json
import random

import pytest

from paperledger.operators import positions as P
from paperledger.operators import tables

SHAPE = "doc_id bigint, source string, titles array<string>, roles array<string>, rows array<array<string>>, totals array<array<string>>"


def table(spark, titles, rows, roles=None):
    df = spark.createDataFrame([(1, "model", titles, roles or [], rows, [])], SHAPE)
    return df if roles else df.withColumn("roles", tables.assign_roles(tables.F.col("titles")))


def lines(spark, titles, rows):
    return tables.lines_from_cells(tables.clean_table(table(spark, titles, rows))).orderBy("line_no").collect()


def test_sums_on_the_second_line(spark):
    titles = ["Наименование работы", "Ед. изм.", "Кол-во", "Цена", "Стоимость", "Ставка НДС", "Сумма НДС", "Всего с НДС"]
    goods = [("Свет за май", "85.0000", "0.4044", "34.37", "6.87", "41.24"), ("Вода за май", "0.5000", "2.3400", "1.17", "0.23", "1.40"), ("Стоки за май", "0.4130", "1.3801", "0.57", "0.12", "0.69")]
    rows = [r for n, q, p, a, v, t in goods for r in ([n, "м3", q, p, a, "20%", "", ""], ["", "", "", "", "", "", v, t])]
    got = lines(spark, titles, rows)
    assert [(x.name, x.amount) for x in got] == [(n, t) for n, *_, t in goods]


def test_wrapped_names_and_addresses(spark):
    titles = ["", "измер.", "Кол-во", "Тариф", "всего без", "Ст. НДС", "Сумма НДС", "Стоимость"]
    rows = [
        ["", "", "2", "3", "4", "", "", "НДС, руб"],
        ["", "", "", "", "5", "", "", ""],
        ["Плата по", "", "", "", "", "", "", "ул.Лесная,8"],
        ["свету (общие места)", "кВт", "0.09", "0.33554", "0.03", "20%", "0.01", "0.04"],
        ["Плата по свету (по", "кВт", "105", "0.40659", "42.69", "20%", "8.54", "51.23"],
        ["Плата по", "", "", "", "", "ул.Полевая,9", "", "(контора)"],
        ["отдельному прибору", "кВт", "118", "0.40659", "47.98", "20%", "", ""],
        ["учёта)", "", "", "", "", "", "9.60", "57.58"],
    ]
    got = lines(spark, titles, rows)
    assert [x.amount for x in got] == ["0.04", "51.23", "57.58"]
    assert got[0].name.startswith("Плата по свету") and "ул.Лесная,8" in got[0].name
    assert got[2].name.startswith("Плата по отдельному прибору") and got[2].name.endswith("учёта)") and "ул.Полевая,9" in got[2].name


@pytest.mark.parametrize(("second", "rows"), [(["", "", "", "", "3.10", "7.77"], 2), (["", "", "", "", "2.00", "12.00"], 1), (["Иное", "", "", "", "2.00", "12.00"], 2), (["", "", "", "9.00", "2.00", "12.00"], 2)])
def test_only_equations_join_rows(spark, second, rows):
    titles = ["Наименование", "Кол-во", "Цена", "Сумма", "Сумма НДС", "Всего"]
    got = P.merge_multiline_rows(table(spark, titles, [["Услуга", "2", "5.00", "10.00", "", ""], second])).first()
    assert len(got.rows) == rows


def test_tail_of_a_name_goes_up(spark):
    titles = ["Наименование товара", "Ед.", "Количество", "Цена", "Стоимость", "Примечание"]
    rows = [["Вкладыш", "шт", "1", "70.99", "70.99", "Цена ввоза"], ["Артикул H10 надбавка", "", "", "", "", "45 руб.; опт"], ["Сальник", "шт", "1", "14.10", "14.10", "Цена ввоза"], ["вала . Артикул 073", "", "", "", "", "9 руб.; опт"]]
    got = lines(spark, titles, rows)
    assert [x.name for x in got] == ["Вкладыш Артикул H10 надбавка", "Сальник вала . Артикул 073"]


def test_odd_tables(spark):
    titles = ["Наименование", "Сумма"]
    assert P.merge_multiline_rows(table(spark, titles, [[None, None], ["a", None]])).first().rows == [["", ""], ["a", ""]]
    assert P.merge_multiline_rows(table(spark, titles, [["a", "1.00"]])).first().rows == [["a", "1.00"]]
    assert P.merge_multiline_rows(table(spark, titles, [])).first().rows == []
    assert P.merge_multiline_rows(table(spark, titles, [["a", ""], ["b", "1.00"], ["", ""], ["c", ""]])).first().rows == [["a b c", "1.00"]]
    assert P.merge_multiline_rows(table(spark, titles, []).limit(0)).collect() == []


def plain_equations(a, b):
    both = [(v, p, 0) for v, p in a] + [(v, p, 1) for v, p in b]
    for x, y, z in itertools.permutations(both, 3):
        if len({x[2], y[2], z[2]}) < 2 or z[1] or x[1] or min(x[0], y[0], z[0]) <= 0:
            continue
        near = max(0.006, z[0] * 0.005)
        if y[1] and abs(x[0] * y[0] / 100 - z[0]) <= near:
            return True
        if not y[1] and (abs(x[0] + y[0] - z[0]) < 0.005 or (1 not in (x[0], y[0]) and abs(x[0] * y[0] - z[0]) <= near)):
            return True
    return False


def test_equations_against_all_triples():
    r = random.Random(2)
    seen = set()
    for _ in range(600):
        some = lambda n: [(r.choice([1, 2, 3, 5, 6, 10, 20, 0.5, 0]), r.random() < 0.2) for _ in range(n)]
        a, b = some(r.randint(1, 3)), some(r.randint(1, 2))
        assert P.equations_between(a, b) == plain_equations(a, b)
        seen.add(plain_equations(a, b))
    assert seen == {True, False}


def test_numbers():
    good = {"5": 5, "-1 234,50": -1234.5, "1234567.1": 1234567.1, "20%": 20, "20 %": 20, "1 000": 1000, "0.123456": 0.123456}
    assert {k: P.number_of(k)[0] for k in good} == good
    assert not any(P.number_of(x) for x in ("", "-", "%", "1 23", "1,2,3", "5 шт", "0.1234567", "1.", "²", None))


ROLES = ["name", "qty", "price", "amount", "vat_rate", "vat"]


def test_row_order(spark):
    """Every order of a row's cells comes back, or one that is as consistent."""
    true = ["x", "16.74", "0.41009", "6.86", "20", "1.37"]
    rows = [["x", *p] for p in itertools.permutations(true[1:])]
    got = P.repair_row_order(table(spark, ["t"] * 6, rows, ROLES)).first().rows
    for r in got:
        q, p, a, rate, v = map(float, r[1:])
        assert rate == 20 and abs(q * p - a) <= 0.07 and v == 1.37 and {q, p} == {16.74, 0.41009}
    assert true in got
    keep = [["x", "2", "3", "7", "20", "1"], ["x", "2", "3", "6", "20", "1"], ["x", "", "", "5", "0", ""], ["Итого", "", "", "", "", None]]
    want = [[c or "" for c in r] for r in keep]
    assert P.repair_row_order(table(spark, ["t"] * 6, keep, ROLES)).first().rows == want
    wide = ["qty"] * 8
    assert P.repair_row_order(table(spark, ["t"] * 8, [["9"] * 8], wide)).first().rows == [["9"] * 8]


def test_a_factor_of_one_keeps_the_sequence(spark):
    """With a quantity of one the order that moved fewest cells put the price for the amount, and an amount just
    over a percent off was exchanged for the price."""
    roles = ["index", "qty", "price", "amount", "vat_rate"]
    true = ["1", "950.00", "955.00", "0%"]
    rows = [[str(k), *true[k:], *true[:k]] for k in range(4)]
    got = P.repair_row_order(table(spark, ["t"] * 5, rows, roles)).first().rows
    assert got == [[str(k), *true] for k in range(4)]
    off = [[str(k), *true[k:], *true[:k]] for true in (["1", "950.00", "959.55", "0%"],) for k in range(4)]
    assert P.repair_row_order(table(spark, ["t"] * 5, off, roles)).first().rows == off
    same = [["1", "5", "20", "1", "5"], ["1", "5.00", "1", "20", "5.00"]]
    assert [(float(r[1]) * float(r[2]), float(r[3]), r[4]) for r in P.repair_row_order(table(spark, ["t"] * 5, same, roles)).first().rows] == [(5, 5, "20")] * 2


def test_a_percent_is_exact(spark):
    """The limit of one percent, compared in doubles, left out products that are off by just that."""
    exact = [(q, p) for q in range(2, 51) for p in range(90000, 90400, 10) if q * p % 100 == 0]
    rows = [[f"{q * p * k // 10000}.{q * p * k // 100 % 100:02d}", str(q), f"{p // 100}.{p % 100:02d}"] for q, p in exact for k in (99, 101)]
    got = P.repair_row_order(table(spark, ["t"] * 3, rows, ["qty", "price", "amount"])).first().rows
    assert [r[2] for r in got] == [r[0] for r in rows]


def test_rows_of_many_tables_are_read_at_once(spark):
    """Tables, rows and cells that are missing or empty don't shift those of other tables."""
    from pyspark.sql import functions as F

    some = [(1, ["qty", "price", "amount"], [["6", "2", "3"], [], [None, "5", "6", "x"]]), (2, [], []), (3, ["name", None, "qty", "price", "amount"], [["a", None, "8", "2", "4"]]), (4, ["qty", "price", "amount"], [["6", "2", "3"]])]
    df = spark.createDataFrame(some, "doc_id bigint, roles array<string>, rows array<array<string>>").coalesce(1)
    got = {r.doc_id: r.rows for r in P.repair_row_order(df).collect()}
    assert got == {1: [["3", "2", "6"], [], ["", "5", "6", "x"]], 2: [], 3: [["a", "", "4", "2", "8"]], 4: [["3", "2", "6"]]}
    merged = P.merge_multiline_rows(df.withColumn("roles", F.lit(None).cast("array<string>")).union(df.where("doc_id = 3").withColumn("doc_id", F.lit(5).cast("bigint"))))
    assert {r.doc_id: r.rows for r in merged.where("doc_id in (2, 5)").collect()} == {2: [], 5: [["a", None, "8", "2", "4"]]}


def test_model_table(spark):
    answers = [
        (1, json.dumps({"table": {"columns": ["Наименование", "Кол-во", "Цена", "Сумма"], "rows": [["a", "6", "2", "3"], ["b", "2"], ["c", 2, 5, 10, "кг", "!"], ["", None], ["Итого", "", "", "16"], ["Всего", "", "", "17"]]}})),
        (2, json.dumps({"table": {"columns": ["Наименование", "Сумма"], "rows": [["a", "5"], ["Итого", "9"]], "totals": ["t", "5", "x"]}})),
        (3, json.dumps({"table": {"columns": [], "rows": [["a"]]}})), (4, "no json"), (5, None), (6, json.dumps({"table": {"columns": ["a"], "rows": []}})),
    ]
    got = {r.doc_id: r for r in P.table_from_model(spark.createDataFrame(answers, "doc_id bigint, answer string")).collect()}
    assert set(got) == {1, 2}
    assert got[1].rows == [["a", "3", "2", "6"], ["b", "2", "", ""], ["c", "2", "5", "10 кг !"]] and got[1].totals == [["Итого", "", "", "16"]]
    assert got[2].rows == [["a", "5"]] and got[2].totals == [["t", "5 x"]]


def test_tables_that_stay_apart_are_found_at_once(spark, monkeypatch):
    """Tables none of whose rows joins another went row by row all the same; those found at once must be such tables."""
    import random

    import pyarrow as pa

    from paperledger.operators import positions as P

    r = random.Random(4)
    roles = ["name\x01qty\x01price\x01amount", "index\x01name\x01qty\x01price\x01amount\x01vat_rate\x01vat\x01amount", "other\x01qty\x01amount", "", "name"]
    some = ["", "Болт", "гайка", " (часть)", "5", "12.50", "1 250,10", "20%", "3.00", "100.00", "300.00", "Раздел:", None, "\x85x", "-5,00"]
    tables = []
    for _ in range(600):
        own, good = r.choice(roles), r.random() < 0.5
        rows = [[r.choice(some) for _ in own.split("\x01")] for _ in range(r.randint(0, 5))]
        for row in rows:
            if good and len(row) > 1:
                row[0], row[1], row[-1] = r.choice(["Болт", "гайка"]), r.choice(["Болт", "5.00"]), "12.50"
            if r.random() < 0.05:
                row.append("5.00")
        tables.append((rows, own))
    rows, own = pa.array([t[0] for t in tables], pa.list_(pa.list_(pa.string()))), pa.array([t[1] for t in tables])
    got, slow = P._merged.func(rows, own).to_pylist(), []
    monkeypatch.setattr(P, "merged_rows", lambda pairs, names, plain=P.merged_rows: slow.append(1) or plain(pairs, names))
    P._merged.func(rows, own)
    assert 0 < len(slow) < 400
    monkeypatch.setattr(P, "_stay_apart", lambda texts, number, money, cell_at, table_at, roles: P.np.zeros(len(roles), bool))
    assert P._merged.func(rows, own).to_pylist() == got
