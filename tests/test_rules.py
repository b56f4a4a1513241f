"""Extraction and rules over fields, on small pages of our own."""

from paperledger.operators import extract, rules

PAGE = "Акт № 17/А от «5» марта 2024 г.\nИсполнитель: ООО «Лён», адрес: Минск, УНП 123456789\nЗаказчик: УП Сокол УНП 987654321\nОснование: договор № 3 от 01.02.2023\nИтого НДС: 20,00\nВсего к оплате: сто двадцать рублей 00 копеек\nбел. руб"


def test_extract(spark):
    docs = spark.createDataFrame([(1, PAGE), (2, None), (3, "№ 5 сумма 7,00 и 1 250,10 евро")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["key"]): (r["value"], r["confidence"]) for r in extract.extract_fields(docs).collect()}
    one = {k: v[0] for (i, k), v in got.items() if i == 1}
    assert one["number"] == "17/А" and one["total"] == "120.00" and one["currency"] == "BYN"
    assert one["counterparty"] == "ООО «Лён»" and one["organization"] == "УП Сокол"
    assert one["unp"] == "123456789" and one["organization_unp"] == "987654321"
    assert one["contract_number"] == "3" and one["contract_date"] == "01.02.2023"
    assert got[3, "number"] == ("5", 0.3) and got[3, "total"] == ("1250.10", 0.3) and got[3, "currency"][0] == "EUR"
    assert not [k for k in got if k[0] == 2]


def test_captions_and_labels(spark):
    pages = [
        (1, "Всего наименований: три\nАрендодатель и его адрес: ООО Дом, г. Минск, тел. 12\nНаниматель - ЧП Сад ИНН 7701234567\nВ т.ч. НДС 20% : 1 200,50\nИтого без НДС: 6 002,50\nроссийских рублей"),
        (2, "Поставщик (исполнитель): Лес\nПокупатель без знака\nв том числе НДС: сто рублей 10 копеек\nRUR"),
    ]
    docs = spark.createDataFrame(pages, "doc_id bigint, text string")
    got = {(r["doc_id"], r["key"]): r["value"] for r in extract.extract_fields(docs).collect()}
    assert got[1, "counterparty"] == "ООО Дом, г. Минск" and got[1, "organization"] == "ЧП Сад" and got[1, "organization_unp"] == "7701234567"
    assert got[1, "vat_amount"] == "1200.50" and got[1, "amount_no_vat"] == "6002.50" and got[1, "currency"] == "RUB"
    assert got[1, "total"] == "6002.50"  # a caption without a sum gives none
    assert got[2, "counterparty"] == "Лес" and (2, "organization") not in got and got[2, "vat_amount"] == "100.10" and got[2, "currency"] == "RUB"


FIELDS = "doc_id bigint, key string, value string, confidence double, source string"


def values(df):
    return {(r["doc_id"], r["key"]): (r["value"], r["source"]) for r in df.collect()}


def test_merge_and_edit(spark):
    base = spark.createDataFrame([(1, "number", "1", 0.7, "rule"), (1, "total", "5", 0.3, "rule")], FIELDS)
    model = spark.createDataFrame([(1, " Total ", "6"), (1, "number", "BY11ALFA1234"), (1, "account_debit", "99"), (1, "account_credit", "60"), (1, "x", " ")], "doc_id bigint, key string, value string")
    chart = spark.createDataFrame([("60",)], "code string")
    merged, dropped = rules.merge_fields(base, model, chart)
    assert values(merged) == {(1, "number"): ("1", "rule"), (1, "total"): ("6", "model"), (1, "account_credit"): ("60", "model")}
    assert sorted(r["key"] for r in dropped.collect()) == ["account_debit", "number"]
    edits = spark.createDataFrame([(1, "number", "2", 1), (1, "number", "3", 2), (2, "date", "d", 1)], "doc_id bigint, key string, value string, ts int")
    assert values(rules.manual_edits(base, edits)) == {(1, "number"): ("3", "manual"), (1, "total"): ("5", "rule"), (2, "date"): ("d", "manual")}


def test_number_total_formats(spark):
    base = spark.createDataFrame([(1, "number", "12-3", 0.7, "rule"), (2, "number", "9", 0.7, "rule"), (3, "number", "7", 1.0, "manual"), (1, "total", "5.00", 0.6, "rule"), (2, "total", "5.00", 0.8, "rule"), (1, "unp", "1234567", 0.7, "rule"), (2, "unp", "12", 0.7, "rule")], FIELDS)
    header = spark.createDataFrame([(1, "12"), (2, "8"), (3, "8"), (4, "6")], "doc_id bigint, number string")
    number = {i: v for (i, k), (v, _) in values(rules.prefer_blank_number(base, header)).items() if k == "number"}
    assert number == {1: "12-3", 2: "8", 3: "7", 4: "6"}
    totals = spark.createDataFrame([(1, "6.00"), (2, "6.00"), (3, "6.00")], "doc_id bigint, total string")
    total = {i: v for (i, k), (v, _) in values(rules.fill_total(base, totals)).items() if k == "total"}
    assert total == {1: "6.00", 2: "5.00", 3: "6.00"}
    docs = spark.createDataFrame([(1, "УНП 123456789"), (2, "УНП 123456789"), (3, "")], "doc_id bigint, text string")
    kept, rejected = rules.enforce_formats(base, docs)
    assert values(kept)[1, "unp"][0] == "123456789" and [(r["doc_id"], r["key"]) for r in rejected.collect()] == [(2, "unp")]
    fixed = {(r["doc_id"], r["key"]): r["confidence"] for r in rules.fix_fields(base, docs).collect()}
    assert (2, "unp") in fixed and fixed[2, "total"] == 0.8


def test_sides_and_fixed_fields(spark):
    texts = {
        1: "УНП продавца: 123456789\nУНП покупателя (заказчика) 590888079", 2: "УНП 111111111 унп\nполучателя  платежа 222222222; УНП поставщика 333333333", 3: "УНП продавца:\n123456789 УНП арендатора 12345678",
        4: "УНП покупателя " + "x" * 25 + "1" * 10, 5: None, 6: "УНП заказчика " + "x" * 25 + "123456789", 7: "УНП 123456789 ООО Ива, 500,75 руб",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {(r.doc_id, r.key): r.value for r in rules.labelled_sides(docs).collect()}
    assert got == {(1, "unp"): "123456789", (1, "organization_unp"): "590888079", (2, "unp"): "222222222"}
    fields = [
        (1, "unp", "590888079", 0.7, "model"), (1, "counterparty", "ООО Ива, р/с BY12", 0.7, "model"), (1, "organization", "ооо ива", 0.7, "rule"), (1, "total", "999.99", 0.8, "model"),
        (5, "unp", "999999999", 0.7, "model"), (7, "unp", "123456789", 0.7, "rule"), (7, "organization_unp", "123456789", 0.6, "model"), (7, "kpp", "987654321", 0.6, "model"), (7, "inn", "", 0.6, "model"),
        (7, "total", "500.75", 0.8, "model"), (7, "organization", "УНП", 0.6, "model"), (8, "unp", "1", 0.1, "rule"),
    ]
    fixed = rules.fix_fields(spark.createDataFrame(fields, FIELDS), docs).collect()
    assert {(r.doc_id, r.key): (r.value, r.confidence, r.source) for r in fixed} == {
        (1, "unp"): ("123456789", 0.9, "rule"), (1, "organization_unp"): ("590888079", 0.9, "rule"), (1, "counterparty"): ("ООО Ива", 0.7, "model"), (1, "total"): ("999.99", 0.45, "model"),
        (5, "unp"): ("999999999", 0.7, "model"), (7, "unp"): ("123456789", 0.7, "rule"), (7, "inn"): ("", 0.6, "model"), (7, "total"): ("500.75", 0.8, "model"), (8, "unp"): ("1", 0.1, "rule"),
    }
