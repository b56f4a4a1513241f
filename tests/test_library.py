"""Operators that the queries' SQL doesn't cover, on small tables of our own."""

import datetime as dt

from pyspark.sql import functions as F

from paperledger.functions import money, parties, text
from paperledger.operators import accuracy, catalog, lines, store
from paperledger.plans import queries
from paperledger.sources import exchange
from paperledger.streaming import flows


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_numbers(spark):
    for v, want in (("1 250,00", "1250.00"), ("20%", "20"), ("12.5 3.7", ""), ("12.5 3", ""), ("7", "7")):
        assert one(spark, v, money.normalize_number) == want
    assert one(spark, "1.250,30", money.tidy_number) == "1250.30"
    assert one(spark, "1O5,З0", money.repair_numeric_cell) == "105.30"
    assert one(spark, "Обь", money.repair_numeric_cell) == "Обь"
    assert one(spark, "12,5", money.cents) == 1250
    assert one(spark, "12,555", money.cents) is None
    assert one(spark, "-5", lambda c: money.format_cents(c.cast("bigint"))) == "-0.05"


def test_words(spark):
    assert one(spark, "одна тысяча двести тридцать четыре", money.words_to_int) == 1234
    assert one(spark, "два миллиона тысяча", money.words_to_int) == 2001000
    assert one(spark, "двадцать кошек", money.words_to_int) is None
    for words, n in {"двадцать двадцать": None, "пять сто": None, "двадцать пятнадцать": None, "тысяча миллион": None, "сто пятнадцать": 115, "сто двадцать пять": 125, "девятьсот девяносто девять тысяч один": 999001, "ноль": 0, "тысяча": 1000, "": None}.items():
        assert one(spark, words, money.words_to_int) == n
    for words, cents in {"Сорок четыре рубля 00 копеек": 4400, "Тридцать шесть белорусских рублей 78 копеек": 3678, "Одна тысяча двести рублей 05 копеек": 120005, "Шесть рублей тринадцать копеек": 613, "Триста рублей 31 копейка": 30031, "Сорок мяу рубля 00 копеек": None, "два рубля, три рубля 5 копеек": 305, "рублей 5 копеек": None, "сто рублей": None}.items():
        assert one(spark, words, money.money_from_words) == cents, words
    cells = {"5": True, "-1 234,50": True, "1234567.1": True, "20 %": True, "1 000": True, "1 23": False, "1,2,3": False, "": False, "5 шт": False, "0.1234567": False, "1.": False, "%": False}
    for cell, good in cells.items():
        assert one(spark, cell, money.is_numeric_cell) is good, cell
    assert one(spark, "Сто двадцать белорусских рублей 05 копеек", money.money_from_words) == 12005
    assert one(spark, "Сумма: семь рублей, двадцать шесть копеек", money.money_from_words) == 726
    assert one(spark, "Сумма семь рублей 26 копеек", money.money_from_words) is None  # a word that is no numeral
    assert one(spark, "5 рублей; тысяча рублей 1 коп.", money.money_from_words) == 100001
    assert one(spark, "семь рублей сто копеек", money.money_from_words) is None
    assert one(spark, "Итого 5,00, в т.ч. НДС: сорок четыре рубля 05 копеек", money.vat_from_words) == 4405
    assert one(spark, "НДС не облагается", money.vat_from_words) is None
    assert one(spark, "О3lЗ,5Б", money.repair_numeric_cell) == "0313.56"
    assert one(spark, "«31» января 2023 г.", money.date_from_words) == "31.01.2023"


def test_parties(spark):
    for name in ("ООО «Ромашка Плюс»", 'Общество с ограниченной ответственностью "Ромашка Плюс"', "РОМАШКА ПЛЮС ООО"):
        assert one(spark, name, parties.party_form) == "ООО"
        assert one(spark, name, parties.party_key) == "ромашкаплюс"
    assert one(spark, "ООО Лён УП Сокол", parties.count_forms) == 2
    assert one(spark, "ООО Лён, УП Сокол", parties.split_entities) == ["ООО Лён", "УП Сокол"]
    assert one(spark, "ООО Ромашка Плюс", lambda c: parties.same_party(c, F.lit("Ромашка"))) is True
    assert one(spark, "ООО Сад", lambda c: parties.same_party(c, F.lit("Садовод"))) is False
    assert [one(spark, v, lambda c: parties.format_valid(F.lit("date"), c)) for v in ("31.12.2020", "2020-12-31", "01.01.1900")] == [1, -1, -1]


def test_text(spark):
    assert one(spark, "УНП 123456789, 123 456 780 и 1234567890", text.tax_ids_in) == ["123456789", "123456780"]
    assert one(spark, "aéб😀x", lambda c: text.clip_bytes(c, 6)) == "aéб"
    assert one(spark, "../a/b.pdf", text.sanitize_name) == "b.pdf"
    assert one(spark, "№ 12/А", text.doc_number_norm) == "12/а"


def test_lines(spark):
    page = "Поставщик\n№ Наименование Кол-во Ед Цена Сумма\n1. Болт М8 10 шт 2,50 25,00\n2. Гайка большая 4 шт 1 250,00 5 000,00\nДоставка 7,00\nпросто текст\nИтого 5032,00\nБолт 1 шт 1 1"
    got = lines.lines_from_text(spark.createDataFrame([(1, page), (2, "без таблицы")], "doc_id bigint, text string")).orderBy("pos").collect()
    assert [(r["name"], r["qty"], r["unit"], r["price"], r["amount"]) for r in got][:2] == [("Болт М8", "10", "шт", "2.50", "25.00"), ("Гайка большая", "4", "шт", "1250.00", "5000.00")]
    assert len(got) == 3 and got[2]["amount"] == "7.00"


def test_amounts(spark):
    t = spark.createDataFrame([(1, 100), (2, 100), (3, None), (4, 100)], "doc_id bigint, total bigint")
    items = spark.createDataFrame([(1, 60), (1, 40), (2, 100), (2, None), (3, 5)], "doc_id bigint, amount bigint")
    assert {r["doc_id"]: r["mismatch"] for r in lines.lines_total_mismatch(items, t).collect()} == {1: False, 2: True, 3: False, 4: False}
    assert {r["doc_id"]: r["agrees"] for r in lines.lines_sum_agrees(items, t).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert {r["doc_id"]: r["confirmed"] for r in lines.lines_confirm_total(items, t).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_catalogue(spark):
    built_in = catalog.catalogue_frame(spark, queries.SPECS)
    change = spark.createDataFrame([("act", None, None, None, None, None, None, "Deed", 0), ("new", "New", [], [], 0.5, [], False, "", 1)], catalog.DOC_TYPES)
    merged = {r["slug"]: (r["object"], r["weight"]) for r in catalog.load_doc_types(built_in, change).collect()}
    assert merged["act"] == ("Deed", 0.3) and merged["new"] == ("", 0.5) and len(merged) == 5
    fields = spark.createDataFrame([(1, "account_debit", "60"), (1, "account_credit", "60"), (2, "account_debit", "10"), (2, "account_credit", "10")], "doc_id bigint, key string, value string")
    assert sorted((r["doc_id"], r["key"]) for r in catalog.check_accounts(fields).collect()) == [(1, "account_credit"), (2, "account_debit")]


def test_counterparties(spark):
    directory = spark.createDataFrame([(1, "100000001", "Сокол", ["СОКОЛ ООО"])], "company_key bigint, unp string, name string, synonyms array<string>")
    came = spark.createDataFrame([(1, "100000001", "сокол"), (1, "100000001", "Сокол плюс"), (1, "100000001", "сокол ПЛЮС"), (2, "100000002", "Лён")], "company_key bigint, unp string, name string")
    got = {r["company_key"]: (r["name"], len(r["synonyms"])) for r in store.upsert_counterparty(directory, came).collect()}
    assert got == {1: ("Сокол", 2), 2: ("Лён", 0)}


def test_exchange_upsert(spark):
    target = spark.createDataFrame([("a", "1", None, 5)], "source_id string, number string, date string, total bigint")
    sent = [("a", "update", 2, "9", "d", 7), ("b", "create", 1, "n", None, None), ("b", "create", 1, "n", None, None), ("b", "update", 3, None, "x", 1), ("c", "create", 1, "o", None, None), ("c", "partial", 4, "p", None, 2)]
    got = sorted(map(tuple, store.apply_exchange(target, spark.createDataFrame(sent, "source_id string, kind string, seq int, number string, date string, total bigint")).collect()))
    assert got == [("a", "1", "d", 5), ("b", "n", "x", 1), ("c", "p", None, 2)]


def test_messages(spark, tmp_path):
    docs = spark.createDataFrame([(1, "f1", "invoice", "Invoice", ""), (2, "f2", "act", "Act", "date,total")], "doc_id bigint, folder string, doc_type string, object string, missing string")
    fields = spark.createDataFrame([(1, "number", "7"), (1, "total", "9.00"), (1, "colour", "red & <blue>"), (2, "number", "8")], "doc_id bigint, key string, value string")
    items = spark.createDataFrame([(1, 1, "bolt", "2", "pc", "1.00", "2.00"), (1, 2, "nut", "1", "pc", "7.00", "7.00")], "doc_id bigint, line_no int, name string, qty string, unit string, price string, amount string")
    payload = exchange.build_payload(docs, fields, items, "create")
    path = str(tmp_path / "out")
    assert exchange.write_exchange_xml(payload, path).count() == 0
    assert exchange.write_exchange_xml(payload, path).count() == 0
    back = {r["SourceId"]: r for r in exchange.read_exchange_xml(spark, path).collect()}
    assert set(back) == {1, 2} and back[1]["Number"] == 7 and [x["Name"] for x in back[1]["Lines"]["Line"]] == ["bolt", "nut"]
    changed = exchange.build_payload(docs, fields.where("key <> 'total'"), items, "create")
    assert [r["doc_id"] for r in exchange.write_exchange_xml(changed, path).collect()] == [1]


def test_readers(spark, tmp_path):
    (tmp_path / "d1-words.tsv").write_text("x0\ty0\tx1\ty1\ttext\n1\t2\t3\t4\tслово\tещё\nx\t2\t3\t4\tплохо\n")
    assert [tuple(r) for r in exchange.read_words_tsv(spark, str(tmp_path / "d1-words.tsv")).collect()] == [("d1", 1.0, 2.0, 3.0, 4.0, "слово\tещё")]
    (tmp_path / "d2.tsv").write_text("level\tpage_num\tb\tp\tl\tw\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t10\t20\t30\t5\t96\tok\n5\t1\t1\t1\t1\t2\t10\t20\t30\t5\t-1\tno\n5\t1\t1\t1\t1\t3\t10\t20\t30\t5\t90\t \n")
    assert [tuple(r) for r in exchange.read_ocr_tsv(spark, str(tmp_path / "d2.tsv")).collect()] == [("d2", 1, 10.0, 20.0, 40.0, 25.0, "ok")]
    answers = spark.createDataFrame([(1, '{"doc_type":"act","fields":{"Number":12,"date":null,"x":{"y":1}}}'), (2, '{"number":"5"}'), (3, "not json")], "doc_id bigint, answer string")
    assert sorted(map(tuple, exchange.parse_model_answer(answers).collect())) == [(1, "date", ""), (1, "number", "12"), (1, "x", ""), (2, "number", "5")]
    parsed = exchange.parse_recognition(spark.createDataFrame([(1, '{"doc_type":"act","fields":{"number":{"value":"7","confidence":0.9,"source":"rule"}}}'), (2, "{")], "doc_id bigint, recognition string"))
    assert {r["doc_id"]: r["bad_json"] for r in parsed.collect()} == {1: False, 2: True}
    assert [tuple(r) for r in exchange.fields_from_recognition(parsed).collect()] == [(1, "number", "7", 0.9, "rule")]


def test_markdown(spark):
    cells = spark.createDataFrame([(1, 0, 0, "Имя", "a|b", False), (1, 0, 1, "", "x\ny", False), (1, 1, 0, "Имя", "Σ", True), (1, 1, 1, "", "5", True)], "doc_id bigint, row_no int, col_no int, title string, value string, is_total boolean")
    assert exchange.table_markdown(cells).first()["md"] == "| Имя | гр.2 |\n| --- | --- |\n| a\\|b | x y |\n| Σ | 5 |"


def test_golden_outcomes(spark):
    expected = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (1, "c", None), (1, "d", "y"), (2, "a", "z")], "doc_id bigint, key string, value string")
    actual = spark.createDataFrame([(1, "a", " x "), (1, "b", ""), (1, "c", "v"), (1, "e", "w"), (3, "a", "q")], "doc_id bigint, key string, value string")
    got = {(r["doc_id"], r["key"]): r["outcome"] for r in accuracy.compare_golden(expected, actual).collect()}
    assert got == {(1, "a"): "matched", (1, "b"): "skipped", (1, "c"): "extra", (1, "d"): "missing", (1, "e"): "unexpected", (2, "a"): "missing"}


def test_streams_equal_batches(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(k, k % 4, "posted" if k % 3 == 0 else "error", day + dt.timedelta(minutes=k)) for k in range(40)]
    events = spark.createDataFrame(rows, "event_id bigint, doc_id bigint, status string, ts timestamp")
    for part in range(2):
        events.where(f"event_id % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name, mode="update"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    last = run(flows.stream_archive(stream), "archived").groupBy("doc_id").agg(F.min("archived_at").alias("archived_at"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, flows.B.first_closing(events).collect()))
    attempts = stream.select("doc_id", "ts", (F.col("status") == "posted").alias("ok"))
    states = run(flows.stream_export_queue(attempts), "queue")
    assert {r["status"] for r in states.collect()} <= {"pending", "done", "failed"} and states.select("doc_id").distinct().count() == 4
