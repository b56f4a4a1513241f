"""Queries of the table operators: lines are printed as layouts, grids and cells, read back and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..operators import columns, positions, tables
from .registry import query

TITLES = ("Наименование", "Кол-во", "Ед.", "Цена", "Сумма")


def _cells() -> Column:
    return F.array("name", F.col("qty").cast("string"), F.lit("шт"), money.format_cents(F.col("price")), money.format_cents(F.col("amount")))


def _by_document(lines: DataFrame, row: Column) -> DataFrame:
    """doc_id and its rows in order. Rows are made below the aggregate, which would interpret their expressions."""
    made = lines.select("doc_id", F.struct("line_no", row.alias("r")).alias("row"))
    rows = made.groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return rows.select("doc_id", F.transform("rows", lambda r: r["r"]).alias("rows"))


def _total(total: Column) -> Column:
    return F.array(F.lit("Итого:"), F.lit(""), F.lit(""), F.lit(""), money.format_cents(total))


def layouts(lines: DataFrame, totals: DataFrame, bars: bool = True) -> DataFrame:
    """Printed pages; every third name goes on in a line of its own."""
    sep = " | " if bars else "    "
    head, rest = F.substring_index("name", " ", 1), F.expr("substring(name, length(substring_index(name, ' ', 1)) + 2)")
    wraps = (F.col("line_no") % 3 == 0) & (rest != "")
    cells = _cells()
    first = F.concat(F.array(F.when(wraps, head).otherwise(F.col("name"))), F.slice(cells, 2, 4))
    printed = F.concat(F.array_join(first, sep), F.when(wraps, F.concat(F.lit("\n"), rest)).otherwise(F.lit("")))
    pages = _by_document(lines, printed).join(totals, "doc_id")
    lead = F.array(F.lit("Счёт на оплату"), F.lit(sep.join(TITLES)), F.lit(sep.join("12345")))
    tail = F.array(F.array_join(_total(F.col("total")), " | "), F.lit("Руководитель"))
    return pages.select("doc_id", F.array_join(F.concat(lead, "rows", tail), "\n").alias("layout"))


def grids(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Detected grids; half of them have no flagged header."""
    pages = _by_document(lines, _cells()).join(totals, "doc_id")
    head = F.array(F.array(*(F.lit(t) for t in TITLES)), F.array(*(F.lit(str(k)) for k in range(1, 6))))
    rows = pages.select("doc_id", F.posexplode(F.concat(head, "rows", F.array(_total(F.col("total"))))).alias("row", "cells"))
    cells = rows.select("doc_id", "row", F.posexplode("cells").alias("col", "text"))
    return cells.select("doc_id", F.lit(0).alias("grid_no"), "row", "col", ((F.col("row") == 0) & (F.col("doc_id") % 2 == 0)).alias("header"), "text")


def plain_tables(rows: DataFrame, titles: tuple[str, ...], source: str = "model") -> DataFrame:
    names = F.array(*(F.lit(t) for t in titles))
    return rows.select("doc_id", F.lit(source).alias("source"), names.alias("titles"), tables.assign_roles(names).alias("roles"), "rows", F.array().cast(tables.ROWS).alias("totals"))


def _read(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "line_no", "name", F.col("qty").cast("bigint").alias("qty"), "unit", money.cents(F.col("price")).alias("price"), money.cents(F.col("amount")).alias("amount"))


_LINES = "SELECT doc_id, CAST(line_no AS INT) AS line_no, name, qty, 'шт' AS unit, price, amount FROM lines"


@query("t2_table_from_layout", _LINES, "lines", "totals")
def t2(lines, totals):
    return _read(tables.lines_from_cells(tables.table_from_layout(layouts(lines, totals))))


@query("t3_free_table_from_layout", _LINES, "lines", "totals")
def t3(lines, totals):
    return _read(tables.lines_from_cells(tables.free_table_from_layout(layouts(lines, totals, bars=False))))


@query("t5_table_from_grid", _LINES, "lines", "totals")
def t5(lines, totals):
    return _read(tables.lines_from_cells(tables.table_from_grid(grids(lines, totals))))


@query("t5_grid_totals", "SELECT t.doc_id, total FROM totals t JOIN (SELECT DISTINCT doc_id FROM lines) l ON l.doc_id = t.doc_id", "lines", "totals")
def t5_totals(lines, totals):
    found = tables.table_from_grid(grids(lines, totals))
    return found.select("doc_id", money.cents(F.element_at(F.element_at("totals", 1), -1)).alias("total"))


@query("t7_clean_table", "SELECT DISTINCT doc_id, name, qty, price, amount FROM lines", "lines")
def t7(lines):
    rows = _by_document(lines, _cells())
    noise = lambda *cells: F.array(F.array(*(F.lit(c) for c in cells)))
    worse = F.concat(noise(*"12345"), F.slice("rows", 1, 1), noise(*TITLES), "rows", noise("", "", "", "", ""), noise("Итого", "", "", "", "1.00"))
    wide = F.transform(worse, lambda r: F.concat(r, F.array(F.lit(" "))))
    done = tables.clean_table(plain_tables(rows.select("doc_id", wide.alias("rows")), (*TITLES, "Примечание")))
    return _read(tables.lines_from_cells(done)).select("doc_id", "name", "qty", "price", "amount")


_TAXED = "SELECT doc_id, line_no, amount AS net, (amount * 20 + 50) // 100 AS vat FROM lines"


def _taxed(lines: DataFrame, order: tuple[str, ...]) -> DataFrame:
    lines = lines.withColumn("net", F.col("amount")).withColumn("vat", F.floor((F.col("amount") * 20 + 50) / 100)).withColumn("total", F.col("net") + F.col("vat"))
    return _by_document(lines, F.array("name", *(money.format_cents(F.col(k)) for k in order)))


@query("t11_assign_amounts", f"SELECT doc_id, CAST(line_no AS INT) AS line_no, net, vat, net + vat AS total FROM ({_TAXED}) x UNION ALL SELECT -doc_id - 1, CAST(line_no AS INT), net, vat, net + vat FROM ({_TAXED}) y", "lines")
def t11(lines):
    """Under captions, and (with negative ids) by the sums alone."""
    named = plain_tables(_taxed(lines, ("total", "vat", "net")), ("Наименование", "Стоимость с НДС", "НДС", "Стоимость без НДС"))
    bare = plain_tables(_taxed(lines, ("net", "vat", "total")), ("Наименование", "Сумма", "НДС", "Всего")).withColumn("doc_id", -F.col("doc_id") - 1)
    found = tables.lines_from_cells(named.unionByName(bare))
    return found.select("doc_id", "line_no", *(money.cents(F.col(a)).alias(b) for a, b in (("amount_no_vat", "net"), ("vat", "vat"), ("amount", "total"))))


_FORM = {"name": "Наименование", "qty": "Кол-во", "unit": "Ед.", "price": "Цена", "amount": "Сумма", "vat": "НДС"}
_VALUES = ("name", "CAST(qty AS VARCHAR)", "'шт'", "CAST(price AS VARCHAR)", "CAST(amount AS VARCHAR)", "''")


def _six(lines: DataFrame) -> DataFrame:
    return tables.cells_from_lines(lines.withColumn("unit", F.lit("шт")).withColumn("vat", F.lit("")), _FORM)


@query("t12_cells_from_lines", " UNION ALL ".join(f"SELECT doc_id, CAST(line_no - 1 AS INT) AS row_no, CAST({k} AS INT) AS col_no, '{_FORM[r]}' AS title, '{r}' AS role, {v} AS value FROM lines" for k, (r, v) in enumerate(zip(_FORM, _VALUES, strict=True))), "lines")
def t12(lines):
    return _six(lines)


@query("t13_table_struct", "SELECT doc_id, md5(string_agg(concat_ws(',', name, CAST(qty AS VARCHAR), 'шт', CAST(price AS VARCHAR), CAST(amount AS VARCHAR), ''), ';' ORDER BY line_no)) AS body, 'Наименование,Кол-во,Ед.,Цена,Сумма,НДС' AS titles FROM lines GROUP BY 1", "lines")
def t13(lines):
    made = tables.table_struct(_six(lines).withColumns({"source": F.lit("model"), "is_total": F.lit(False)}))
    return made.select("doc_id", F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")).alias("body"), F.array_join("titles", ",").alias("titles"))


_SCORE = """
    SELECT l.doc_id, round(0.65 + 0.2 * ok / n + CASE WHEN t.total > 0 AND abs(s - t.total) <= greatest(5, t.total * 0.02) THEN 0.15 ELSE 0 END - 0.2 * (n - d) / n, 6) AS score, CAST(n AS INT) AS n_rows
    FROM (SELECT doc_id, count(*) AS n, sum(amount) AS s, count(DISTINCT concat_ws('|', name, qty, price, amount)) AS d, count(*) FILTER (WHERE abs(qty * price - amount) <= greatest(5, amount * 0.02)) AS ok FROM lines GROUP BY 1) l
    JOIN totals t ON t.doc_id = l.doc_id"""


@query("a15_score_tables", _SCORE, "lines", "totals")
def a15(lines, totals):
    return tables.score_tables(tables.table_from_layout(layouts(lines, totals))).select("doc_id", "score", F.col("diagnostics.n_rows").alias("n_rows"))


@query("w25_pick_best_table", "SELECT DISTINCT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'layout' ELSE 'grid' END AS source FROM lines", "lines", "totals")
def w25(lines, totals):
    """Grids of even documents lost their last column."""
    grid = tables.table_from_grid(grids(lines, totals))
    cut = F.transform("rows", lambda r: F.when(F.col("doc_id") % 2 == 0, F.concat(F.slice(r, 1, 4), F.array(F.lit("")))).otherwise(r))
    candidates = tables.table_candidates(tables.table_from_layout(layouts(lines, totals)), grid.withColumn("rows", cut))
    return tables.pick_best_table(candidates).select("doc_id", "source")


@query("w24_hidden_totals", "SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 OR n < 2 THEN n + 1 ELSE n END AS INT) AS n_rows, CAST(CASE WHEN doc_id % 3 = 0 OR n < 2 THEN 0 ELSE 1 END AS INT) AS n_totals FROM (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1) x", "lines")
def w24(lines):
    """Sums below the rows without a caption; wrong ones in every third document."""
    sums = lines.groupBy("doc_id").agg(F.sum("qty").alias("q"), F.sum("amount").alias("s"))
    last = F.array(F.lit(""), F.col("q").cast("string"), F.lit(""), F.lit(""), money.format_cents(F.col("s") + F.when(F.col("doc_id") % 3 == 0, 5000).otherwise(0)))
    rows = _by_document(lines, _cells()).join(sums, "doc_id").select("doc_id", F.concat("rows", F.array(last)).alias("rows"))
    return tables.take_hidden_totals(plain_tables(rows, TITLES)).select("doc_id", F.size("rows").alias("n_rows"), F.size("totals").alias("n_totals"))


@query("a21_roles_by_arithmetic", "SELECT DISTINCT doc_id, CAST(2 AS INT) AS net_col, CAST(3 AS INT) AS vat_col, CAST(1 AS INT) AS total_col FROM lines WHERE doc_id % 4 <> 0", "lines")
def a21(lines):
    """Total, net and VAT without captions; every fourth document's totals are wrong."""
    rows = _taxed(lines, ("total", "net", "vat"))
    off = F.transform("rows", lambda r: F.when(F.col("doc_id") % 4 == 0, F.concat(F.slice(r, 1, 1), F.array(F.concat(F.lit("1"), F.get(r, F.lit(1)))), F.slice(r, 3, 2))).otherwise(r))
    cells = tables.cells_long(plain_tables(rows.withColumn("rows", off), ("a", "b", "c", "d")))
    return tables.infer_roles_by_arithmetic(cells).select("doc_id", "net_col", "vat_col", "total_col")


@query("a22_roles_reconcile", "SELECT doc_id, CAST(count(*) FILTER (WHERE line_no % 2 = 1) AS BIGINT) AS ok, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY 1", "lines")
def a22(lines):
    wrong = lines.withColumn("net", F.col("amount")).withColumn("vat", F.floor((F.col("amount") * 20 + 50) / 100)).withColumn("total", F.col("net") + F.col("vat") + F.when(F.col("line_no") % 2 == 0, 5).otherwise(0))
    rows = _by_document(wrong, F.array("name", *(money.format_cents(F.col(k)) for k in ("net", "vat", "total"))))
    cells = tables.cells_long(plain_tables(rows, ("a", "b", "c", "d")))
    roles = rows.select("doc_id", F.lit("model").alias("source"), F.lit(1).alias("net_col"), F.lit(2).alias("vat_col"), F.lit(3).alias("total_col"))
    return tables.roles_reconcile(cells, roles).select("doc_id", "ok", "n")


@query("f14_table_suspicious", "SELECT l.doc_id, CAST(coalesce(d < n OR (total > 0 AND abs(s - total) * 100 > total), false) AS INT) AS suspicious FROM (SELECT doc_id, count(*) AS n, sum(amount) AS s, count(DISTINCT concat_ws('|', name, qty, price, amount)) AS d FROM lines GROUP BY 1) l JOIN totals t ON t.doc_id = l.doc_id", "lines", "totals")
def f14(lines, totals):
    found = tables.table_suspicious(tables.table_from_layout(layouts(lines, totals)), totals)
    return found.select("doc_id", F.col("suspicious").cast("int").alias("suspicious"))


@query("w23_absorb_header_rows", "SELECT doc_id, 'Наименование товара,Кол-во штук,Ед. изм.,Цена тариф,Сумма всего' AS titles, CAST(count(*) AS INT) AS n_rows FROM lines GROUP BY 1", "lines")
def w23(lines):
    second = F.array(*(F.lit(x) for x in ("товара", "штук", "изм.", "тариф", "всего")))
    rows = _by_document(lines, _cells()).select("doc_id", F.concat(F.array(second), "rows").alias("rows"))
    return tables.absorb_header_rows(plain_tables(rows, TITLES)).select("doc_id", F.array_join("titles", ",").alias("titles"), F.size("rows").alias("n_rows"))


@query("w28_fix_name_column", "SELECT DISTINCT doc_id, 'index,name,qty,amount' AS roles FROM lines", "lines")
def w28(lines):
    """Codes stand under the name's caption."""
    rows = _by_document(lines, F.array(F.col("part_id").cast("string"), "name", F.col("qty").cast("string"), money.format_cents(F.col("amount"))))
    return tables.fix_name_column(plain_tables(rows, ("Наименование", "x", "Кол-во", "Сумма"))).select("doc_id", F.array_join("roles", ",").alias("roles"))


def _several_lines(lines: DataFrame) -> DataFrame:
    """Printed rows of each document. By line_no modulo 4: VAT and total one line below; the name begun above
    and its address in a column for numbers; the name's tail below; all on one line."""
    vat = F.floor((F.col("amount") * 20 + 50) / 100)
    net, tax, whole = (money.format_cents(c) for c in (F.col("amount"), vat, F.col("amount") + vat))
    name, blank = F.initcap("name"), F.lit("")
    row = lambda *cells: F.array(*cells)
    full = lambda n: row(n, F.col("qty").cast("string"), money.format_cents(F.col("price")), net, F.lit("20%"), tax, whole)
    split = row(name, F.col("qty").cast("string"), money.format_cents(F.col("price")), net, F.lit("20%"), blank, blank)
    kind = F.col("line_no") % 4
    printed = F.when(kind == 0, F.array(split, row(*[blank] * 5, tax, whole)))
    printed = printed.when(kind == 1, F.array(row(name, blank, blank, F.lit("ул. Лесная"), blank, blank, blank), full(F.lit("(часть)"))))
    printed = printed.when(kind == 2, F.array(full(name), row(F.lit("в коробке"), *[blank] * 6))).otherwise(F.array(full(name)))
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", printed.alias("r")))).alias("rows"))
    return plain_tables(rows.select("doc_id", F.flatten(F.transform("rows", lambda r: r["r"])).alias("rows")), ("Наименование", "Кол-во", "Цена", "Стоимость без НДС", "Ставка НДС", "Сумма НДС", "Всего с НДС"))


_NAME = "array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


@query("w22_merge_multiline_rows", f"""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS line_no,
        CASE line_no % 4 WHEN 1 THEN {_NAME} || ' (часть) ул. Лесная' WHEN 2 THEN {_NAME} || ' в коробке' ELSE {_NAME} END AS name,
        qty, amount AS net, (amount * 20 + 50) // 100 AS vat, amount + (amount * 20 + 50) // 100 AS total
    FROM lines""", "lines")  # fmt: skip
def w22(lines):
    found = tables.lines_from_cells(positions.merge_multiline_rows(_several_lines(lines)))
    return found.select("doc_id", "line_no", "name", F.col("qty").cast("bigint").alias("qty"), *(money.cents(F.col(a)).alias(b) for a, b in (("amount_no_vat", "net"), ("vat", "vat"), ("amount", "total"))))


def _answered(lines: DataFrame) -> DataFrame:
    """Models' answers whose rows stand in five orders; a third of the rows lack their last cell, and
    every document ends with a total."""
    value = lambda c: money.format_cents(F.col(c))
    q = F.concat(F.col("qty").cast("string"), F.lit(".500"))  # no order but one fits a quantity with a fraction
    a = money.format_cents(F.floor((2 * F.col("qty") + 1) * F.col("price") / 2))
    orders = [(q, value("price"), a), (a, q, value("price")), (value("price"), a, q), (q, a, value("price")), (a, value("price"), q)]
    kind = F.col("line_no") % len(orders)
    cells = F.coalesce(*(F.when(kind == k, F.array("name", *o)) for k, o in enumerate(orders)))
    row = F.when(F.col("line_no") % 3 == 0, cells).otherwise(F.concat(cells, F.array(F.lit("шт"))))
    rows = _by_document(lines, row)
    whole = F.concat("rows", F.array(F.array(F.lit("Итого"), F.lit(""), F.lit(""), F.lit("1.00"))))
    columns = F.array(*(F.lit(t) for t in ("Наименование", "Кол-во", "Цена", "Сумма", "Ед.")))
    return rows.select("doc_id", F.to_json(F.struct(F.struct(columns.alias("columns"), whole.alias("rows")).alias("table"))).alias("answer"))


@query("t6_table_from_model", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS line_no, name, CASE WHEN line_no % 3 = 0 THEN '' ELSE 'шт' END AS unit, ((2 * qty + 1) * price) // 2 AS amount, 1 AS n_totals FROM lines", "lines")
def t6(lines):
    found = positions.table_from_model(_answered(lines))
    lines_ = tables.lines_from_cells(found, F.size("totals"))
    return lines_.select("doc_id", "line_no", "name", "unit", money.cents(F.col("amount")).alias("amount"), F.col("_0").alias("n_totals"))


_ROTATED = "list_value(qty * 100, price, amount, 0)[1 + ({} + line_no) % 4]"


@query("t9_repair_row_order", f"""
    SELECT doc_id, line_no, CASE WHEN fits THEN amount ELSE {_ROTATED.format(2)} END AS amount, CASE WHEN fits THEN 0 ELSE {_ROTATED.format(3)} END AS rate
    FROM (SELECT *, abs(qty * price - amount) <= greatest(2, qty * price * 0.01) AS fits FROM lines) l""", "lines")  # fmt: skip
def t9(lines):
    """Quantity, price, amount and rate in four rotations; rows whose product is another stay as they are."""
    cells = [F.col("qty").cast("string"), money.format_cents(F.col("price")), money.format_cents(F.col("amount")), F.lit("0%")]
    kind = F.col("line_no") % 4
    row = F.coalesce(*(F.when(kind == k, F.array(F.col("line_no").cast("string"), *cells[k:], *cells[:k])) for k in range(4)))
    done = positions.repair_row_order(plain_tables(_by_document(lines, row), ("№", "Кол-во", "Цена", "Сумма", "Ставка НДС")))
    r = done.select("doc_id", F.explode("rows").alias("r"))
    return r.select("doc_id", F.get("r", F.lit(0)).cast("bigint").alias("line_no"), *(money.cents(F.regexp_replace(F.get("r", F.lit(k)), "%", "")).alias(n) for k, n in ((3, "amount"), (4, "rate"))))


COLUMN_X = {"name": 40, "qty": 400, "price": 520, "amount": 680}


def _printed_words(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Pages as word boxes: a text, captions, the lines, a total, a signature. Odd documents are skewed, and
    their rows are as high as the skew across a page."""
    word = lambda text, x, y: F.struct(text.alias("text"), x.cast("double").alias("x0"), y.cast("double").alias("y"))
    y = 100 + 40 * F.col("line_no")
    names = F.split("name", " ")
    first = F.get(names, F.lit(0))
    cells = [word(first, F.lit(40), y), word(F.get(names, F.lit(1)), 48 + 8 * F.length(first), y)]
    cells += [word(v, F.lit(COLUMN_X[c]), y) for c, v in (("qty", F.col("qty").cast("string")), ("price", money.format_cents(F.col("price"))), ("amount", money.format_cents(F.col("amount"))))]
    made = lines.select("doc_id", "line_no", F.array(*cells).alias("w"))  # below the aggregate, which would interpret them
    body = made.groupBy("doc_id").agg(F.flatten(F.collect_list("w")).alias("w"), F.max("line_no").alias("n"))
    fixed = [(t, x, 20) for t, x in (("Накладная", 40), ("за", 300), ("день", 500))] + [(t, x, 90) for t, x in zip(("Наименование", "Кол-во", "Цена", "Сумма"), COLUMN_X.values(), strict=True)]
    head = F.array(*(word(F.lit(t), F.lit(x), F.lit(v)) for t, x, v in fixed))
    tail = F.array(word(F.lit("Итого"), F.lit(40), 150 + 40 * F.col("n")), word(money.format_cents(F.col("total")), F.lit(680), 150 + 40 * F.col("n")), word(F.lit("Директор"), F.lit(40), 220 + 40 * F.col("n")))
    words = body.join(totals, "doc_id").select("doc_id", F.posexplode(F.concat(head, "w", tail)).alias("seq", "w")).where("w.text is not null")
    down = F.when(F.col("doc_id") % 2 == 1, F.col("w.x0") * 0.025).otherwise(0.0)
    words = words.select("doc_id", F.lit(1).alias("page_no"), F.col("seq").cast("bigint").alias("seq"), "w.text", "w.x0", (F.col("w.y") + down).alias("y0"))
    return words.select("doc_id", "page_no", "seq", "text", "x0", "y0", (F.col("x0") + 8 * F.length("text")).alias("x1"), (F.col("y0") + 24).alias("y1"))


@query("t4_table_from_words", "SELECT doc_id, name, qty, price, amount FROM (SELECT DISTINCT doc_id, name, qty, price, amount FROM lines) x", "lines", "totals")
def t4(lines, totals):
    found = columns.table_from_words(_printed_words(lines, totals))
    return _read(tables.lines_from_cells(found)).select("doc_id", "name", "qty", "price", "amount")


@query("w8_find_table_band", "SELECT doc_id, CAST(0 AS INT) AS head, CAST(2 AS INT) AS first, CAST(count(*) + 2 AS INT) AS last FROM lines GROUP BY 1", "lines", "totals")
def w8(lines, totals):
    """The text right above the captions is taken for their first line: it has no sum, and the higher beginning wins."""
    from ..operators import geometry

    rows = columns.page_rows(geometry.straight_rows(_printed_words(lines, totals)))
    return columns.find_table_band(rows).select("doc_id", *(F.col(c).cast("int").alias(c) for c in ("head", "first", "last")))


@query("j14_split_across_bands", "SELECT doc_id, line_no, name, CAST(qty AS VARCHAR) AS qty, CAST(amount AS VARCHAR) AS amount FROM lines", "lines")
def j14(lines):
    """Name, quantity and amount of a line as one box, read back into three columns. Boxes of letters equally wide."""
    text = F.concat_ws(" ", "name", F.col("qty").cast("string"), F.col("amount").cast("string"))
    token = lines.select("doc_id", F.lit(1).alias("page_no"), F.col("line_no").alias("seq"), text.alias("text"), F.lit(0.0).alias("x0"), (10.0 * F.length(text)).alias("x1"), (10.0 * F.length("name") + 5).alias("a"), (10.0 * (F.length("name") + F.length(F.col("qty").cast("string"))) + 15).alias("b"))
    edge = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    pages = token.select((F.col("doc_id") * 100 + F.col("seq")).alias("doc_id"), "page_no", F.col("doc_id").alias("own"), "seq", "text", "x0", "x1", F.array(edge(F.lit(-1), F.col("a")), edge(F.col("a"), F.col("b")), edge(F.col("b"), F.col("x1") + 1)).alias("bands"))
    cut = columns.split_across_bands(pages.drop("bands"), pages.select("doc_id", "page_no", "bands"))
    at = lambda k: F.max(F.when(F.col("band") == k, F.col("text")))
    return cut.groupBy("own", "seq").agg(at(0).alias("name"), at(1).alias("qty"), at(2).alias("amount")).select(F.col("own").alias("doc_id"), F.col("seq").alias("line_no"), "name", "qty", "amount")


_SHEET = "SELECT doc_id // 32 AS sheet, row_number() OVER (PARTITION BY doc_id // 32 ORDER BY doc_id, line_no) - 1 AS r, amount FROM lines"


def _sheets(lines: DataFrame, slide: int) -> DataFrame:
    """The lines of 32 documents on one page, five columns that slide down by ``slide`` each."""
    from pyspark.sql import Window

    rows = lines.withColumn("sheet", F.floor(F.col("doc_id") / 32))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("sheet").orderBy("doc_id", "line_no")) - 1).drop("doc_id").withColumnRenamed("sheet", "doc_id")
    cells = [F.lit("Позиция"), *(F.concat(F.col("amount").cast("string"), F.lit(f",{b}0")) for b in range(4))]
    boxes = F.array(*(F.struct(F.lit(k).alias("k"), c.alias("text"), F.lit(20.0 if k == 0 else 50.0 + 100 * k).alias("x0"), (100 + 40 * F.col("r") + slide * max(k - 1, 0)).cast("double").alias("y0")) for k, c in enumerate(cells)))
    words = rows.select("doc_id", "r", F.explode(boxes).alias("w"))
    return words.select("doc_id", F.lit(1).alias("page_no"), (F.col("r") * 5 + F.col("w.k")).cast("bigint").alias("seq"), "w.text", "w.x0", "w.y0", (F.col("w.x0") + 60).alias("x1"), (F.col("w.y0") + 12).alias("y1"))


def _sheet_bands() -> Column:
    edge = lambda lo, hi: F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    return F.array(edge(0, 120), *(edge(130 + 100 * b, 230 + 100 * b) for b in range(4)))


@query("w13_column_drift", f"SELECT sheet AS doc_id, unnest(range(5 * r, 5 * r + 5)) AS seq, CAST(r AS INT) AS row_no, CAST(100 + 40 * r AS DOUBLE) AS y0 FROM ({_SHEET}) x", "lines")
def w13(lines):
    from ..operators import geometry

    rows = geometry.group_words_into_rows(_sheets(lines, 9)).withColumn("band", columns.band_at((F.col("x0") + F.col("x1")) / 2, _sheet_bands()))
    return columns.fix_column_drift(rows).select("doc_id", "seq", "row_no", F.round("y0", 6).alias("y0"))


@query("j18_row_shift", f"SELECT sheet AS doc_id, CAST(unnest([2, 3, 4]) AS INT) AS band, CAST(9 AS DOUBLE) AS shift FROM ({_SHEET}) x GROUP BY 1", "lines")
def j18(lines):
    items = _sheets(lines, 9).withColumn("band", columns.band_at((F.col("x0") + F.col("x1")) / 2, _sheet_bands())).withColumn("c", (F.col("y0") + F.col("y1")) / 2)
    return columns.nearest_row_shift(items.where("band > 0"), columns.row_pitch(items)).select("doc_id", "band", F.round("shift", 6).alias("shift"))


@query("w7_split_by_numbers", f"SELECT sheet AS doc_id, CAST(unnest([0, 130, 230, 345, 430]) AS DOUBLE) AS lo FROM ({_SHEET}) x GROUP BY 1", "lines")
def w7(lines):
    """Two columns of decimals, 40 apart, were found as one; the cut lies in the middle of the gap."""
    edge = lambda lo, hi: F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    sheets = _sheets(lines, 0)
    bands = sheets.select("doc_id", "page_no").distinct().withColumn("bands", F.array(edge(0, 130), edge(130, 345), edge(345, 430), edge(430, 500)))
    rows = sheets.withColumn("row_no", F.floor(F.col("seq") / 5).cast("int"))
    cut = columns.split_bands_by_numbers(bands, rows)
    return cut.select("doc_id", F.explode("bands").alias("b")).select("doc_id", F.col("b.lo").alias("lo"))
