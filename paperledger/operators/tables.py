"""Tables of a page: from its layout text, from a detected grid, cleaned, turned into lines, scored.

A table is one row: doc_id, source, titles and roles (arrays, one entry for each column), rows and
totals (arrays of arrays of cells). What a page can hold bounds it, so its steps are expressions over
arrays: no shuffle, and the order of rows and columns needs no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents, clean_cell
from ..functions.text import contains_any, first_where, let, lower_e

ROW = "array<string>"
ROWS = "array<array<string>>"

#: Parts of captions, by the role of their column, in the order in which they are tried.
ROLE_WORDS = {
    "name": ("наимен", "описан", "номенклат", "товар", "услуг", "работ", "description"),
    "qty": ("кол-во", "колич", "кол.", "qty", "quantity"),
    "unit": ("ед.", "единиц", "изм", "unit"),
    "price": ("цен", "тариф", "price"),
    "amount": ("сумм", "стоимост", "всего", "amount"),
    "index": ("№", "п/п", "код", "артикул", "sku"),
}
WITH_VAT = ("с ндс", "с учетом ндс", "включая ндс", "with vat")
WITHOUT_VAT = ("без ндс", "без учета ндс", "without vat")
#: Beginnings of total lines, of lines that end a table, and words that totals are mistaken for.
TOTAL_WORDS = ("итого", "всего", "total")
END_WORDS = ("руковод", "главный бух", "отпустил", "получил", "принял", "подпис", "м.п", "сумма прописью")
PLAIN_TOTALS = ("итого", "всего")


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, each computed once for a row. A plain projection could be merged with the
    next one, and an expression then be copied into every function over an array that refers to it."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def title_with_vat(title: Column) -> Column:
    """C15. The caption names an amount that includes VAT."""
    return let(lower_e(title), lambda t: contains_any(t, WITH_VAT))


def title_without_vat(title: Column) -> Column:
    """C15. The caption names an amount without VAT."""
    return let(lower_e(title), lambda t: contains_any(t, WITHOUT_VAT))


def role_of(low: Column) -> Column:
    """C14 of a caption in lower case without blanks at its ends."""
    role = F.when(contains_any(low, ("ставк", "rate")), F.lit("vat_rate"))
    role = role.when(contains_any(low, ("ндс", "vat", "налог")) & ~contains_any(low, WITH_VAT) & ~contains_any(low, WITHOUT_VAT), F.lit("vat"))
    for name, words in ROLE_WORDS.items():
        role = role.when(contains_any(low, words), F.lit(name))
    return role.otherwise(F.lit("other"))


def column_role(title: Column) -> Column:
    """C14. name, qty, unit, price, amount, vat, vat_rate, index or other."""
    return let(lower_e(F.trim(title)), role_of)


def assign_roles(titles: Column) -> Column:
    """T8. Role of each column; without a name the first free column is the name."""

    def named(roles: Column) -> Column:
        free = F.array_position(roles, "other").cast("int")
        return F.when(F.array_contains(roles, "name") | (free == 0), roles).otherwise(F.transform(roles, lambda r, i: F.when(i == free - 1, F.lit("name")).otherwise(r)))

    return let(F.transform(titles, column_role), named)


def letter_diff(a: Column, b: str) -> Column:
    """C21. Letters of either word that the other lacks, counted with repetition."""
    own = lambda low: F.length(low) + len(b) - 2 * sum((F.least(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit(""))), F.lit(b.count(x))) for x in dict.fromkeys(b)), F.lit(0))
    return F.when(a.rlike(r"^\p{L}*$"), let(lower_e(a), own)).otherwise(F.lit(99))


def garbled_total_word(c: Column) -> Column:
    """C21. A damaged "итого" or "всего": four to six letters, at most two off."""
    off = lambda w: F.least(*(letter_diff(w, t) for t in PLAIN_TOTALS)) <= 2
    word = let(F.regexp_replace(F.trim(c), r"[.:;,]+$", ""), lambda w: (F.length(w) >= 4) & (F.length(w) <= 6) & off(w))
    return c.rlike(r"^ *\p{L}{2,6}\P{L}*$") & word


#: How numerals begin.
NUMERAL_STEMS = ("один", "одна", "одно", "два", "две", "три", "четыр", "пят", "шест", "сем", "восем", "девят", "десят", "сорок", "тысяч", "миллион")


def is_spelled_amount(c: Column) -> Column:
    """C22. An amount in words: a word that begins like a numeral, or "сто", and one that names roubles or kopecks."""
    words = F.transform(F.split(lower_e(F.trim(c)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}]+", ""))
    numeral = lambda w: starts(w, NUMERAL_STEMS) | (F.regexp_replace(w, r"[^\p{L}]+$", "") == "сто")
    return let(words, lambda ws: F.exists(ws, lambda w: starts(w, ("рубл", "копе"))) & F.exists(ws, numeral))


def is_name_word(c: Column) -> Column:
    """C22. A word that can be part of an item's name: three letters or more, no total, no number."""
    w = lower_e(F.trim(c))
    return w.rlike(r"\p{L}.*\p{L}.*\p{L}") & ~starts(w, TOTAL_WORDS)


def starts(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.startswith(w)
    return out


def filled(cells: Column) -> Column:
    """Number of cells that aren't blank."""
    return F.size(F.filter(cells, lambda c: F.trim(c) != ""))


def is_numbering_row(cells: Column) -> Column:
    """C23. Column numbers below the header: 1, 2, 3 and so on in all of three cells or more."""
    plain = lambda c: F.regexp_replace(F.trim(c), "[.)]$", "")
    counts = lambda said: F.forall(F.transform(said, lambda c, i: plain(c) == (i + 1).cast("string")), lambda x: x)
    numbered = let(_said(cells), lambda said: (F.size(said) >= 3) & (plain(F.get(said, F.lit(0))) == "1") & counts(said))
    first = F.trim(F.get(cells, F.lit(0)))
    return F.when((first != "") & ~first.startswith("1"), False).otherwise(numbered)  # most rows begin with a name


def is_section_row(cells: Column) -> Column:
    """C23. A row that heads a part of the table: one text cell that ends with a colon or begins with "раздел"."""
    return let(_said(cells), lambda said: (F.size(said) == 1) & _heads_section(F.get(said, F.lit(0))))


def _said(cells: Column) -> Column:
    """The cells that aren't blank."""
    return F.filter(cells, lambda c: F.trim(c) != "")


def _heads_section(only: Column) -> Column:
    return F.coalesce(F.trim(only).endswith(":") | lower_e(only).startswith("раздел"), F.lit(False))


def _squeezed(cells: Column) -> Column:
    return F.transform(cells, _squeeze)


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(lower_e(c), r"[\s.,:;-]+", "")


def row_equals_header(cells: Column, titles: Column) -> Column:
    """C23. The header once more: all filled cells are their columns' captions."""
    return _equals_header(cells, _squeezed(titles))


def _equals_header(cells: Column, squeezed: Column) -> Column:
    """The same with the captions as _squeezed leaves them, which a table's rows share. Cells behind the first
    other one are not looked at."""
    same = lambda x: let(_squeeze(x["cell"]), lambda a: (a == "") | (a == x["title"]))
    pairs = F.zip_with(cells, squeezed, lambda a, b: F.struct(a.alias("cell"), b.alias("title")))
    equal = (filled(cells) >= 2) & F.forall(pairs, lambda x: F.coalesce(same(x), F.lit(False)))
    begins = let(_squeeze(F.get(cells, F.lit(0))), lambda a: (a == "") | (a == F.get(squeezed, F.lit(0))))
    return F.when(cells.isNull() | squeezed.isNull() | begins, equal).otherwise(False)  # pairs are made only where the first cells agree


def plausible_row(cells: Column) -> Column:
    """C23. Letters in one cell and a number in another."""
    return F.exists(cells, lambda c: c.rlike(r"\p{L}{2}")) & F.exists(cells, lambda c: cents(c).isNotNull())


def is_total_row(cells: Column) -> Column:
    """The first filled cell begins with a total's word, or is a damaged one."""
    named = lambda first: let(lower_e(first), lambda low: starts(low, TOTAL_WORDS)) | garbled_total_word(first)
    return F.coalesce(let(F.trim(F.get(_said(cells), F.lit(0))), named), F.lit(False))


def _append(rows: Column, row: Column) -> Column:
    return F.concat(rows, F.array(row))


def append_wrapped_names(rows: Column, name_col: Column) -> Column:
    """W21. A row with a text cell only joins the name of the position before; fragments before the
    first position join it."""

    def add(acc: Column, r: Column) -> Column:
        return let(let(_said(r), lambda said: F.struct(F.get(said, F.lit(0)).alias("text"), alone(said).alias("fragment"))), lambda x: put(acc, r, x["text"], x["fragment"]))

    def alone(said: Column) -> Column:
        return (F.size(said) == 1) & cents(F.get(said, F.lit(0))).isNull() & ~_heads_section(F.get(said, F.lit(0)))

    def put(acc: Column, r: Column, text: Column, fragment: Column) -> Column:
        join = lambda old, new: F.trim(F.concat_ws(" ", old, new))
        named = lambda row, value: F.transform(row, lambda c, i: F.when(i == name_col, value(c)).otherwise(c))
        last = F.element_at(acc["rows"], -1)
        grown = F.concat(F.slice(acc["rows"], F.lit(1), F.greatest(F.size(acc["rows"]) - 1, F.lit(0))), F.array(named(last, lambda c: join(c, text))))
        first = named(r, lambda c: F.when(acc["lead"] == "", c).otherwise(join(acc["lead"], c)))
        waits = fragment & (F.size(acc["rows"]) == 0)
        return F.struct(
            F.when(waits, acc["rows"]).when(fragment, grown).otherwise(_append(acc["rows"], first)).alias("rows"),
            F.when(waits, join(acc["lead"], text)).when(fragment, acc["lead"]).otherwise(F.lit("")).alias("lead"),
        )

    return F.aggregate(rows, F.struct(F.array().cast(ROWS).alias("rows"), F.lit("").alias("lead")), add)["rows"]


def layout_cells(line: Column) -> Column:
    """Cells of a layout line: between bars, else between two blanks or more."""
    return F.transform(F.split(F.trim(line), F.when(line.contains("|"), F.lit(r"\s*\|\s*")).otherwise(F.lit(r"\s{2,}"))), lambda c: F.trim(c))


def _known_roles(cells: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.transform(cells, column_role), lambda r: ~r.isin("other", "index"))))


def _fit_right(cells: Column, n: Column) -> Column:
    """The first cell, then the others under the last columns; too many leading cells are one name."""
    k = F.size(cells)
    short = F.concat(F.slice(cells, F.lit(1), F.lit(1)), F.array_repeat(F.lit(""), F.greatest(n - k, F.lit(0))), F.slice(cells, F.lit(2), F.greatest(k - 1, F.lit(0))))
    long = F.concat(F.array(F.array_join(F.slice(cells, F.lit(1), F.greatest(k - n + 1, F.lit(1))), " ")), F.slice(cells, F.greatest(k - n + 2, F.lit(1)), F.greatest(n - 1, F.lit(0))))
    return F.when(k < n, short).when(k > n, long).otherwise(cells)


def _fit_left(cells: Column, n: Column) -> Column:
    """Blank cells at the end; too many cells join the last."""
    k = F.size(cells)
    long = F.concat(F.slice(cells, F.lit(1), n - 1), F.array(F.array_join(F.slice(cells, n, F.greatest(k - n + 1, F.lit(1))), " ")))
    return F.when(k <= n, F.concat(cells, F.array_repeat(F.lit(""), F.greatest(n - k, F.lit(0))))).otherwise(long)


def _from_layout(docs: DataFrame, source: str, least_cells: int, fit) -> DataFrame:
    lines = F.filter(F.transform(F.split("layout", "\n"), layout_cells), lambda c: filled(c) > 0)
    rows = settle(docs.select("doc_id", "layout"), lines=lines).drop("layout")
    head = first_where(F.col("lines"), lambda c: (F.size(c) >= least_cells) & (_known_roles(c) >= 2))
    rows = settle(rows, head=head).where("head > 0")
    rest = F.slice("lines", F.col("head") + 1, F.greatest(F.size("lines") - F.col("head"), F.lit(0)))
    rows = settle(rows, titles=F.get("lines", F.col("head") - 1), rest=rest)
    ends = lambda c: is_total_row(c) | let(lower_e(F.get(c, F.lit(0))), lambda low: starts(low, END_WORDS))
    rows = settle(rows, roles=assign_roles(F.col("titles")), squeezed=_squeezed(F.col("titles")), stop=first_where(F.col("rest"), ends))
    rows = settle(rows, stop=F.when(F.col("stop") > 0, F.col("stop") - 1).otherwise(F.size("rest")), n=F.size("titles"))
    body = F.filter(F.slice("rest", F.lit(1), F.col("stop")), lambda c: ~is_numbering_row(c) & ~_equals_header(c, F.col("squeezed")))
    tail = F.filter(F.slice("rest", F.col("stop") + 1, F.size("rest") - F.col("stop")), is_total_row)
    n = F.col("n")
    rows = settle(rows, rows=F.transform(body, lambda c: F.when(filled(c) == 1, c).otherwise(fit(c, n))), totals=F.transform(tail, lambda c: fit(c, n)), name=F.greatest(F.array_position("roles", "name").cast("int") - 1, F.lit(0)))
    rows = settle(rows, rows=append_wrapped_names(F.col("rows"), F.col("name"))).where(F.size("rows") > 0)
    return rows.select("doc_id", F.lit(source).alias("source"), "titles", "roles", "rows", "totals")


def table_from_layout(docs: DataFrame) -> DataFrame:
    """T2. docs: doc_id, layout (lines; cells between bars or wide blanks). The header has two known
    roles; cells of short rows stand under the last columns."""
    return _from_layout(docs, "layout", 2, _fit_right)


def free_table_from_layout(docs: DataFrame) -> DataFrame:
    """T3. The same with the columns as printed: three captions or more, short rows are filled up at
    the end, and what is too much joins the last cell."""
    return _from_layout(docs, "layout", 3, _fit_left)


def table_from_grid(grid_cells: DataFrame) -> DataFrame:
    """T5. grid_cells: doc_id, grid_no, row, col, header, text. Leading rows that are flagged or have two
    known roles are the header; grids under 15 percent filled or without numbers are left out."""
    cell = F.struct("col", F.coalesce(F.trim("text"), F.lit("")).alias("text"))
    rows = grid_cells.groupBy("doc_id", "grid_no", "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.max("col").alias("last"), F.max(F.coalesce("header", F.lit(False))).alias("flagged"))
    grids = rows.groupBy("doc_id", "grid_no").agg(F.array_sort(F.collect_list(F.struct("row", "flagged", "cells"))).alias("found"), F.max("last").alias("last"))
    at = lambda cells, k: F.coalesce(F.get(F.filter(cells, lambda c: c["col"] == k), F.lit(0))["text"], F.lit(""))
    in_place = lambda cells: (F.size(cells) == F.col("last") + 1) & F.forall(F.transform(cells, lambda c, k: c["col"] == k), lambda x: x)
    placed = lambda cells: F.when(in_place(cells), F.transform(cells, lambda c: c["text"])).otherwise(F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: at(cells, k)))
    dense = F.transform("found", lambda r: F.struct(r["flagged"].alias("flagged"), placed(r["cells"]).alias("cells")))
    grids = settle(grids, found=dense)
    is_head = lambda r: r["flagged"] | (~F.exists(r["cells"], lambda c: cents(c).isNotNull()) & (_known_roles(r["cells"]) >= 2))
    grids = settle(grids, heads=first_where(F.col("found"), lambda r: ~is_head(r)))
    grids = settle(grids, heads=F.when(F.col("heads") > 0, F.col("heads") - 1).otherwise(F.size("found"))).where("heads > 0")
    titles = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.array_join(F.filter(F.transform(F.slice("found", F.lit(1), F.col("heads")), lambda r: F.get(r["cells"], k)), lambda c: c != ""), " "))
    body = F.transform(F.slice("found", F.col("heads") + 1, F.greatest(F.size("found") - F.col("heads"), F.lit(0))), lambda r: r["cells"])
    grids = settle(grids, titles=titles, body=F.transform(body, lambda c: F.struct(c.alias("cells"), is_total_row(c).alias("total"))))
    grids = settle(grids, roles=assign_roles(F.col("titles")), squeezed=_squeezed(F.col("titles")))
    real = F.filter("body", lambda x: ~x["total"] & (filled(x["cells"]) > 0) & ~is_numbering_row(x["cells"]) & ~_equals_header(x["cells"], F.col("squeezed")))
    out = settle(grids, rows=F.transform(real, lambda x: x["cells"]), totals=F.transform(F.filter("body", lambda x: x["total"]), lambda x: x["cells"]))
    cells = F.flatten("rows")
    out = out.where((filled(cells) >= F.size(cells) * 0.15) & F.exists(cells, lambda c: cents(c).isNotNull()))
    return out.select("doc_id", F.lit("grid").alias("source"), "titles", "roles", "rows", "totals")


def cells_long(tables: DataFrame) -> DataFrame:
    """doc_id, source, row_no, col_no, title, role, value, is_total of all cells."""
    rows = F.concat(F.transform("rows", lambda r: F.struct(F.lit(False).alias("is_total"), r.alias("cells"))), F.transform("totals", lambda r: F.struct(F.lit(True).alias("is_total"), r.alias("cells"))))
    rows = tables.select("doc_id", "source", "titles", "roles", F.posexplode(rows).alias("row_no", "r"))
    rows = rows.select("doc_id", "source", "row_no", "r.is_total", "titles", "roles", F.posexplode("r.cells").alias("col_no", "value"))
    return rows.select("doc_id", "source", "row_no", "col_no", F.get("titles", F.col("col_no")).alias("title"), F.get("roles", F.col("col_no")).alias("role"), "value", "is_total")


AMOUNT = "array<struct<title:string,value:string>>"


def assign_amounts(amounts: Column, vat: Column) -> Column:
    """T11. struct<amount, amount_no_vat> from the filled amount cells (title, value) of a row: the total
    stands under a caption with VAT, else last; the amount without VAT under its caption, else it is
    the one that with VAT gives the total, else the first other."""
    return _assigned(amounts, vat, lambda a: title_with_vat(a["title"]), lambda a: title_without_vat(a["title"]))


def _assigned(amounts: Column, vat: Column, taxed, untaxed) -> Column:
    """The same with tests of an amount's caption."""
    n = F.size(amounts)
    by = lambda test: F.get(F.filter(amounts, test), F.lit(0))["value"]
    total = F.coalesce(by(taxed), F.when(n > 0, F.element_at(amounts, -1)["value"]))

    def rest(t: Column) -> Column:
        others = F.filter(amounts, lambda a: a["value"] != t)
        sums = F.get(F.filter(others, lambda a: F.abs(cents(a["value"]) + cents(vat) - cents(t)) <= 2), F.lit(0))["value"]
        return F.struct(t.alias("amount"), F.coalesce(by(untaxed), sums, F.get(others, F.lit(0))["value"], F.lit("")).alias("amount_no_vat"))

    return let(F.coalesce(total, F.lit("")), rest)


def _places() -> Column:
    """A table's columns by role, and whether its captions name an amount with or without VAT: its rows share them."""
    at = lambda role: F.filter(F.transform("roles", lambda r, i: F.when(r == role, i)), lambda i: i.isNotNull())
    said = lambda test: F.transform("titles", test)
    return F.struct(*(at(r).alias(r) for r in (*STANDARD, "vat_rate")), said(title_with_vat).alias("taxed"), said(title_without_vat).alias("untaxed"))


def _line(row: Column, places: Column) -> Column:
    """A row's cells as a line item."""
    values = lambda role: F.filter(F.transform(places[role], lambda i: F.trim(F.get(row, i))), lambda v: v != "")
    one = lambda role: F.coalesce(F.get(values(role), F.lit(0)), F.lit(""))
    amounts = F.filter(F.transform(places["amount"], lambda i: F.struct(i.alias("at"), F.trim(F.get(row, i)).alias("value"))), lambda a: a["value"] != "")

    def item(x: Column) -> Column:
        return let(
            _assigned(x["amounts"], x["vat"], lambda a: F.get(places["taxed"], a["at"]), lambda a: F.get(places["untaxed"], a["at"])),
            lambda a: F.struct(
                F.array_join(values("name"), " ").alias("name"),
                one("qty").alias("qty"), one("unit").alias("unit"), one("price").alias("price"), a["amount"].alias("amount"), a["amount_no_vat"].alias("amount_no_vat"),
                F.when(x["vat"] != "", x["vat"]).otherwise(one("vat_rate")).alias("vat"),
            ),
        )

    return let(F.struct(amounts.alias("amounts"), one("vat").alias("vat")), item)


def _items(tables: DataFrame, **facts: Column) -> DataFrame:
    """The tables with their rows as line items, and these facts of them."""
    return settle(settle(tables, places=_places(), **facts), items=F.transform("rows", lambda r: _line(r, F.col("places")))).drop("places")


def _named(items: str) -> Column:
    """Items with a name and some number: the others are none."""
    return F.filter(items, lambda x: (x["name"] != "") & ((x["amount"] != "") | (x["price"] != "") | (x["qty"] != "")))


def lines_from_cells(tables: DataFrame, *facts: Column) -> DataFrame:
    """T10. doc_id, source, line_no, name, qty, unit, price, amount, amount_no_vat, vat; facts of the table behind them."""
    kept = {f"_{k}": f for k, f in enumerate(facts)}
    rows = _items(tables, **kept).select("doc_id", "source", *kept, F.posexplode(_named("items")).alias("pos", "x"))
    return rows.select("doc_id", "source", (F.col("pos") + 1).alias("line_no"), "x.*", *kept)


STANDARD = ("name", "qty", "unit", "price", "amount", "vat")


def cells_from_lines(lines: DataFrame, titles: dict[str, str]) -> DataFrame:
    """T12. Lines as cells of the standard six columns: doc_id, row_no, col_no, title, role, value."""
    cell = lambda k, role: F.struct(F.lit(k).alias("col_no"), F.lit(titles[role]).alias("title"), F.lit(role).alias("role"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("value"))
    return lines.select("doc_id", (F.col("line_no") - 1).cast("int").alias("row_no"), F.explode(F.array(*(cell(k, r) for k, r in enumerate(STANDARD)))).alias("c")).select("doc_id", "row_no", "c.*")


def table_struct(cells: DataFrame) -> DataFrame:
    """T13. Tables from their cells: doc_id, source, titles, roles, rows, totals."""
    row = cells.groupBy("doc_id", "source", "row_no").agg(F.max("is_total").alias("is_total"), F.array_sort(F.collect_list(F.struct("col_no", "title", "role", "value"))).alias("c"))
    rows = row.groupBy("doc_id", "source").agg(F.array_sort(F.collect_list(F.struct("row_no", "is_total", "c"))).alias("r"))
    widest = F.element_at(F.array_sort(F.transform("r", lambda r: F.struct(F.size(r["c"]).alias("n"), r["c"].alias("c")))), -1)["c"]
    values = lambda total: F.transform(F.filter("r", lambda r: r["is_total"] == total), lambda r: F.transform(r["c"], lambda c: c["value"]))
    return rows.select("doc_id", "source", F.transform(widest, lambda c: c["title"]).alias("titles"), F.transform(widest, lambda c: c["role"]).alias("roles"), values(False).alias("rows"), values(True).alias("totals"))


def absorb_header_rows(tables: DataFrame) -> DataFrame:
    """W23. Leading rows with two known captions or more and no number go to the titles."""
    first = first_where(F.col("rows"), lambda r: F.exists(r, lambda c: cents(c).isNotNull()) | (_known_roles(r) < 2))
    rows = settle(tables, k=let(first, lambda k: F.when(k > 0, k - 1).otherwise(F.size("rows"))))
    below = lambda i: F.transform(F.slice("rows", F.lit(1), F.col("k")), lambda r: F.get(r, i))
    titles = F.transform("titles", lambda t, i: F.array_join(F.filter(F.concat(F.array(t), below(i)), lambda c: F.coalesce(F.trim(c), F.lit("")) != ""), " "))
    named = let(titles, lambda t: F.struct(t.alias("titles"), assign_roles(t).alias("roles")))
    taken = F.col("k") > 0
    rows = settle(rows, named=F.when(taken, named).otherwise(F.struct("titles", "roles")), rows=F.when(taken, F.slice("rows", F.col("k") + 1, F.greatest(F.size("rows") - F.col("k"), F.lit(0)))).otherwise(F.col("rows")))
    return rows.withColumns({c: F.col(f"named.{c}") for c in ("titles", "roles")}).select(*tables.columns)


def take_hidden_totals(tables: DataFrame) -> DataFrame:
    """W24. A last row without a real name whose amount and one more column equal the sums of the rows
    before (within 2 cents and one for each row) goes to the totals."""
    name = lambda last: F.coalesce(F.trim(F.get(last, F.array_position("roles", "name").cast("int") - 1)), F.lit(""))
    nameless = (F.size("rows") >= 3) & let(name(F.element_at("rows", -1)), lambda n: ~n.rlike(r"\p{L}{3}") | garbled_total_word(n))
    split = settle(tables, nameless=F.coalesce(nameless, F.lit(False)))
    last, before = F.element_at("rows", -1), F.slice("rows", F.lit(1), F.greatest(F.size("rows") - 1, F.lit(0)))
    money = F.transform("roles", lambda r, i: F.struct(r.alias("role"), cents(F.get(last, i)).alias("v"), F.aggregate(before, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(cents(F.get(x, i)), F.lit(0))).alias("s")))
    split = settle(split, money=F.when(F.col("nameless"), money))  # few tables' columns are added up
    equal = F.filter("money", lambda m: (m["v"] > 0) & (F.abs(m["v"] - m["s"]) <= 2 + F.size("rows")))
    hidden = F.col("nameless") & (F.size(equal) >= 2) & F.exists(equal, lambda m: m["role"] == "amount")
    rows = settle(split, hidden=F.coalesce(hidden, F.lit(False)))
    rows = settle(rows, totals=F.when(F.col("hidden"), F.concat("totals", F.array(last))).otherwise(F.col("totals")), rows=F.when(F.col("hidden"), before).otherwise(F.col("rows")))
    return rows.select(*tables.columns)


def fix_name_column(tables: DataFrame) -> DataFrame:
    """W28. Among the columns without a role (or other) the one with most texts, cells of four characters or more
    with letters that are no number, becomes the name if it has over one and a half times as many as the
    present name's column (the first, if there is none) and as many as half of the rows; of equal ones the
    first. The former name's column becomes other, or index if it has no texts at all."""
    text = lambda c: (F.length(F.trim(c)) >= 4) & c.rlike(r"\p{L}")
    count = lambda i: F.size(F.filter("rows", lambda x: text(F.coalesce(F.get(x, i), F.lit("")))))
    own = F.greatest(F.array_position("roles", "name").cast("int") - 1, F.lit(0))
    rows = settle(tables, own=own, open=F.transform("roles", lambda r, i: F.coalesce(r, F.lit("")).isin("", "other") & (i != own)))
    rows = settle(rows, texts=F.when(F.exists("open", lambda o: o), F.transform("open", lambda o, i: F.when(o | (i == F.col("own")), count(i)).otherwise(0))))
    free = F.zip_with("texts", "open", lambda n, o: F.when(o, n).otherwise(-1))
    rows = settle(settle(rows, free=free), best=F.array_position("free", F.array_max("free")).cast("int") - 1)
    n, have = F.get("free", F.col("best")), F.get("texts", F.col("own"))
    better = F.coalesce((n * 2 > have * 3) & (n * 2 >= F.size("rows")) & (n > 0), F.lit(False))
    former = lambda r: F.when(r != "name", r).when(have > 0, "other").otherwise("index")
    roles = F.transform("roles", lambda r, i: F.when(i == F.col("best"), F.lit("name")).when(i == F.col("own"), former(r)).otherwise(r))
    return settle(rows, roles=F.when(better, roles).otherwise(F.col("roles"))).select(*tables.columns)


def clean_table(tables: DataFrame) -> DataFrame:
    """T7. Cells cleaned; empty, numbering and repeated header rows dropped; totals moved out; header rows
    absorbed; positions on several lines merged; the name's column fixed; equal rows once; empty columns
    removed; under two columns: none."""
    from .positions import merge_multiline_rows

    cleaned = lambda rows: F.transform(rows, lambda r: F.transform(r, lambda c: clean_cell(F.coalesce(c, F.lit("")))))
    rows = absorb_header_rows(settle(tables, rows=cleaned(F.col("rows")), totals=cleaned(F.col("totals"))))
    rows = settle(rows, squeezed=_squeezed(F.col("titles")))
    real = F.filter("rows", lambda r: (filled(r) > 0) & ~is_numbering_row(r) & ~_equals_header(r, F.col("squeezed")))
    rows = settle(rows, rows=F.transform(real, lambda r: F.struct(r.alias("cells"), is_total_row(r).alias("total")))).drop("squeezed")
    part = lambda total: F.transform(F.filter("rows", lambda x: x["total"] == total), lambda x: x["cells"])
    rows = settle(rows, totals=F.concat(part(True), "totals"), rows=part(False))
    rows = merge_multiline_rows(rows)
    rows = take_hidden_totals(fix_name_column(settle(rows, rows=F.array_distinct("rows"))))
    used = F.filter(F.sequence(F.lit(0), F.size("titles") - 1), lambda i: F.exists("rows", lambda r: F.coalesce(F.trim(F.get(r, i)), F.lit("")) != ""))
    rows = settle(rows, used=used)
    whole = lambda cells: (F.size("used") == F.size("titles")) & (F.size(cells) == F.size("titles"))
    only = lambda cells: F.when(whole(cells), cells).otherwise(F.transform("used", lambda i: F.get(cells, i)))
    rows = settle(rows, titles=only(F.col("titles")), roles=only(F.col("roles")), rows=F.transform("rows", only), totals=F.transform("totals", only))
    return rows.where((F.size("used") >= 2) & (F.size("rows") > 0)).select(*tables.columns)


#: Columns that take no part in sums.
NO_SUMS = ("qty", "price", "vat_rate", "index", "unit")


def infer_roles_by_arithmetic(cells: DataFrame) -> DataFrame:
    """A21. doc_id, source, net_col, vat_col, total_col: columns a < b and another, c, with a + b = c to half a
    cent. cells: doc_id, source, row_no, col_no, role, value, is_total.

    The name's column (the first, if none has that role), quantities, prices, rates, units and indexes take
    no part. Rows count if all three are positive and c is printed with two decimals, and 60 percent of them
    must agree; most rows, then the rightmost c, then the leftmost a and b. Of these the one with the larger
    sum over the rows that have both is without VAT. Tables whose present roles (first and last amount, VAT)
    agree in over half of the rows with a total are left alone.
    """
    table = Window.partitionBy("doc_id", "source")
    role, body = F.coalesce("role", F.lit("")), ~F.col("is_total")
    cell = F.struct("col_no", cents(F.col("value")).alias("v"), F.trim("value").rlike("[.,][0-9]{2}$").alias("money"), (~role.isin(*NO_SUMS)).alias("open"))
    known = cells.where("doc_id is not null and source is not null").select("doc_id", "source", "row_no", "col_no", role.alias("role"), body.alias("body"), F.when(body, cell).alias("cell"))
    first = lambda f, r: f(F.when(F.col("role") == r, F.col("col_no")))
    rows = known.groupBy("doc_id", "source", "row_no").agg(F.array_sort(F.collect_list("cell")).alias("c"), first(F.min, "name").alias("name_col"), first(F.min, "amount").alias("net_col"), first(F.min, "vat").alias("vat_col"), first(F.max, "amount").alias("total_col"))
    facts = {k: (F.max if k == "total_col" else F.min)(k).over(table) for k in ("name_col", "net_col", "vat_col", "total_col")}
    rows = rows.withColumns(facts | {"name_col": F.coalesce(facts["name_col"], F.lit(0))})
    at = lambda k: F.array_max(F.transform(F.filter("c", lambda x: x["col_no"] == F.col(k)), lambda x: x["v"]))
    present = (F.col("net_col") < F.col("total_col")) & F.col("vat_col").isNotNull()
    rows = rows.withColumns({"sums": F.when(present, F.struct(at("net_col").alias("net"), at("vat_col").alias("vat"), at("total_col").alias("total")))})
    agree = F.abs(F.col("sums.net") + F.col("sums.vat") - F.col("sums.total")) <= 2
    rows = rows.withColumn("fine", F.count(F.when(agree, 1)).over(table) * 2 > F.count("sums.total").over(table)).where("not fine")
    rows = rows.select("doc_id", "source", F.filter("c", lambda x: x["open"] & x["v"].isNotNull() & (x["col_no"] != F.col("name_col"))).alias("c")).where(F.size("c") >= 3)
    rows = rows.select("doc_id", "source", "c", F.explode("c").alias("a")).select("doc_id", "source", "a", "c", F.explode("c").alias("b")).where("b.col_no > a.col_no")
    rows = rows.select("doc_id", "source", "a", "b", F.explode("c").alias("t")).where("t.col_no <> a.col_no and t.col_no <> b.col_no")
    counts = (F.least("a.v", "b.v", "t.v") > 0) & F.col("t.money")
    ok = counts & (F.col("a.v") + F.col("b.v") == F.col("t.v"))
    triples = rows.groupBy("doc_id", "source", F.col("a.col_no").alias("a"), F.col("b.col_no").alias("b"), F.col("t.col_no").alias("t")).agg(F.count(F.when(ok, 1)).alias("ok"), F.count(F.when(counts, 1)).alias("n"), F.sum("a.v").alias("sa"), F.sum("b.v").alias("sb"))
    best = triples.where("ok > 0 and ok * 5 >= n * 3").groupBy("doc_id", "source").agg(F.max_by(F.struct("a", "b", "t", "sa", "sb"), F.struct("ok", "t", -F.col("a"), -F.col("b"))).alias("x"))
    larger = F.col("x.sa") >= F.col("x.sb")
    return best.select("doc_id", "source", F.when(larger, F.col("x.a")).otherwise(F.col("x.b")).alias("net_col"), F.when(larger, F.col("x.b")).otherwise(F.col("x.a")).alias("vat_col"), F.col("x.t").alias("total_col"))


def roles_reconcile(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """A22. doc_id, source, ok, n: rows whose amount without VAT and VAT give the total within 2 cents, of the rows with a total."""
    at = lambda c: F.max(F.when(F.col("col_no") == F.col(c), cents(F.col("value"))))
    rows = cells.where("not is_total").join(roles, ["doc_id", "source"]).groupBy("doc_id", "source", "row_no").agg(at("net_col").alias("net"), at("vat_col").alias("vat"), at("total_col").alias("total"))
    return rows.groupBy("doc_id", "source").agg(F.count(F.when(F.abs(F.col("net") + F.col("vat") - F.col("total")) <= 2, 1)).alias("ok"), F.count("total").alias("n"))


def score_tables(tables: DataFrame) -> DataFrame:
    """A15. tables with score (0 to 1) and diagnostics (n_rows, n_cols, n_lines, good, products, product_rows, hit)."""
    rows = _items(tables)
    money = F.transform(_named("items"), lambda x: F.struct(*(cents(x[k]).alias(k) for k in ("qty", "price", "amount", "amount_no_vat", "vat")), x["name"].alias("name")))
    rows = settle(rows, m=money).drop("items")
    cells, n, n_cols = F.flatten("rows"), F.size("rows"), F.size("titles")
    part = lambda hit, of: F.when(of > 0, hit / of).otherwise(F.lit(0.0))
    count = lambda test: F.size(F.filter("m", test))
    base = lambda x: F.coalesce(x["amount_no_vat"], x["amount"])
    mul = lambda x: (x["qty"] > 0) & (x["price"] > 0) & (base(x) > 0)
    product = lambda x: mul(x) & (F.abs(x["qty"] * x["price"] / 100 - base(x)) <= F.greatest(F.lit(5.0), base(x) * 0.02))
    taxed = lambda x: x["amount_no_vat"].isNotNull() & x["vat"].isNotNull() & x["amount"].isNotNull()
    agrees = lambda x: taxed(x) & (F.abs(x["amount_no_vat"] + x["vat"] - x["amount"]) <= 2)
    total = F.array_max(F.transform(F.flatten("totals"), cents))
    near = lambda k: F.abs(F.aggregate("m", F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x[k], F.lit(0))) - total) <= F.greatest(F.lit(5.0), total * 0.02)
    rows = settle(rows, **{
        "fill": part(filled(cells), F.size(cells)), "n_lines": F.size("m"), "good": count(lambda x: x["name"].rlike(r"\p{L}") & (F.length(F.trim(x["name"])) >= 3)),
        "product_rows": count(mul), "products": count(product), "vat_rows": count(taxed), "vats": count(agrees),
        "hit": F.coalesce((total > 0) & (near("amount") | near("amount_no_vat")), F.lit(False)), "dups": n - F.size(F.array_distinct(F.transform("rows", lambda r: F.lower(F.concat_ws("\x01", r))))),
    })
    has = lambda *r: F.exists("roles", lambda x: x.isin(*r)).cast("int")
    score = F.lit(0.15) + F.least(F.col("fill") / 0.5, F.lit(1.0)) * 0.10 + has("name") * 0.10 + has("amount") * 0.10 + has("qty", "price", "unit") * 0.05
    score = score + part(F.col("good"), F.col("n_lines")) * 0.15 + part(F.col("products"), F.col("product_rows")) * 0.20 + part(F.col("vats"), F.col("vat_rows")) * 0.10
    score = score + F.col("hit").cast("int") * 0.15 - part(F.col("dups"), n) * 0.20 - (n_cols > 16).cast("int") * 0.05 - (F.col("n_lines") == 0).cast("int") * 0.15
    score = F.when((n == 0) | (n_cols < 2), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    facts = F.struct(n.alias("n_rows"), n_cols.alias("n_cols"), "n_lines", "good", "products", "product_rows", "hit")
    return rows.select(*tables.columns, F.round(score, 6).alias("score"), facts.alias("diagnostics"))


def table_candidates(*tables: DataFrame) -> DataFrame:
    """U1. Candidate tables of all sources, with their order."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (t.select("doc_id", "source", "titles", "roles", "rows", "totals").withColumn("ordinal", F.lit(k)) for k, t in enumerate(tables)))


#: What a source adds to its tables' score.
SOURCE_BONUS = {"grid": 0.03, "columns": 0.02, "layout": 0.01}


def pick_best_table(candidates: DataFrame, forced: str | None = None) -> DataFrame:
    """W25. Of each document's cleaned candidates the one with the highest score and bonus; the first of equal ones."""
    rows = score_tables(clean_table(candidates))
    bonus = F.coalesce(*(F.when(F.col("source") == s, F.lit(b)) for s, b in SOURCE_BONUS.items()), F.lit(0.0)) + (F.when(F.col("source") == forced, 0.5).otherwise(0.0) if forced else F.lit(0.0))
    best = rows.groupBy("doc_id").agg(F.max_by(F.struct("source", "titles", "roles", "rows", "totals", "score"), F.struct(F.round(F.col("score") + bonus, 6).alias("s"), (-F.col("ordinal")).alias("first"))).alias("x"))
    return best.select("doc_id", "x.*")


def table_suspicious(tables: DataFrame, totals: DataFrame) -> DataFrame:
    """F14. doc_id, suspicious: under two columns, no rows, under a fifth filled, a repeated row, no lines,
    or lines that don't sum to the total within a percent. totals: doc_id, total (cents)."""
    cells, rows = F.flatten("rows"), F.col("rows")
    found = settle(_items(tables), items=_named("items")).select("doc_id", "items", "titles", "rows").join(totals, "doc_id", "left")
    amounts = F.transform("items", lambda x: cents(x["amount"]))
    known = F.filter(amounts, lambda a: a.isNotNull())
    off = (F.col("total") > 0) & ((F.size(known) < F.size(amounts)) | (F.abs(F.aggregate(known, F.lit(0).cast("bigint"), lambda acc, a: acc + a) - F.col("total")) * 100 > F.col("total")))
    bad = (F.size("titles") < 2) | (F.size(rows) == 0) | (filled(cells) * 5 < F.size(cells)) | (F.size(F.array_distinct(rows)) < F.size(rows)) | (F.size("items") == 0) | off
    return found.select("doc_id", F.coalesce(bad, F.lit(False)).alias("suspicious"))
