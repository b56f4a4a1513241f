"""Names of companies and their numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, looks_like_account_number, lower_e

#: Legal forms written out and their short forms.
LONG_FORMS = {
    "общество с дополнительной ответственностью": "ОДО",
    "общество с ограниченной ответственностью": "ООО",
    "совместное общество с ограниченной ответственностью": "СООО",
    "иностранное общество с ограниченной ответственностью": "ИООО",
    "открытое акционерное общество": "ОАО",
    "закрытое акционерное общество": "ЗАО",
    "публичное акционерное общество": "ПАО",
    "акционерное общество": "АО",
    "частное производственное унитарное предприятие": "ЧПУП",
    "частное торговое унитарное предприятие": "ЧТУП",
    "частное унитарное предприятие": "ЧУП",
    "коммунальное унитарное предприятие": "КУП",
    "коммунальное производственное унитарное предприятие": "КПУП",
    "республиканское унитарное предприятие": "РУП",
    "иностранное унитарное предприятие": "ИУП",
    "производственное унитарное предприятие": "ПУП",
    "унитарное предприятие": "УП",
    "учреждение здравоохранения": "УЗ",
    "государственное учреждение образования": "ГУО",
    "государственное учреждение": "ГУ",
    "индивидуальный предприниматель": "ИП",
}
_LONG = sorted(LONG_FORMS, key=lambda f: (-len(f.encode()), list(LONG_FORMS).index(f)))
_SHORT = sorted({s.lower() for s in LONG_FORMS.values()})
_MARKS = "«»\"'„“”.,"


def _flat(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def party(name: Column) -> Column:
    """struct<form, core, key>: short legal form (of the longest written-out one, else the first short
    one, else blank), the name without it and without quotes, and the core's letters and digits in
    lower case with ё as е."""
    written = lambda long: F.coalesce(*(F.when(long == f, F.lit(s)) for f, s in LONG_FORMS.items()))

    def split(flat: Column) -> Column:
        return let(F.struct(flat.alias("flat"), lower_e(flat).alias("low")), find)

    def find(v: Column) -> Column:
        return let(F.struct(v["flat"].alias("flat"), v["low"].alias("low"), F.coalesce(*(F.when(v["low"].contains(f), F.lit(f)) for f in _LONG)).alias("long")), cut)

    def cut(v: Column) -> Column:
        at = F.position(v["long"], v["low"])
        rest = F.when(v["long"].isNull(), v["flat"]).otherwise(F.concat(F.substring(v["flat"], F.lit(1), at - 1), F.lit(" "), F.substring(v["flat"], at + F.length(v["long"]), F.length(v["flat"]))))
        words = F.transform(F.filter(F.split(F.trim(rest), " +"), lambda w: w != ""), lambda w: F.struct(w.alias("word"), F.regexp_replace(F.lower(w), f"^[{_MARKS}]+|[{_MARKS}]+$", "").alias("bare")))
        return let(F.struct(words.alias("words"), written(v["long"]).alias("form")), choose)

    def choose(v: Column) -> Column:
        short = F.upper(F.get(F.filter(v["words"], lambda w: w["bare"].isin(*_SHORT)), F.lit(0))["bare"])
        return let(F.struct(v["words"].alias("words"), F.coalesce(v["form"], short, F.lit("")).alias("form")), core)

    def core(v: Column) -> Column:
        kept = F.transform(F.filter(v["words"], lambda w: w["bare"] != F.lower(v["form"])), lambda w: w["word"])
        trimmed = F.regexp_replace(F.array_join(kept, " "), f"^[ {_MARKS}]+|[ {_MARKS}]+$", "")
        return let(F.struct(v["form"].alias("form"), _flat(F.translate(trimmed, "«»\"„“”", "")).alias("core")), key)

    def key(v: Column) -> Column:
        return F.struct(v["form"].alias("form"), v["core"].alias("core"), F.regexp_replace(lower_e(v["core"]), r"[^\p{L}\p{Nd}]", "").alias("key"))

    return let(_flat(name), split)


def party_form(name: Column) -> Column:
    """Short legal form; blank if none."""
    return party(name)["form"]


def party_core(name: Column) -> Column:
    """The name without its legal form and without quotes."""
    return party(name)["core"]


def party_key(name: Column) -> Column:
    """Letters and digits of the core, lower case, ё as е."""
    return party(name)["key"]


def same_key(a: Column, b: Column) -> Column:
    """Equal keys, or the shorter one has six characters or more and is part of the longer one."""

    def same(v: Column) -> Column:
        x, y = v["a"], v["b"]
        part = F.when(F.length(x) <= F.length(y), (F.length(x) >= 6) & y.contains(x)).otherwise((F.length(y) >= 6) & x.contains(y))
        return F.coalesce((x != "") & (y != "") & ((x == y) | part), F.lit(False))

    return let(F.struct(a.alias("a"), b.alias("b")), same)


def same_party(a: Column, b: Column) -> Column:
    return same_key(party_key(a), party_key(b))


def count_forms(name: Column) -> Column:
    """How many legal forms the name holds."""
    low = F.concat(F.lit(" "), lower_e(name), F.lit(" "))
    count = F.lit(0)
    for form in _LONG:
        count = count + F.size(F.split(low, form)) - 1
        low = F.replace(low, F.lit(form), F.lit(" "))
    return count + F.size(F.filter(F.split(low, r"[^\p{L}\p{Nd}]+"), lambda w: w.isin(*_SHORT)))


def split_entities(name: Column) -> Column:
    """Glued companies cut before each legal form; the whole name if it holds fewer than two."""
    forms = "|".join([*_LONG, *sorted(_SHORT, key=len, reverse=True)])
    cut = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?=[«\"'.]?(?:{forms})(?![\p{{L}}\p{{N}}]))"
    parts = F.transform(F.split(name, cut), lambda p: F.regexp_replace(p, "^[ ,;]+|[ ,;]+$", ""))
    return F.when(count_forms(name) < 2, F.array(F.trim(name))).otherwise(F.filter(parts, lambda p: p != ""))


def valid_tax_id(key: Column, value: Column) -> Column:
    """Digits only, and as many as the key asks for."""
    n = F.length(value)
    right = F.when(key.isin("unp", "organization_unp", "kpp"), n == 9).when(key.isin("inn", "organization_inn"), n.isin(10, 12)).otherwise(F.lit(False))
    return value.rlike("^[0-9]+$") & right


def format_valid(key: Column, value: Column) -> Column:
    """1 valid, -1 invalid, 0 unchecked."""
    is_date = value.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$") & F.substring(value, 7, 4).try_cast("int").between(1995, 2100)
    sign = lambda ok: F.when(ok, 1).otherwise(-1)
    return (
        F.when(key.isin("date", "contract_date"), sign(is_date))
        .when(key.isin("unp", "organization_unp", "inn", "organization_inn", "kpp"), sign(valid_tax_id(key, value)))
        .when(key == "currency", sign(F.upper(value).isin("BYN", "RUB", "USD", "EUR")))
        .when(key.isin("total", "amount_no_vat", "vat_amount"), sign(F.translate(value, " ", "").rlike(r"^[0-9]+([.,][0-9]{1,2})?$")))
        .when(key == "number", F.when(looks_like_account_number(value) | (F.length(value) > 25), -1).otherwise(0))
        .when(key.isin("counterparty", "organization"), F.when(F.length(value) < 3, -1).otherwise(0))
        .otherwise(0)
    )


def any_of(columns) -> Column:
    return reduce(lambda a, b: a | b, columns)
