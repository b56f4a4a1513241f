"""Numbers and sums of money. Sums are whole cents (bigint); texts that are no number give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import behind, even, let, lines_and_low

MONEY = r"^[+-]?[0-9]+([.,][0-9]{1,2})?$"
#: Sums as most are printed: their digits are the cents.
TWO_DECIMALS = r"^[0-9]{1,15}[.][0-9]{2}\z"
NUMERIC_CELL = "^-?[0-9]{1,3}(?:[  ]?[0-9]{3})*(?:[.,][0-9]{1,6})?\\s*%?$"

#: Letters that recognition puts for digits; blanks stay.
OCR_DIGITS = {
    "О": "0", "о": "0", "O": "0", "o": "0", "З": "3", "з": "3", "Б": "6", "б": "6",
    "l": "1", "I": "1", "|": "1", "і": "1", "S": "5", "s": "5",
}


def normalize_number(c: Column) -> Column:
    """Without % at the end and blanks, comma as dot; blank if two decimals stand in one cell, or one
    that isn't last."""

    def check(s: Column) -> Column:
        parts = F.filter(F.split(F.trim(s), r"\s+"), lambda x: x != "")
        return let(parts, lambda p: F.when((F.size(p) > 1) & bad(p), "").otherwise(F.translate(F.translate(s, " ", ""), ",", ".")))

    def bad(p: Column) -> Column:
        return let(F.size(F.filter(p, lambda x: x.rlike("[.,]"))), lambda n: (n > 1) | ((n == 1) & ~F.get(p, F.size(p) - 1).rlike("[.,]")))

    return let(F.regexp_replace(c, "%$", ""), check)


def tidy_number(c: Column) -> Column:
    """The last dot or comma is the decimal mark and others go; % at the end stays."""
    s = F.translate(F.trim(c), "  ", "")
    percent = F.when(s.endswith("%"), "%").otherwise("")
    s = F.regexp_replace(s, "%$", "")
    head, tail = F.regexp_extract(s, "^(.*)[.,]([^.,]*)$", 1), F.regexp_extract(s, "^(.*)[.,]([^.,]*)$", 2)
    return F.concat(F.when(s.rlike("[.,]"), F.concat(F.translate(head, ".,", ""), F.lit("."), tail)).otherwise(s), percent)


def is_numeric_cell(c: Column) -> Column:
    """A number or percentage: digits, those behind a blank in threes, and up to six decimals."""
    bare = F.regexp_replace(F.rtrim(F.regexp_replace(c, "%$", "")), "^-", "")
    parts = F.split(F.translate(bare, ",\u00a0", ". "), "[.]", -1)
    whole = lambda g, k: g.rlike("^[0-9]+$") & ((k == 0) | (F.length(g) % 3 == 0))
    groups = lambda p: F.forall(F.transform(F.split(F.get(p, F.lit(0)), " ", -1), whole), lambda x: x)
    return let(parts, lambda p: (F.size(p) <= 2) & groups(p) & F.coalesce(F.get(p, F.lit(1)).rlike("^[0-9]+$") & (F.length(F.get(p, F.lit(1))) <= 6), F.lit(True)))


def repair_numeric_cell(c: Column) -> Column:
    """Letters taken for digits are put right only if the cell is a number then."""
    t = F.trim(c)
    fixed = F.translate(t, "".join(OCR_DIGITS), "".join(OCR_DIGITS.values()))
    return F.when(is_numeric_cell(t), tidy_number(t)).when(t.rlike("[0-9]") & is_numeric_cell(fixed), tidy_number(fixed)).otherwise(t)


_WORD = "[^\\s|¦\u00a0\u0085\u2028\u2029]+"
#: A cell that is clean as it stands: blank, a plain number, or a text with single blanks and a
#: character that neither numbers nor letters taken for digits have.
CLEAN_CELL = f"^(?:[0-9]+(?:[.][0-9]{{1,6}})?|(?=.*[^0-9 .,%{''.join(OCR_DIGITS)}-]){_WORD}(?: {_WORD})*)?\\z"


def clean_cell(c: Column) -> Column:
    """Blanks put right, bars at the ends gone, numbers repaired."""
    one = F.trim(F.regexp_replace(F.translate(c, "\u00a0", " "), r"\s+", " "))
    return F.when(c.rlike(CLEAN_CELL), c).otherwise(repair_numeric_cell(F.regexp_replace(one, "^[ |¦]+|[ |¦]+$", "")))


def plain(c: Column) -> Column:
    return F.translate(F.trim(c), ",  ", ".")


def parse_money(c: Column) -> Column:
    """Decimal of a printed sum, null if it is none."""
    return plain(c).try_cast("decimal(18,4)")


def cents(c: Column) -> Column:
    """Cents of a printed sum with at most two decimals; null for anything else."""
    whole = F.when(plain(c).rlike(MONEY), F.round(plain(c).try_cast("decimal(18,2)") * 100).cast("bigint"))
    return F.when(c.rlike(TWO_DECIMALS), F.replace(c, F.lit("."), F.lit("")).cast("bigint")).when(c != "", whole)


def to_cents(amount: Column) -> Column:
    """Cents of a double with two decimals."""
    return F.round(amount * 100).cast("bigint")


def format_cents(c: Column) -> Column:
    """A sum with two decimals; null stays null."""
    sign = F.when(c < 0, "-").otherwise("")
    return F.when(c.isNotNull(), F.concat(sign, F.floor(F.abs(c) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((F.abs(c) % 100).cast("string"), 2, "0")))


def money_in_text(text: Column, amount: Column) -> Column:
    """Whether the sum (cents) is printed with a dot or a comma and isn't part of longer digits."""
    whole, rest = F.floor(F.abs(amount) / 100).cast("bigint").cast("string"), F.format_string("%02d", F.abs(amount) % 100)
    return F.regexp_like(text, F.concat(F.lit("(?<![0-9])"), whole, F.lit("[.,]"), rest, F.lit("(?![0-9])")))


def grounded_in_text(value: Column, text: Column) -> Column:
    """Whether the value's digits stand in the text in order, three other characters between two of
    them at most; under four digits always."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    pattern = F.array_join(F.filter(F.split(digits, ""), lambda x: x != ""), "[^0-9]{0,3}")
    return (F.length(digits) < 4) | F.regexp_like(text, pattern)


#: Russian numerals, scales, and words that may stand between.
UNITS = {
    "ноль": 0, "нуль": 0, "один": 1, "одна": 1, "два": 2, "две": 2, "три": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7, "восемь": 8, "девять": 9,
    "десять": 10, "одиннадцать": 11, "двенадцать": 12, "тринадцать": 13, "четырнадцать": 14, "пятнадцать": 15, "шестнадцать": 16, "семнадцать": 17,
    "восемнадцать": 18, "девятнадцать": 19, "двадцать": 20, "тридцать": 30, "сорок": 40, "пятьдесят": 50, "шестьдесят": 60, "семьдесят": 70,
    "восемьдесят": 80, "девяносто": 90, "сто": 100, "двести": 200, "триста": 300, "четыреста": 400, "пятьсот": 500, "шестьсот": 600, "семьсот": 700,
    "восемьсот": 800, "девятьсот": 900,
}
SCALES = {"тысяча": 1000, "тысячи": 1000, "тысяч": 1000, "тысячу": 1000, "миллион": 1000000, "миллиона": 1000000, "миллионов": 1000000}
SKIPPED = ("белорусских", "белорусский", "белорусские", "российских", "российский", "российские", "и")


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _number(words: Column) -> Column:
    """A number from an array of lower-case words; null when one is unknown or no numeral is there.

    Numerals add up to a triad: hundreds, then tens or a teen, then units. A scale word multiplies the triad
    before it (one, if there is none). Scales fall from left to right, and so do the numerals of a triad;
    words in another order are no number.
    """
    units, scales = _map(UNITS), _map(SCALES)
    said = F.filter(words, lambda w: (w != "") & ~w.isin(*SKIPPED))
    state = lambda total, triad, below, scale: F.struct(total.cast("bigint").alias("total"), triad.cast("bigint").alias("triad"), below.cast("bigint").alias("below"), scale.cast("bigint").alias("scale"))

    def step(s: Column, w: Column) -> Column:
        n, scale = F.try_element_at(units, w), F.try_element_at(scales, w)
        # what the next numeral of the triad must be less than; a teen takes the places of tens and units
        room = F.when(n >= 100, 100).when(n >= 20, 10).otherwise(1)
        needs = F.when(n.between(10, 19), 100).otherwise(room * 10)
        numeral = F.when(n.isNotNull() & (needs <= s["below"]), state(s["total"], s["triad"] + n, room, s["scale"]))
        closed = F.when(scale < s["scale"], state(s["total"] + F.when(s["below"] == 1000, 1).otherwise(s["triad"]) * scale, F.lit(0), F.lit(1000), scale))
        return F.coalesce(numeral, closed)

    whole = F.aggregate(said, state(F.lit(0), F.lit(0), F.lit(1000), F.lit(10**12)), step)
    return F.when(F.size(said) > 0, whole["total"] + whole["triad"])


def words_to_int(c: Column) -> Column:
    """A number in Russian words; null when a word is unknown or no numeral is there."""
    return _number(F.transform(F.split(F.lower(c), r"[\s-]+"), lambda w: F.regexp_replace(w, "^[.,:;()]+|[.,:;()]+$", "")))


def money_from_words(c: Column) -> Column:
    """Cents of the first sum written out in roubles and kopecks; null if there is none.

    A sum is said in one stretch of words, digits, blanks and commas: all its words up to "рубл..", behind
    the kopecks of a sum before, are a number, and those from there to the next "коп.." are one below a
    hundred, in words or digits. Other marks, and words in digits before the roubles, end a stretch.
    """
    low = F.regexp_replace(F.lower(c), r"(?<![а-яё])(рубл|коп)\S*", " $1 ")
    stretches = F.split(F.regexp_replace(low, r"[^а-яё0-9,\s-]|\n", "|"), "[|]")

    def sums(stretch: Column) -> Column:
        """Of each part that ends with kopecks its cents."""
        return F.transform(F.filter(F.split(stretch, "коп"), lambda p: p.contains("рубл")), lambda p: cents_of(F.split(p, "рубл")))

    def cents_of(halves: Column) -> Column:
        said = lambda h: F.filter(F.split(F.translate(h, ",-", "  "), r"\s+"), lambda w: w != "")
        whole, part = F.get(halves, F.size(halves) - 2), said(F.get(halves, F.size(halves) - 1))
        whole = said(F.regexp_replace(F.regexp_replace(whole, "^.*[0-9]", ""), "^.*,", ""))
        kopecks = F.coalesce(F.when(F.size(part) == 1, F.get(part, F.lit(0)).try_cast("bigint")), _number(part))
        return let(F.struct(_number(whole).alias("r"), kopecks.alias("k")), lambda x: F.when(x["k"] < 100, x["r"] * 100 + x["k"]))

    # a part that kopecks don't follow is the last of its stretch
    ended = F.filter(F.transform(stretches, lambda s: F.when(s.contains("коп"), F.regexp_replace(s, "(.*коп).*", "$1"))), lambda s: s.isNotNull())
    return F.when(c.rlike("(?iu)рубл"), F.get(F.flatten(F.transform(ended, sums)), F.lit(0)))


#: Captions of VAT sums.
VAT_CAPTIONS = ("в том числе ндс", "в т.ч. ндс", "в т.ч ндс", "в тч ндс", "сумма ндс")


def vat_from_words(c: Column) -> Column:
    """Cents of VAT written out in words behind its caption on its line; null if there is none."""
    return vat_in_lines(lines_and_low(even(c)))


def vat_in_lines(lines: Column) -> Column:
    """The same from a text's lines (lines_and_low)."""
    said = F.transform(lines, lambda x: let(behind(x["line"], VAT_CAPTIONS, x["low"]), money_from_words))
    return F.get(F.filter(said, lambda x: x.isNotNull()), F.lit(0))


#: Months in the genitive.
MONTHS = {"января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12}
_DATE_WORDS = r"(?iu)[«\"]?([0-9]{1,2})[»\"]?\s+(" + "|".join(MONTHS) + r")\s+([0-9]{4})"


def date_from_words(c: Column) -> Column:
    """DD.MM.YYYY of a date with the month in words; null if there is none."""
    day, month, year = (F.regexp_extract(c, _DATE_WORDS, k) for k in (1, 2, 3))
    return F.when(day != "", F.concat_ws(".", F.lpad(day, 2, "0"), F.format_string("%02d", F.try_element_at(_map(MONTHS), F.lower(month))), year))


def export_backoff(attempts: Column) -> Column:
    """Seconds to the next attempt: 30, doubled each time, half an hour at most."""
    return F.least(F.lit(30.0) * F.pow(F.lit(2.0), attempts), F.lit(1800.0)).cast("bigint")
