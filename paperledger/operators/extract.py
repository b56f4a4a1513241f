"""Fields from page text: docs (doc_id, text) to rows (doc_id, key, value, confidence, source).

Every field is an expression over the text, so a text is read once and only its fields leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import spread
from ..functions.money import date_from_words, format_cents, money_from_words, vat_in_lines
from ..functions.text import NUMBER_SIGN as SIGN
from ..functions.text import behind, even, let, lines_and_low, looks_like_account_number, lower_e
from .tables import settle

RULE, GUESS = 0.7, 0.3

#: Words that forms print as titles, captions and labels.
TITLES = ("счёт", "счет", "счёт-фактура", "счет-фактура", "эсчф", "накладная", "ттн", "тн", "акт", "упд", "товарный чек", "договор", "заказ")
DEALS = ("договор", "контракт", "основание", "соглашени")
SELLERS = ("поставщик", "продавец", "исполнитель", "грузоотправитель", "подрядчик", "арендодатель", "наймодатель")
BUYERS = ("покупатель", "плательщик", "заказчик", "грузополучатель", "арендатор", "наниматель")
AND_ADDRESS = "и его адрес"
TAIL_WORDS = ("адрес", "р/с", "расч", "тел.", "тел ", "банк", "факс", "e-mail", "почтовый", "унп", "инн", "унн")
TOTALS = ("итого", "всего к оплате", "сумма к оплате", "к оплате", "всего")
VAT_SUMS = ("в том числе ндс", "в т.ч. ндс", "в т.ч ндс", "в тч ндс", "сумма ндс", "ндс итого", "итого ндс")
NET_SUMS = ("сумма без ндс", "стоимость без ндс", "итого без ндс", "всего без ндс")
CURRENCY_CODES = {"BYN": "BYN", "RUB": "RUB", "RUR": "RUB", "USD": "USD", "EUR": "EUR"}
#: Beginnings of the words of each currency's name.
CURRENCY_WORDS = {"BYN": ("бел руб", "белорусск рубл"), "RUB": ("росийск рубл", "российск рубл"), "USD": ("доллар сша",), "EUR": ("евро",)}

#: Words that may stand between a document's title and the sign of its number, between a contract's word and
#: its number's sign or date, between a caption and its sum, and that a total is looked for behind its
#: caption; letters of a line up to the end of a party's caption.
TITLE_WORDS, DEAL_WORDS, DATE_WORDS, NET_WORDS, TOTAL_REACH, CAPTION_END = 6, 5, 8, 3, 12, 70


def words(options: tuple[str, ...]) -> str:
    """A pattern of any of the words, longer ones first."""
    return "(?:" + "|".join(w.replace(".", "[.]") for w in sorted(options, key=len, reverse=True)) + ")"


def words_of(rest: Column) -> Column:
    """Words of a line's rest; colons, and hyphens that don't join, are none."""
    return F.filter(F.split(F.regexp_replace(rest, r":|(?<![\p{L}0-9])-|-(?![\p{L}0-9])", " "), " "), lambda w: w != "")


def first_of(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def numbered(w: Column, reach: int) -> Column:
    """The number behind the first sign, with at most ``reach`` words before it."""

    def at(k: Column) -> Column:
        number = F.regexp_replace(F.get(w, k), r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")
        return F.when((k > 0) & (k <= reach + 1) & (number != ""), number)

    return let(F.array_position(w, SIGN).cast("int"), at)


def _core(w: Column) -> Column:
    """A word from its first digit to its last."""
    return F.regexp_replace(w, "^[^0-9]+|[^0-9]+$", "")


def sums_in(w: Column) -> Column:
    """Of each word its sum (digits, two decimals), null for other words. Digits that blanks group in threes
    are one word."""
    return F.transform(w, lambda x: F.when(x.contains(".") | x.contains(","), let(_core(x), lambda c: F.when(c.rlike("^[0-9]+[.,][0-9]{2}$"), c))))


def grouped(line: Column) -> Column:
    """A line whose digits aren't grouped by blanks."""
    return F.regexp_replace(line, "(?<=[0-9]) (?=[0-9]{3}(?![0-9]))", "")


def dates_in(w: Column) -> Column:
    return F.transform(w, lambda x: F.when(x.contains("."), let(_core(x), lambda c: F.when(c.rlike("^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$"), c))))


def deal_words(lines: Column) -> Column:
    """The words behind a contract's word of each line (lines_and_low) that has one."""
    return F.filter(F.transform(lines, lambda x: words_of(behind(x["line"], DEALS, x["low"]))), lambda w: w.isNotNull())


def contract_numbers(agreed: Column) -> Column:
    """E4. The numbers behind contracts' words (deal_words)."""
    return F.filter(F.transform(agreed, lambda w: numbered(w, DEAL_WORDS)), lambda n: n.isNotNull())


def captioned(text: Column, captions: tuple[str, ...]) -> Column:
    """What each line prints behind one of the captions and a colon or hyphen, null for other lines.

    A line is cut behind every caption; the first cut that a colon or hyphen follows, with three other
    characters at most between, is the one.
    """
    mark = "\u0002"
    marked = F.regexp_replace(text, rf"(?iu){words(captions)}(?:\s+{AND_ADDRESS})?", f"$0{mark}")

    def behind(line: Column) -> Column:
        def pick(cuts: Column) -> Column:
            at = F.array_position(F.transform(cuts, lambda x, i: (i > 0) & x.rlike(r"^[^\p{L}]{0,3}[:-]")), F.lit(True)).cast("int")
            near = F.length(F.array_join(F.slice(cuts, 1, at - 1), "")) <= CAPTION_END
            rest = F.array_join(F.slice(cuts, at, F.size(cuts)), "")
            return F.when((at > 1) & near, F.regexp_replace(rest, r"^[^:-]*[:-][ \t]*", ""))

        return F.when(line.contains(mark), let(F.split(line, mark, -1), pick))

    return F.transform(F.split(marked, "\n", -1), behind)


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def money_value(c: Column) -> Column:
    """A printed sum with a dot and without blanks."""
    return F.translate(F.translate(c, " \u00a0", ""), ",", ".")


def _largest(sums: Column) -> Column:
    """The largest of printed sums, as printed; the first of equal ones."""
    keyed = F.transform(F.filter(sums, lambda m: m.isNotNull()), lambda m, i: F.struct(F.regexp_replace(m, "[^0-9]", "").try_cast("decimal(38,0)").alias("v"), (-i).alias("i"), m.alias("m")))
    return F.array_max(keyed)["m"]


def doc_number(text: Column) -> Column:
    """E3. struct<value, confidence>: after the document's title, else the first sign; never a contract's
    number when there is another, never a bank account."""
    return let(lines_and_low(even(text)), lambda lines: _doc_number(lines, contract_numbers(deal_words(lines)), F.transform(lines, lambda x: words_of(x["line"]))))


def _doc_number(lines: Column, deals: Column, spoken: Column) -> Column:
    """The same from a text's lines (lines_and_low), its contracts' numbers and the words of each line."""
    pick = lambda v, c: let(v, lambda x: F.when(x.isNotNull(), F.struct(x.alias("value"), F.lit(c).alias("confidence"))))
    fits = lambda ns: F.filter(ns, lambda n: n.isNotNull() & ~looks_like_account_number(n))

    def every(w: Column) -> Column:
        return F.zip_with(w, F.slice(w, 2, 1_000_000), lambda a, b: F.when(a == SIGN, F.nullif(F.regexp_replace(b, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", ""), F.lit(""))))

    def chosen(d: Column) -> Column:
        other = lambda ns: F.get(F.filter(ns, lambda n: ~F.array_contains(d["deals"], n)), F.lit(0))
        return F.coalesce(pick(other(d["own"]), RULE), pick(F.get(d["own"], F.lit(0)), RULE), pick(other(fits(let(F.flatten(spoken), every))), GUESS))

    own = fits(F.transform(lines, lambda x: let(words_of(behind(x["line"], TITLES, x["low"])), lambda w: numbered(w, TITLE_WORDS))))
    return let(F.struct(deals.alias("deals"), own.alias("own")), chosen)


def total(text: Column) -> Column:
    """E6. struct<value, confidence>: the largest sum among the words behind a caption, unless VAT or tax is
    named before the first; else in words; else the largest sum of the text as a guess."""

    return let(lines_and_low(even(text)), _total)


def _total(lines: Column) -> Column:
    """The same from a text's lines (lines_and_low)."""

    def labelled(x: Column) -> Column:
        said = lambda rest: let(F.struct(rest.alias("rest"), F.slice(words_of(grouped(rest)), 1, TOTAL_REACH).alias("w")), lambda d: let(sums_in(d["w"]), lambda sums: value(d, sums)))
        return let(behind(x["line"], TOTALS, x["low"]), lambda rest: F.when(rest.isNotNull(), said(rest)))

    def value(d: Column, sums: Column) -> Column:
        at = F.array_position(F.transform(sums, lambda x: x.isNotNull()), F.lit(True)).cast("int")
        taxed = F.exists(F.slice(d["w"], F.lit(1), F.greatest(at - 1, F.lit(0))), lambda x: lower_e(x).rlike("ндс|налог"))
        return F.when((at > 0) & taxed, F.lit(None).cast("string")).otherwise(F.coalesce(money_value(_largest(sums)), let(money_from_words(d["rest"]), format_cents)))

    sure = lambda v, c: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(c).alias("confidence")))
    guess = money_value(_largest(F.flatten(F.transform(lines, lambda x: sums_in(words_of(grouped(x["line"])))))))
    return F.coalesce(let(first_of(F.transform(lines, labelled)), lambda v: sure(v, RULE)), let(guess, lambda v: sure(v, GUESS)))


def sum_behind(lines: Column, captions: tuple[str, ...], reach: int, bare: bool) -> Column:
    """E7. The first sum behind a caption on its line, with at most ``reach`` words without digits before it;
    if ``bare`` nothing but a rate in percent may stand there."""

    def in_line(x: Column) -> Column:
        return let(words_of(grouped(behind(x["line"], captions, x["low"]))), lambda w: F.when(w.isNotNull(), let(sums_in(w), lambda sums: near(w, sums))))

    def near(w: Column, sums: Column) -> Column:
        at = F.array_position(F.transform(sums, lambda x: x.isNotNull()), F.lit(True)).cast("int")
        before = F.slice(w, F.lit(1), F.greatest(at - 1, F.lit(0)))
        odd = (lambda x: ~x.rlike("^[0-9]{0,2}%?:?$")) if bare else (lambda x: x.rlike("[0-9]"))
        return F.when((at > 0) & (F.size(before) <= reach) & ~F.exists(before, odd), F.get(sums, at - 1))

    return first_of(F.transform(lines, in_line))


def contract_date(agreed: Column) -> Column:
    """E5. The first date behind "от" behind a contract's word (deal_words)."""

    def in_line(w: Column) -> Column:
        return let(F.array_position(F.transform(w, lambda x: lower_e(x)), "от").cast("int"), lambda k: F.when((k > 0) & (k <= DATE_WORDS), F.get(dates_in(w), k)))

    return first_of(F.transform(agreed, in_line))


def currency(text: Column) -> Column:
    """E8. Code, or by words."""
    codes = F.create_map(*(F.lit(x) for pair in CURRENCY_CODES.items() for x in pair))
    code = first(text, "(?<![A-Za-z])(" + "|".join(CURRENCY_CODES) + ")(?![A-Za-z])")
    low = F.lower(text)
    said = lambda name: "|".join(r"\p{L}*[.]?\s*".join(w.split()) for w in name)
    return F.coalesce(F.try_element_at(codes, code), *(F.when(low.rlike(said(name)), c) for c, name in CURRENCY_WORDS.items()))


def party(behind: Column) -> Column:
    """E1. The first name of ``captioned`` without address, bank and tax tail; three characters at least.
    A caption with nothing behind it on its line has no name."""
    tail = rf"(?iu){words(TAIL_WORDS)}.*$"
    names = F.transform(behind, lambda n: F.regexp_replace(F.regexp_replace(n, tail, ""), r"^[,;:\s]+|[,;:\s]+$", ""))
    return F.get(F.filter(names, lambda n: F.length(n) >= 3), F.lit(0))


#: Labels of registration numbers and how many digits each has.
ID_DIGITS = {"унп": (9,), "унн": (9,), "инн": (10, 12)}


def labelled(text: Column, digits: dict[str, tuple[int, ...]]) -> Column:
    """All numbers of the right length that stand behind one of the labels."""
    apart = F.regexp_replace(lower_e(text), f"(?<!\\p{{L}})({'|'.join(digits)})(?!\\p{{L}})", " $1 ")
    w = F.filter(F.split(apart, r"[:№\s]+"), lambda x: x != "")

    def pair(a: Column, b: Column) -> Column:
        n = F.regexp_replace(b, "[^0-9].*$", "")
        return F.coalesce(*(F.when((a == name) & F.length(n).isin(*sizes), n) for name, sizes in digits.items()))

    return F.filter(let(w, lambda x: F.zip_with(x, F.slice(x, 2, 1_000_000), pair)), lambda n: n.isNotNull())


def labelled_ids(text: Column) -> Column:
    """All labelled tax ids: nine digits, or ten or twelve behind the Russian label."""
    return labelled(text, ID_DIGITS)


def tax_id(text: Column, behind: Column, own: Column | None = None) -> Column:
    """E2. The id labelled on the first captioned line; else the first labelled one that isn't ``own``."""
    line = F.coalesce(F.get(F.filter(behind, lambda n: n.isNotNull()), F.lit(0)), F.lit(""))
    rest = F.get(F.filter(labelled_ids(text), lambda n: ~n.eqNullSafe(own if own is not None else F.lit(None))), F.lit(0))
    return F.coalesce(F.get(labelled_ids(line), F.lit(0)), rest)


def extract_fields(docs: DataFrame) -> DataFrame:
    """E9. All fields of E1 to E8."""
    plain = lambda key, v: F.struct(F.lit(key).alias("key"), F.trim(v).alias("value"), F.lit(RULE).alias("confidence"))
    sure = lambda key, found: let(found, lambda s: F.struct(F.lit(key).alias("key"), s["value"].alias("value"), s["confidence"].alias("confidence")))

    # texts take long and are short: few bytes must not mean few tasks
    texts = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    rows = settle(texts, sellers=captioned(F.col("text"), SELLERS), buyers=captioned(F.col("text"), BUYERS), even=even(F.col("text")))
    rows = settle(rows, lines=lines_and_low(F.col("even"))).drop("even")
    line = F.coalesce(F.get(F.filter("buyers", lambda n: n.isNotNull()), F.lit(0)), F.lit(""))
    rows = settle(rows, spoken=F.transform("lines", lambda x: words_of(x["line"])), agreed=deal_words(F.col("lines")), buyer=F.get(labelled_ids(line), F.lit(0)))
    rows = settle(rows, deals=contract_numbers(F.col("agreed")))

    def listed() -> Column:
        t, sellers, buyers, buyer, lines, w, agreed, deals = (F.col(c) for c in ("text", "sellers", "buyers", "buyer", "lines", "spoken", "agreed", "deals"))
        vat, net = sum_behind(lines, VAT_SUMS, 3, True), sum_behind(lines, NET_SUMS, NET_WORDS, False)
        dates = first_of(F.flatten(F.transform(w, dates_in)))
        return F.array(
            sure("number", _doc_number(lines, deals, w)),
            plain("date", F.coalesce(dates, date_from_words(t))),
            sure("total", _total(lines)),
            plain("vat_amount", F.coalesce(money_value(vat), let(vat_in_lines(lines), format_cents))),
            plain("amount_no_vat", money_value(net)),
            plain("currency", currency(t)),
            plain("counterparty", party(sellers)),
            plain("organization", party(buyers)),
            plain("organization_unp", buyer),
            plain("unp", tax_id(t, sellers, buyer)),
            plain("kpp", F.get(labelled(t, {"кпп": (9,)}), F.lit(0))),
            plain("contract_number", F.get(deals, F.lit(0))),
            plain("contract_date", contract_date(agreed)),
        )

    rows = rows.select("doc_id", F.explode(listed()).alias("f"))
    return rows.select("doc_id", "f.key", "f.value", "f.confidence", F.lit("rule").alias("source")).where("value is not null and value <> ''")
