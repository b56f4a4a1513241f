"""Text functions: columns in, columns out.

Java's ``(?i)`` covers ASCII only, so patterns that meet Cyrillic use ``(?iu)`` or lower case first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quotation marks that names and searches disregard.
QUOTES = "«»\"'„“”`"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: what is used several times inside a deep expression
    would else be copied to each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_e(c: Column) -> Column:
    """Lower case with ё as е."""
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


def first_where(items: Column, test) -> Column:
    """Place (from 1) of the first entry that passes, 0 if there is none. Entries behind it are not tested."""
    seen = F.aggregate(items, F.lit(0), lambda k, x: F.when(k > 0, k).when(test(x), 1 - k).otherwise(k - 1))
    return F.greatest(seen, F.lit(0))


def norm_for_search(c: Column) -> Column:
    """Lower case without blanks and quotes, commas as dots."""
    return F.translate(F.regexp_replace(F.lower(c), "[ \t\n\r \"«»'`]", ""), ",", ".")


def normalize_key(c: Column) -> Column:
    """Lower case, ё as е, every run of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(lower_e(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def single_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, " ", " "), r"\s+", " "))


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(single_spaces(c), r"^[ |¦,;]+|[ |¦,;]+$", "")


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def trunc_chars(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def clip_bytes(c: Column, n: int) -> Column:
    """At most n bytes of UTF-8, ending at a character's edge."""
    chars = F.split(F.substring(c, 1, n), "")
    sized = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("bytes"), F.lit("").alias("text")),
        lambda a, x: F.struct((a["bytes"] + F.octet_length(x)).alias("bytes"), F.when(a["bytes"] + F.octet_length(x) <= n, F.concat(a["text"], x)).otherwise(a["text"]).alias("text")),
    )
    return F.when(F.octet_length(c) <= n, c).otherwise(sized["text"])


def ocr_looks_solid(c: Column) -> Column:
    """24 letters or more, and letters are half of all non-blank characters or more."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    solid = F.length(F.regexp_replace(c, r"\s", ""))
    return (letters >= 24) & (letters * 2 >= solid)


def is_ocr_noise(c: Column) -> Column:
    """Under 4 characters, punctuation over a third, or letters mostly not Cyrillic."""
    t = F.trim(c)
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    cyrillic = F.length(F.regexp_replace(t, r"[^\p{IsCyrillic}]", ""))
    marks = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
    return (n < 4) | (marks * 3 > n) | ((letters > 0) & (cyrillic * 2 < letters))


def tax_ids_in(c: Column) -> Column:
    """Distinct 9-digit numbers, printed together or as three groups of three, in order."""
    runs = F.filter(F.regexp_extract_all(c, F.lit(r"(?<![0-9])[0-9]+(?![0-9])"), F.lit(0)), lambda x: F.length(x) == 9)
    groups = F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{3}(?![0-9])(?! [0-9])"), F.lit(0)), lambda x: F.translate(x, " ", ""))
    return F.array_distinct(F.concat(runs, groups))


def strip_math(c: Column) -> Column:
    """Formula markup for a numero sign as №."""
    return F.regexp_replace(c, r"\$?\\?(?:mathrm|text)?\{?\s*N\s*\}?\^?\{?\s*(?:o|0|º|°|\\circ)\s*\}?\$", "№")


def normalize_no_sign(c: Column) -> Column:
    """N°, Nº and No before a number as №."""
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}])[NН](?:[°º]|[oо](?=[. ]?\s*[0-9]))\.?", "№")


#: Latin letters and the Cyrillic ones that look like them.
LATIN, CYRILLIC = "ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху"


def latin_to_cyrillic(c: Column) -> Column:
    return F.translate(c, LATIN, CYRILLIC)


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words), F.lit(False))


def starts_with_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(w) for w in words), F.lit(False))


def sanitize_name(c: Column) -> Column:
    """Base name of a path; "document" if nothing is left."""
    base = F.trim(F.substring_index(F.translate(c, "\\", "/"), "/", -1))
    return F.when(base.isNull() | base.isin("", ".", ".."), "document").otherwise(base)


def sanitize_folder(c: Column) -> Column:
    """A folder name that can't leave its parent."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[/\\]", "_"), r"\.\.", "_")


#: Types by file extension.
CONTENT_TYPES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "webp": "image/webp", "heic": "image/heic"}


def detect_content_type(name: Column, header: Column) -> Column:
    """The header's type unless that says nothing, else by the extension."""
    known = F.coalesce(*(F.when(F.lower(F.substring_index(name, ".", -1)) == e, t) for e, t in CONTENT_TYPES.items()), F.lit("application/octet-stream"))
    plain = F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1))
    return F.when(plain.isin("", "application/octet-stream"), known).otherwise(plain)


def doc_number_norm(c: Column) -> Column:
    """Without a leading №, # or N, then as for a search."""
    return norm_for_search(F.regexp_replace(F.trim(c), r"^(?:№|#|N)\s*", ""))


def looks_like_account_number(c: Column) -> Column:
    """A bank account (two letters, two digits, four letters, more) or its label."""
    return c.rlike(r"[A-Z]{2}[0-9]{2}\s?[A-Z]{4}\s?[0-9]{4}") | c.rlike(r"(?iu)(р\s*/\s*с|расч[её]тн|iban|bic|бик)")


NUMBER_SIGN = "№"


def even(text: Column) -> Column:
    """The text with single blanks, every number's sign as a word of its own, and dots only inside numbers."""
    signs = F.regexp_replace(F.regexp_replace(text, r"(?i)(?<!\p{L})no?(?=[: ]*[0-9])", NUMBER_SIGN), NUMBER_SIGN, f" {NUMBER_SIGN} ")
    return F.regexp_replace(F.regexp_replace(signs, "[.](?![0-9])", " "), r"[ \t\u00a0]+", " ")


def lines_of(text: Column) -> Column:
    return F.split(even(text), "\n", -1)


def lines_and_low(even_text: Column) -> Column:
    """struct<line, low> of each line of a text by ``even``; low is the line by lower_e. The text is lowered as a whole."""
    return F.zip_with(F.split(even_text, "\n", -1), F.split(lower_e(even_text), "\n", -1), lambda a, b: F.struct(a.alias("line"), b.alias("low")))


def _shared(words: list[str]) -> str:
    """The longest text that all words hold."""
    first = min(words, key=len)
    parts = {first[a:b] for a in range(len(first)) for b in range(a + 1, len(first) + 1)}
    return max((p for p in parts if all(p in w for w in words)), key=len, default="")


def behind(line: Column, captions: tuple[str, ...], low: Column | None = None) -> Column:
    """What stands behind the first of the captions in a line, of captions at one place the longest; else null.
    ``low``: the line by lower_e, where it is at hand."""
    known = sorted({" ".join(c.replace("ё", "е").replace(".", " ").split()) for c in captions})
    shared = _shared(known)
    has = lambda low: contains_any(low, known) if len(shared) < 3 else low.contains(shared) & contains_any(low, known)
    places = lambda low: F.array_min(F.filter(F.array(*(F.struct(F.locate(c, low).alias("at"), F.lit(-len(c)).alias("size")) for c in known)), lambda x: x["at"] > 0))
    place = lambda low: F.when(has(low), places(low))  # noqa: E731  most lines have none
    return let(place(low) if low is not None else let(lower_e(line), place), lambda x: F.when(x.isNotNull(), F.substr(line, x["at"] - x["size"], F.length(line))))
