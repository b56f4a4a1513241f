"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Column expressions only. Positions come from the lengths of the matches and of the pieces between
them, so they count code points. The patterns use possessive repeats and look-behinds at places
where nothing could be given back, so a long text of one character class costs linear time and no
deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAIL = "[A-Za-z0-9._%+-]"
#: kind: (pattern, substring without which there is no match or None, words nearby that raise the score)
KINDS = {
    "email": (rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|correo|courriel|kontakt"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"\bip\b|address|host|server|client|adresse|servidor"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, "card|visa|credit|payment|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|tel|call|mobile|fax|telefon|llama"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, "iban|account|bank|konto|compte|cuenta"),
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, and what context words within CONTEXT code points add.
SCORE = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_BONUS, CONTEXT = 0.1, 40

_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


#: Matches whose places are summed up together, so that no long array is copied for each match.
BLOCK = 256


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks, its first four characters moved to the end, is 1 modulo 97."""
    def check(moved: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            c = F.ascii(F.substring(moved, i, F.lit(1)))
            return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), F.lit(0), add) == 1

    return let(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), check)


def confirmed(kind: str, span: Column) -> Column:
    if kind == "ip":
        return span.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return let(_digits(span), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(span)).between(8, 15)
    if kind == "iban":
        return let(F.regexp_replace(span, " ", ""), lambda plain: F.length(plain).between(15, 34) & mod97(plain))
    return F.lit(True)


FOUND = "array<struct<start:int,end:int,value:string>>"
SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _block(kind: str, pieces: Column) -> Column:
    """Of consecutive (gap, value) pieces: their text, and the confirmed values with their places in it."""

    def add(acc: Column, q: Column) -> Column:
        start = acc["at"] + F.length(q["gap"])
        end = (start + F.length(q["value"])).cast("int")
        item = F.struct(start.cast("int").alias("start"), end.alias("end"), q["value"].alias("value"))
        found = F.when(confirmed(kind, q["value"]), F.concat(acc["found"], F.array(item))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("found"))
    whole = F.array_join(F.transform(pieces, lambda q: F.concat(q["gap"], q["value"])), "")
    return F.struct(F.aggregate(pieces, empty, add)["found"].alias("found"), whole.alias("text"))


def _spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value, score>> of the confirmed matches, in order.

    The text is matched once and once cut at the matches. Each piece is read a bounded number of
    times: blocks of pieces are placed by themselves and then moved by the length of what precedes.
    """
    pattern, needs, words = KINDS[kind]
    has = F.regexp_like(text, F.lit(pattern)) if needs is None else text.contains(needs)

    def scored(b: Column, before: Column, after: Column, moved: Column) -> Column:
        """The spans of a block with their scores; context reaches into the blocks around it."""
        lead = F.length(before)

        def one(around: Column, s: Column) -> Column:
            begin = F.greatest(s["start"] + lead - CONTEXT, F.lit(0))
            near = F.concat(F.substring(around, begin + 1, s["start"] + lead - begin), F.lit(" "), F.substring(around, s["end"] + lead + 1, F.lit(CONTEXT)))
            bonus = F.when(F.lower(near).rlike(words), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind).alias("kind"), (s["start"] + moved).alias("start"), (s["end"] + moved).alias("end"), s["value"].alias("value"), (F.lit(SCORE[kind]) + bonus).alias("score"))

        return let(F.concat(before, b["text"], after), lambda around: F.transform(b["found"], lambda s: one(around, s)))

    def placed(blocks: Column, last: Column) -> Column:
        """Blocks one after the other: (at, tail of the text so far, spans)."""

        def add(acc: Column, k: Column) -> Column:
            b, following = F.get(blocks, k), F.get(blocks, k + 1)["text"]
            after = F.when(following.isNull(), last).otherwise(following)
            spans = F.when(F.size(b["found"]) > 0, scored(b, acc["tail"], F.substring(after, 1, CONTEXT), acc["at"])).otherwise(F.array().cast(SPANS))
            return F.struct(
                (acc["at"] + F.length(b["text"])).cast("int").alias("at"),
                F.substring(F.concat(acc["tail"], b["text"]), -CONTEXT, CONTEXT).alias("tail"),
                F.concat(acc["spans"], F.array(F.struct(spans.alias("of")))).alias("spans"),
            )

        empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<struct<of:{SPANS}>>").alias("spans"))
        done = F.aggregate(F.sequence(F.lit(0), F.size(blocks) - 1), empty, add)["spans"]
        return F.flatten(F.transform(done, lambda x: x["of"]))

    def cut(p: Column) -> Column:
        pieces = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["values"])), p["values"], lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        starts = F.sequence(F.lit(1), F.size(p["values"]), F.lit(BLOCK))
        blocks = let(pieces, lambda q: F.transform(starts, lambda k: let(F.slice(q, k, F.lit(BLOCK)), lambda some: _block(kind, some))))
        return let(blocks, lambda b: F.when(F.exists(b, lambda x: F.size(x["found"]) > 0), placed(b, F.element_at(p["gaps"], -1))).otherwise(F.array().cast(SPANS)))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(has, let(both, lambda p: F.when(F.size(p["values"]) > 0, cut(p)).otherwise(F.array().cast(SPANS)))).otherwise(F.array().cast(SPANS))


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end, value, score>>, by kind in the order of
    KINDS, then by start; start and end count code points, end exclusive.

    Spans of one kind do not overlap (leftmost first); spans of different kinds may. Null texts
    count as empty, ids are passed through whatever they are, every input row gives one row, and
    an empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return docs.select("doc_id", F.concat(*(_spans(F.col("text"), k) for k in KINDS)).alias("spans"))


def mask_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = 0.6) -> DataFrame:
    """doc_id and masked: the text with each span of at least that score replaced by ``<kind>``.

    Of overlapping spans the one that begins first is replaced, of those that begin together the longest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.concat(*(_spans(text, k) for k in KINDS))
    chosen = F.array_sort(F.transform(F.filter(spans, lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))

    def add(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.when(skip, acc["at"]).otherwise(-s["minus_end"]).alias("at"), F.when(skip, acc["out"]).otherwise(piece).alias("out"))

    done = F.aggregate(chosen, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))).alias("masked"))


def span_keys(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
