"""Rules over field rows: doc_id, key, value, confidence, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import grounded_in_text
from ..functions.parties import format_valid
from ..functions.text import doc_number_norm, looks_like_account_number, norm_for_search, tax_ids_in
from .evidence import clean_party_name

MODEL = 0.85
#: Names of the sides behind "УНП".
PAYEE = "получателя платежа"
SELLERS = ("продавца", "поставщика", "исполнителя", "арендодателя", "грузоотправителя", PAYEE)
BUYERS = ("покупателя", "заказчика", "плательщика", "грузополучателя", "арендатора")
#: Characters between a side's name and its id, at most.
SIDE_GAP = 25
#: Keys that a document's head holds.
HEAD_KEYS = ("number", "date", "counterparty", "organization", "unp", "organization_unp")


def merge_fields(rules: DataFrame, model: DataFrame, chart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J9. The model's values over the rules', and those that were dropped: accounts that the chart lacks,
    numbers that look like bank accounts."""
    m = model.select("doc_id", F.lower(F.trim("key")).alias("key"), F.trim("value").alias("value")).where("key <> '' and value <> ''")
    known = chart.select(F.col("code").alias("value"), F.lit(True).alias("known"))
    m = m.join(known, "value", "left").withColumn("bad", (F.col("key").startswith("account_") & F.col("known").isNull()) | ((F.col("key") == "number") & looks_like_account_number(F.col("value"))))
    good = m.where("not bad").select("doc_id", "key", F.col("value").alias("new"))
    rows = rules.join(good, ["doc_id", "key"], "full_outer")
    taken = F.col("new").isNotNull()
    merged = rows.select("doc_id", "key", F.coalesce("new", "value").alias("value"), F.when(taken, MODEL).otherwise(F.col("confidence")).alias("confidence"), F.when(taken, "model").otherwise(F.col("source")).alias("source"))
    return merged, m.where("bad").select("doc_id", "key", "value")


def prefer_blank_number(fields: DataFrame, header: DataFrame) -> DataFrame:
    """R3. The form's number (doc_id, number) replaces another, unless that one is manual or begins with it."""
    rows = fields.join(header.select("doc_id", F.lit("number").alias("key"), F.col("number").alias("form")), ["doc_id", "key"], "full_outer")
    keep = F.col("form").isNull() | ((F.col("source") == "manual") | doc_number_norm(F.col("value")).startswith(doc_number_norm(F.col("form"))))
    keep = F.coalesce(keep, F.lit(False))
    return rows.select("doc_id", "key", F.when(keep, F.col("value")).otherwise(F.col("form")).alias("value"), F.when(keep, F.col("confidence")).otherwise(F.lit(0.9)).alias("confidence"), F.when(keep, F.col("source")).otherwise("rule").alias("source"))


def side_id(text: Column, sides: tuple[str, ...]) -> Column:
    """E10. The nine digits behind the first "УНП" that names one of the sides, on the side's line and at most
    25 other characters behind it; null if there are none."""

    def behind_side(part: Column) -> Column:
        rest = F.regexp_replace(part, r"^\s+", "")
        named = F.coalesce(*(F.when(rest.startswith(s), F.substr(rest, F.lit(len(s) + 1))) for s in sides))
        lead = F.length(F.regexp_extract(named, r"^[^0-9\n]*", 0))
        digits = F.substr(named, lead + 1, F.lit(9))
        return F.when((lead <= SIDE_GAP) & digits.rlike("^[0-9]{9}$"), digits)

    parts = F.split(F.regexp_replace(F.lower(text), r"получателя\s+платежа", PAYEE), "унп")
    return F.get(F.filter(F.transform(F.slice(parts, 2, 1_000_000_000), behind_side), lambda x: x.isNotNull()), F.lit(0))


def labelled_sides(docs: DataFrame) -> DataFrame:
    """E10. doc_id, key (unp for the seller, organization_unp for the buyer), value of the tax ids that documents
    (doc_id, text) give under a side's name. Null texts have none."""
    ids = F.array(F.struct(F.lit("unp").alias("key"), side_id(F.col("text"), SELLERS).alias("value")), F.struct(F.lit("organization_unp").alias("key"), side_id(F.col("text"), BUYERS).alias("value")))
    return docs.select("doc_id", F.explode(ids).alias("x")).select("doc_id", "x.*").where("value is not null")


def fix_fields(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """R4. Fields by the text. Tax ids that it lacks go, sums that it lacks fall to 0.45 at most; ids under a side's name
    (E10) replace others; of two equal ids the less sure one goes, the seller's in a tie; names lose their tails and
    go if nothing is left, and the own side's goes if both are equal. Blank texts change nothing, nor do documents
    without fields get any. Null values become empty.
    """
    columns = ("doc_id", "key", "value", "confidence", "source")
    whole = Window.partitionBy("doc_id")
    texts = docs.where("trim(text) <> ''").select("doc_id", "text")
    rows = fields.select(*columns).join(texts, "doc_id", "left")
    plain = rows.where("text is null").select(*columns)
    rows = rows.where("text is not null")
    lost = F.coalesce((F.col("value") != "") & ~grounded_in_text(F.col("value"), F.col("text")), F.lit(False))
    ids, sums = F.col("key").isin("unp", "organization_unp", "inn", "kpp"), F.col("key").isin("total", "vat_amount", "amount_no_vat")
    rows = rows.where(~(ids & lost)).withColumn("confidence", F.when(sums & lost, F.least("confidence", F.lit(0.45))).otherwise(F.col("confidence"))).select(*columns)

    sides = labelled_sides(texts.join(fields.select("doc_id").distinct(), "doc_id", "left_semi")).withColumnRenamed("value", "said")
    rows = rows.join(sides, ["doc_id", "key"], "full_outer")
    told = F.col("said").isNotNull()
    rows = rows.select("doc_id", "key", F.coalesce("said", "value").alias("value"), F.when(told, 0.9).otherwise(F.col("confidence")).alias("confidence"), F.when(told, "rule").otherwise(F.col("source")).alias("source"))

    name = F.col("key").isin("counterparty", "organization") & (F.col("value") != "")
    rows = rows.withColumn("value", F.when(name, F.nullif(clean_party_name(F.col("value")), F.lit(""))).otherwise(F.coalesce("value", F.lit("")))).where("value is not null")
    of = lambda key, c: F.max(F.when(F.col("key") == key, F.col(c))).over(whole)
    rows = rows.withColumns({"equal": of("unp", "value") == of("organization_unp", "value"), "ours": of("organization_unp", "confidence") < of("unp", "confidence"), "same": F.lower(of("counterparty", "value")) == F.lower(of("organization", "value"))})
    drop = (F.col("equal") & (F.col("key") == F.when(F.col("ours"), "organization_unp").otherwise("unp"))) | (F.col("same") & (F.col("key") == "organization"))
    return rows.where(~F.coalesce(drop, F.lit(False))).select(*columns).unionByName(plain)


def fill_total(fields: DataFrame, totals: DataFrame) -> DataFrame:
    """R5. Total of the table (doc_id, total as text) where it is missing or under 0.7."""
    rows = fields.join(totals.select("doc_id", F.lit("total").alias("key"), F.col("total").alias("t")), ["doc_id", "key"], "full_outer")
    take = F.coalesce(F.col("t").isNotNull() & (F.col("value").isNull() | (F.trim("value") == "") | (F.col("confidence") < 0.7)), F.lit(False))
    return rows.select("doc_id", "key", F.when(take, F.col("t")).otherwise(F.col("value")).alias("value"), F.when(take, 0.7).otherwise(F.col("confidence")).alias("confidence"), F.when(take, "table").otherwise(F.col("source")).alias("source"))


def enforce_formats(fields: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R13. Kept fields and rejected ones. A cut tax id of six digits or more is restored when exactly one
    id of the text contains it."""
    ids = docs.select("doc_id", tax_ids_in(F.col("text")).alias("ids"))
    bad = format_valid(F.col("key"), F.col("value")) == -1
    rows = fields.join(ids, "doc_id", "left").withColumn("fits", F.filter(F.coalesce("ids", F.array().cast("array<string>")), lambda x: x.contains(F.col("value"))))
    cut = F.col("key").isin("unp", "organization_unp") & F.col("value").rlike("^[0-9]{6,8}$") & (F.size("fits") == 1)
    rows = rows.withColumn("value", F.when(cut, F.get("fits", F.lit(0))).otherwise(F.col("value"))).withColumn("bad", bad)
    columns = ("doc_id", "key", "value", "confidence", "source")
    return rows.where("not bad").select(*columns), rows.where("bad").select("doc_id", "key", "value", F.lit("format").alias("reason"))


def manual_edits(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """R19. Latest operator's value of each field (doc_id, key, value, ts): sure and manual."""
    last = edits.groupBy("doc_id", "key").agg(F.max_by("value", "ts").alias("new"))
    rows = fields.join(last, ["doc_id", "key"], "full_outer")
    taken = F.col("new").isNotNull()
    return rows.select("doc_id", "key", F.coalesce("new", "value").alias("value"), F.when(taken, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(taken, "manual").otherwise(F.col("source")).alias("source"))


def confidence(fields: DataFrame, docs: DataFrame, rules: DataFrame, facts: DataFrame, chart: DataFrame) -> DataFrame:
    """R9. Fields with their confidence by evidence. docs: doc_id, text, head, body, zones_ok. facts: doc_id,
    arithmetic and lines (1, -1, 0), header_number. Points are hundredths, so sums are exact. A document's
    fields travel as one array, so its text is shuffled once and not once for each field."""
    alt = rules.select("doc_id", "key", F.col("value").alias("alt"))
    known = chart.select(F.col("code").alias("value"), F.lit(True).alias("known"))
    listed = fields.join(alt, ["doc_id", "key"], "left").join(known, "value", "left").groupBy("doc_id").agg(F.collect_list(F.struct("key", "value", "confidence", "source", "alt", "known")).alias("fields"))
    norm = lambda c: norm_for_search(F.coalesce(c, F.lit("")))
    texts = docs.select("doc_id", norm("text").alias("full"), norm("head").alias("head"), norm("body").alias("body"), "zones_ok")
    rows = listed.join(texts, "doc_id").join(facts, "doc_id", "left")
    arithmetic, by_lines, number = F.coalesce("arithmetic", F.lit(0)), F.coalesce("lines", F.lit(0)), norm(F.col("header_number"))

    def points(f):
        needle = norm_for_search(F.trim(f["value"]))
        key = f["key"]
        base = F.when(key.startswith("account_"), F.when(f["known"], 75).otherwise(40)).when(F.col("full").contains(needle), 70).otherwise(20)
        place = F.when(key.isin(*HEAD_KEYS) & F.col("zones_ok"), F.when(F.col("head").contains(needle), 15).when(F.col("body").contains(needle), -30).otherwise(0)).otherwise(0)
        agrees = F.when(F.trim(F.coalesce(f["alt"], F.lit(""))) == "", 0).when(norm_for_search(f["alt"]) == needle, F.when(f["source"] != "rule", 20).otherwise(0)).otherwise(-10)
        valid = format_valid(key, F.trim(f["value"]))
        form = F.when(valid == 1, 10).when(valid == -1, -30).otherwise(0)
        sums = F.when(key.isin("total", "amount_no_vat", "vat_amount"), arithmetic * 15).otherwise(0)
        lines = F.when(key == "total", F.when(by_lines > 0, 15).when(by_lines < 0, -10).otherwise(0)).otherwise(0)
        head = F.when((key == "number") & (number != ""), F.when(number == needle, 20).otherwise(-15)).otherwise(0)
        score = F.least(F.greatest(base + place + agrees + form + sums + lines + head, F.lit(5)), F.lit(98)) / 100.0
        sure = F.when(f["source"] == "manual", 1.0).when(f["source"].isin("company", "directory"), f["confidence"]).when(F.trim(f["value"]) == "", 0.0).otherwise(score)
        return F.struct(key.alias("key"), f["value"].alias("value"), sure.alias("confidence"), f["source"].alias("source"))

    return rows.select("doc_id", F.explode(F.transform("fields", points)).alias("f")).select("doc_id", "f.*")
