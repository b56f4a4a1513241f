"""Document types, accounts, and rules over records that only need small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lower_e

#: Types that are one business type.
ACT_LIKE = ("act", "schet_faktura", "act_priemki", "invoice", "receipt", "payment_order", "act_sverki")
#: Business types of the type inbox.
INBOX_TYPES = ("act", "waybill", "contract", "power_of_attorney", "upd")

DOC_TYPES = "slug string, title string, synonyms array<string>, anchors array<string>, weight double, required array<string>, has_lines boolean, object string, position int"


def effective_doc_type(c: Column) -> Column:
    """F10."""
    return F.when(c.isin(*ACT_LIKE), "act").otherwise(c)


def type_inbox_doc_type(c: Column) -> Column:
    """F11. Business type if the type inbox takes it, else null."""
    return F.when(effective_doc_type(c).isin(*INBOX_TYPES), effective_doc_type(c))


def load_doc_types(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """S7. Overrides laid over the built-in types field by field; new types come after them."""
    fields = ("title", "synonyms", "anchors", "weight", "required", "has_lines", "object")
    new = overrides.select("slug", *(F.col(f).alias(f"new_{f}") for f in fields), F.col("position").alias("new_position"))
    return defaults.join(new, "slug", "full_outer").select("slug", *(F.coalesce(f"new_{f}", f).alias(f) for f in fields), F.coalesce("position", F.col("new_position") + 1_000_000).alias("position"))


def types_without_target(catalogue: DataFrame) -> DataFrame:
    """S7."""
    return catalogue.where(F.trim(F.coalesce("object", F.lit(""))) == "").select("slug")


def export_routable(docs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """F12. Adds routable: the type is known and has a target object."""
    known = catalogue.where(F.trim(F.coalesce("object", F.lit(""))) != "").select(F.col("slug").alias("doc_type"), F.lit(True).alias("routable"))
    return docs.join(known, "doc_type", "left").withColumn("routable", F.coalesce("routable", F.lit(False)))


def doc_type_view(catalogue: DataFrame) -> DataFrame:
    """F24. Types that users choose from: those that are their own business type, and unknown."""
    own = catalogue.where(effective_doc_type(F.col("slug")) == F.col("slug"))
    shown = own.select("slug", "title", F.array_join(F.coalesce("required", F.array().cast("array<string>")), ",").alias("required"), "has_lines", F.coalesce("object", F.lit("")).alias("object"))
    unknown = catalogue.sparkSession.range(1).select(F.lit("unknown").alias("slug"), F.lit("Unknown").alias("title"), F.lit("").alias("required"), F.lit(False).alias("has_lines"), F.lit("").alias("object"))
    return shown.unionByName(unknown).withColumn("routable", F.trim("object") != "")


def classify_by_anchors(docs: DataFrame, catalogue: list[dict]) -> DataFrame:
    """J7. doc_id, doc_type, confidence: the weights of a type's anchors found in the text, summed and
    at most 1; the first best type. The catalogue (slug, anchors, weight) is compiled into one
    expression, so texts are read once and meet no join."""
    text = lower_e(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", text.alias("t"))
    scored = []
    for k, spec in enumerate(catalogue):
        weight = spec["weight"] if spec["weight"] > 0 else 0.5
        hits = sum((F.when(F.col("t").contains(a.lower().replace("ё", "е")), 1).otherwise(0) for a in spec["anchors"]), F.lit(0))
        scored.append(F.struct((hits * F.lit(weight)).alias("score"), F.lit(-k).alias("order"), F.lit(spec["slug"]).alias("slug")))
    best = F.array_max(F.array(*scored))
    rows = rows.select("doc_id", best.alias("b"))
    return rows.select("doc_id", F.when(F.col("b.score") > 0, F.col("b.slug")).otherwise("unknown").alias("doc_type"), F.least(F.col("b.score"), F.lit(1.0)).alias("confidence"))


def account_for_lines(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """J8. Adds account: of the first rule any of whose phrases the lower-cased name contains and whose
    types, if it has any, include the document's. Rules are compiled into one expression."""
    low = F.lower("name")
    cases = []
    for r in rules:
        hit = sum((F.when(low.contains(m), 1).otherwise(0) for m in r["match"]), F.lit(0)) > 0
        if r.get("doc_types"):
            hit = hit & F.col("doc_type").isin(*r["doc_types"])
        cases.append(F.when(hit, F.lit(r["account"])))
    return lines.withColumn("account", F.coalesce(*cases) if cases else F.lit(None).cast("string"))


def check_accounts_file(chart: DataFrame, references: DataFrame) -> DataFrame:
    """S8. Accounts that defaults or rules name and the chart lacks; a valid file has none."""
    return references.select("account").distinct().join(chart.select(F.col("code").alias("account")), "account", "left_anti")


def document_account(lines: DataFrame) -> DataFrame:
    """A11. Most frequent account of a document's lines; of equally frequent ones the smallest."""
    counts = lines.where("account is not null and account <> ''").groupBy("doc_id", "account").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id").agg(F.min_by("account", F.struct((-F.col("n")).alias("m"), "account")).alias("account"))


def apply_accounts(docs: DataFrame, lines: DataFrame, by_debit: DataFrame, by_type: DataFrame, credit_default: str, vat_default: str) -> DataFrame:
    """R8. Debit of the lines, else of the type; credit and VAT account by debit, type, default; no VAT
    account without a VAT amount. docs: doc_id, doc_type, vat (cents, null if none)."""
    rows = docs.join(document_account(lines).withColumnRenamed("account", "line_debit"), "doc_id", "left").join(by_type.select("doc_type", F.col("debit").alias("type_debit"), F.col("credit").alias("type_credit"), F.col("vat").alias("type_vat")), "doc_type", "left")
    rows = rows.withColumn("debit", F.coalesce("line_debit", "type_debit")).join(by_debit.select("debit", F.col("credit").alias("debit_credit"), F.col("vat").alias("debit_vat")), "debit", "left")
    vat = F.when(F.coalesce(F.col("vat"), F.lit(0)) > 0, F.coalesce("debit_vat", "type_vat", F.lit(vat_default)))
    return rows.select("doc_id", "debit", F.coalesce("debit_credit", "type_credit", F.lit(credit_default)).alias("credit"), vat.alias("vat_account"))


def check_accounts(fields: DataFrame) -> DataFrame:
    """R14. Where debit equals credit one goes: the debit if it is a supplier account, else the credit."""
    both = fields.where("key in ('account_debit', 'account_credit')").groupBy("doc_id").agg(F.max(F.when(F.col("key") == "account_debit", F.col("value"))).alias("d"), F.max(F.when(F.col("key") == "account_credit", F.col("value"))).alias("c"))
    supplier = F.substring_index("d", ".", 1).isin("60", "62", "76")
    drop = both.where("d = c and d <> ''").select("doc_id", F.when(supplier, "account_debit").otherwise("account_credit").alias("key"))
    return fields.join(drop, ["doc_id", "key"], "left_anti")


def required_fields(catalogue: DataFrame, tax_key: str = "unp", fallback: tuple[str, ...] = ("number", "date", "total")) -> DataFrame:
    """R1. doc_type, key: required keys of each type, the tax id by the locale; the fallback for unknown."""
    rows = catalogue.select(F.col("slug").alias("doc_type"), F.explode("required").alias("key"))
    other = catalogue.sparkSession.range(1).select(F.lit("unknown").alias("doc_type"), F.explode(F.array(*map(F.lit, fallback))).alias("key"))
    return rows.union(other).withColumn("key", F.when(F.col("key") == "@taxid", tax_key).otherwise(F.col("key")))


def missing_required(docs: DataFrame, fields: DataFrame, required: DataFrame) -> DataFrame:
    """R2. doc_id, missing: required keys that are absent, blank, or under confidence 0.5 unless manual."""
    known = required.select("doc_type").distinct().withColumn("known", F.lit(True))
    typed = docs.select("doc_id", "doc_type").join(F.broadcast(known), "doc_type", "left").select("doc_id", F.when(F.col("known"), F.col("doc_type")).otherwise("unknown").alias("doc_type"))
    asked = typed.join(F.broadcast(required), "doc_type")
    given = fields.where("trim(value) <> '' and (confidence >= 0.5 or source = 'manual')").select("doc_id", "key", F.lit(True).alias("given"))
    rows = asked.join(given, ["doc_id", "key"], "left")
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("given").isNull(), F.col("key")))), ",").alias("missing"))


def resolve_doc_type(c_rules: Column, rule_conf: Column, c_model: Column, evidence: Column) -> Column:
    """J20. Agreement of the rules' and the model's type: struct<doc_type, confidence>. ``evidence``: the
    head of the text names the model's type."""
    none_r, none_m = F.coalesce(c_rules, F.lit("unknown")) == "unknown", F.coalesce(c_model, F.lit("unknown")) == "unknown"
    pick = lambda t, c: F.struct(t.alias("doc_type"), F.round(F.least(c, F.lit(0.98)), 2).alias("confidence"))
    return (
        F.when(none_r & none_m, pick(F.lit("unknown"), F.lit(0.0)))
        .when(none_m, pick(c_rules, rule_conf * 0.9))
        .when(none_r, pick(c_model, F.when(evidence, 0.7).otherwise(0.5)))
        .when(c_rules == c_model, pick(c_rules, 0.75 + 0.25 * rule_conf))
        .when(evidence, pick(c_model, F.lit(0.55)))
        .otherwise(pick(c_rules, rule_conf * 0.7))
    )


def route_status(doc_type: Column, routable: Column, missing: Column, auto_export: bool = True, profile: str = "", require_mapping: bool = True) -> Column:
    """F15."""
    if not auto_export:
        return F.lit("needs_review")
    if profile == "type_inbox":
        return F.when(type_inbox_doc_type(doc_type).isNull(), "needs_review").otherwise("confirmed")
    known = F.coalesce(doc_type, F.lit("")).isin("", "unknown")
    return F.when(known, "needs_review").when(F.lit(require_mapping) & ~routable, "needs_review").when(F.coalesce(missing, F.lit("")) == "", "confirmed").otherwise("needs_input")


def final_status(records: DataFrame, companies: DataFrame, users: DataFrame, auto_export: bool = True, partial_export: bool = True, profile: str = "", test_logins: tuple[str, ...] = ()) -> DataFrame:
    """F16. id, status, job_kind. records: id, owner_id, company_id, doc_type, routable, missing,
    lines_mismatch, faulty, auto_pass."""
    missing = F.concat_ws(",", F.when(F.col("missing") != "", F.col("missing")), F.when(F.col("lines_mismatch"), "lines"))
    rows = records.withColumn("missing", missing).withColumn("routed", route_status(F.col("doc_type"), F.col("routable"), F.col("missing"), auto_export, profile))
    rows = rows.join(companies.select(F.col("id").alias("company_id"), "approval_required"), "company_id", "left").join(users.select(F.col("id").alias("owner_id"), "login"), "owner_id", "left")
    inbox = profile == "type_inbox"
    suspect = F.col("faulty") & F.lit(not inbox and not partial_export)
    owner = F.coalesce(F.col("login").isin(*test_logins), F.lit(False)) | (F.lit(inbox) & F.col("login").isNull())
    status = (
        F.when(suspect | owner, "needs_review")
        .when((F.col("routed") == "confirmed") & F.coalesce("approval_required", F.lit(False)) & ~F.col("auto_pass"), "needs_approval")
        .otherwise(F.col("routed"))
    )
    rows = rows.withColumn("status", status)
    job = F.when(F.col("status") == "confirmed", "create").when((F.col("status") == "needs_input") & F.lit(partial_export), "partial")
    return rows.select("id", "status", job.alias("job_kind"), "missing")


def needs_model_reason(records: DataFrame) -> DataFrame:
    """F13. First reason for a second pass, null if there is none."""
    reason = F.coalesce(
        F.when(F.coalesce("doc_type", F.lit("unknown")) == "unknown", "type unknown"), F.when(F.col("type_confidence") < 0.5, "type unsure"), F.when(F.coalesce("missing", F.lit("")) != "", "fields missing"),
        F.when(F.col("has_lines") & (F.col("n_lines") == 0), "no lines"), F.when(F.col("suspicious"), "table suspicious"),
    )
    return records.select("doc_id", reason.alias("reason"))


def recognition_faulty(records: DataFrame) -> DataFrame:
    """F17."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return records.select("doc_id", (~blank("faults") | ~blank("missing") | ~blank("rejected") | F.coalesce("doc_type", F.lit("")).isin("", "unknown")).alias("faulty"))


def catalogue_frame(spark: SparkSession, specs: list[dict]) -> DataFrame:
    rows = [(s["slug"], s.get("title", s["slug"]), s.get("synonyms", []), s["anchors"], float(s["weight"]), s.get("required", []), s.get("has_lines", False), s.get("object", ""), k) for k, s in enumerate(specs)]
    return spark.createDataFrame(rows, DOC_TYPES)
