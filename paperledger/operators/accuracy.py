"""Accuracy against labelled sets, all over long rows (doc_id, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parties import party_key, same_key
from ..functions.text import doc_number_norm, norm_for_search
from .catalog import effective_doc_type

MONEY_KEYS = ("total", "vat_amount", "amount_no_vat")
NAME_KEYS = ("counterparty", "organization")


def same_value(key: Column, got: Column, want: Column) -> Column:
    """C28. Sums as money, names by containment, numbers without their sign, others normalised."""
    from ..functions.money import parse_money

    money = parse_money(got).eqNullSafe(parse_money(want)) & parse_money(want).isNotNull()
    return F.when(key.isin(*MONEY_KEYS), money).when(key.isin(*NAME_KEYS), same_key(party_key(got), party_key(want))).when(key == "number", doc_number_norm(got) == doc_number_norm(want)).otherwise(norm_for_search(got) == norm_for_search(want))


def compare_golden(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """J11. doc_id, key, expected, actual and outcome. Documents without a result have all keys missing.

    matched, mismatch, missing (blank counts), skipped (null is expected and nothing came), extra
    (null is expected and a value came), unexpected (the key isn't expected). One shuffle of each
    side by document serves this join and the aggregates by document after it.
    """
    e = expected.select("doc_id", "key", F.col("value").alias("expected"), F.lit(True).alias("asked")).repartition("doc_id")
    a = actual.select("doc_id", "key", F.col("value").alias("actual")).repartition("doc_id")
    known = expected.select("doc_id").distinct()
    a = a.join(known, "doc_id", "left_semi")
    rows = e.join(a, ["doc_id", "key"], "full_outer")
    got, want = F.trim(F.coalesce("actual", F.lit(""))), F.trim("expected")
    outcome = (
        F.when(F.col("asked").isNull(), "unexpected")
        .when(F.col("expected").isNull(), F.when(got == "", "skipped").otherwise("extra"))
        .when(got == "", F.when(want == "", "matched").otherwise("missing"))
        .when(got == want, "matched")
        .otherwise("mismatch")
    )
    return rows.select("doc_id", "key", "expected", "actual", outcome.alias("outcome"))


def _n(outcome: str) -> Column:
    return F.count(F.when(F.col("outcome") == outcome, 1))


def _counts() -> list[Column]:
    validated = F.count(F.when(F.col("outcome").isin("matched", "missing", "mismatch"), 1)).alias("validated")
    return [validated, *(_n(o).alias(o) for o in ("matched", "missing", "mismatch", "extra", "unexpected"))]


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(F.lit(0.0))


def document_accuracy(compared: DataFrame) -> DataFrame:
    """A3. Counts and accuracy of each document, and the keys that differ."""
    rows = compared.groupBy("doc_id").agg(*_counts(), F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome").isin("missing", "mismatch"), F.col("key")))), ",").alias("wrong_keys"))
    return rows.withColumn("accuracy", percent(F.col("matched"), F.col("validated")))


def golden_totals(compared: DataFrame) -> DataFrame:
    """A4. Totals, field accuracy, and the mean of the documents' accuracies."""
    rows = document_accuracy(compared).agg(
        F.count(F.lit(1)).alias("documents"), *(F.sum(c).alias(c) for c in ("validated", "matched", "missing", "mismatch", "extra", "unexpected")), F.round(F.avg(F.when(F.col("validated") > 0, F.col("accuracy"))), 2).alias("mean_accuracy")
    )
    return rows.withColumn("field_accuracy", percent(F.col("matched"), F.col("validated")))


def golden_field_report(compared: DataFrame) -> DataFrame:
    """A5. Each key's counts, most errors first."""
    rows = compared.groupBy("key").agg(*_counts()).withColumn("errors", F.col("missing") + F.col("mismatch")).withColumn("accuracy", percent(F.col("matched"), F.col("validated")))
    return rows.orderBy(F.desc("errors"), "accuracy", "key")


def field_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A1. Accuracy of each key by meaning, and over all (key null). Blank counts as missed."""
    rows = expected.where("value is not null").select("doc_id", "key", F.col("value").alias("want")).join(actual.select("doc_id", "key", F.col("value").alias("got")), ["doc_id", "key"], "left")
    blank = F.trim(F.coalesce("got", F.lit(""))) == ""
    right = ~blank & F.coalesce(same_value(F.col("key"), F.col("got"), F.col("want")), F.lit(False))
    rows = rows.rollup("key").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(right, 1)).alias("correct"), F.count(F.when(~blank & ~right, 1)).alias("wrong"), F.count(F.when(blank, 1)).alias("missed"))
    return rows.withColumn("pct", percent(F.col("correct"), F.col("total")))


def _types(expected: DataFrame, actual: DataFrame) -> DataFrame:
    want = expected.where("key = 'doc_type' and value is not null").select("doc_id", F.lower(F.trim("value")).alias("want"))
    return want.join(actual.where("key = 'doc_type'").select("doc_id", F.lower(F.trim("value")).alias("got")), "doc_id", "left")


def doc_type_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A2. Types that agree exactly and as business types."""
    exact = F.count(F.when(F.col("got") == F.col("want"), 1))
    business = F.count(F.when(effective_doc_type(F.col("got")) == effective_doc_type(F.col("want")), 1))
    rows = _types(expected, actual).agg(F.count(F.lit(1)).alias("total"), exact.alias("exact"), business.alias("business"))
    return rows.withColumn("exact_pct", percent(F.col("exact"), F.col("total"))).withColumn("business_pct", percent(F.col("business"), F.col("total")))


def category_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A8. Agreement per expected business type, and over all (category null)."""
    rows = _types(expected, actual).select(effective_doc_type(F.col("want")).alias("category"), effective_doc_type(F.col("got")).alias("found"))
    rows = rows.withColumn("hit", F.col("found") == F.col("category"))
    return rows.rollup("category").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("hit"), 1)).alias("matched"))


def status_and_source_counts(documents: DataFrame) -> DataFrame:
    """A6. Documents by status and by file extension, in one pass."""
    name = F.col("original_name")
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    rows = documents.select("status", ext.alias("extension"))
    rows = rows.select(F.explode(F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")), F.struct(F.lit("extension").alias("kind"), F.col("extension").alias("value")))).alias("x"))
    return rows.groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def unexpected_field_counts(compared: DataFrame) -> DataFrame:
    """A7. Keys that came without being expected, most common first."""
    return compared.where("outcome = 'unexpected'").groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def worst_documents(report: DataFrame, n: int = 15) -> DataFrame:
    """K2."""
    return report.where("validated > 0").orderBy("accuracy", F.desc("validated"), "doc_id").limit(n)


def worst_fields(report: DataFrame, n: int = 15) -> DataFrame:
    """K2."""
    return report.where("errors > 0").orderBy(F.desc("errors"), "accuracy", "key").limit(n)


def fields_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """J10. Keys whose values differ between two results."""
    b = before.select("doc_id", "key", F.col("value").alias("before"))
    rows = b.join(after.select("doc_id", "key", F.col("value").alias("after")), ["doc_id", "key"], "full_outer")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def all_field_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """U2."""
    return a.select("key").union(b.select("key")).distinct()


def unexpected_keys(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """U3."""
    return actual.select("key").distinct().join(expected.select("key").distinct(), "key", "left_anti")


def common_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4. Fields that both sources give with the same value."""
    norm = norm_for_search(F.col("value")).alias("value")
    return a.where("trim(value) <> ''").select("doc_id", "key", norm).intersect(b.select("doc_id", "key", norm))


def replay_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """A26. Documents (doc_id, mismatch, faulty) before and after a change of the rules."""
    rows = before.select("doc_id", F.col("mismatch").alias("m0"), F.col("faulty").alias("f0")).join(after.select("doc_id", F.col("mismatch").alias("m1"), F.col("faulty").alias("f1")), "doc_id", "full_outer")
    n = lambda c: F.count(F.when(F.col(c), 1))
    return rows.agg(F.count(F.lit(1)).alias("documents"), n("m0").alias("mismatch_before"), n("m1").alias("mismatch_after"), n("f0").alias("faulty_before"), n("f1").alias("faulty_after"))


def write_reports(compared: DataFrame, path: str) -> None:
    """S18. Per document and per field as CSV, totals as JSON."""
    document_accuracy(compared).write.mode("overwrite").option("header", True).csv(f"{path}/documents")
    golden_field_report(compared).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/fields")
    golden_totals(compared).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
