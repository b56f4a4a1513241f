"""The flows' logic on DataFrames: the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import hours

FEEDBACK = ("accepted", "posted", "rejected", "error")


def latest_feedback(events: DataFrame) -> DataFrame:
    """ST3. Newest valid feedback of each document."""
    valid = events.where(F.col("status").isin(*FEEDBACK))
    return valid.groupBy("doc_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("f")).select("doc_id", "f.*")


def unknown_feedback(events: DataFrame, documents: DataFrame) -> DataFrame:
    """ST3. Feedback to documents that don't exist."""
    return events.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def first_closing(events: DataFrame, closing: tuple[str, ...] = ("posted",)) -> DataFrame:
    """ST4. The first closing feedback archives a document; later ones don't move it."""
    return events.where(F.col("status").isin(*closing)).groupBy("doc_id").agg(F.min("ts").alias("archived_at"))


def export_attempts(events: DataFrame, most: int = 5) -> DataFrame:
    """ST2. State of each document's export after its attempts (error or posted): attempts count until
    the first success; failed after ``most``."""
    done = events.where("status = 'posted'").groupBy("doc_id").agg(F.min("ts").alias("done_at"))
    rows = events.join(done, "doc_id", "left").groupBy("doc_id").agg(F.max("done_at").alias("done_at"), F.count(F.when((F.col("status") == "error") & (F.col("ts") <= F.coalesce("done_at", "ts")), 1)).alias("failed"))
    status = F.when(F.col("done_at").isNotNull(), "done").when(F.col("failed") >= most, "failed").otherwise("pending")
    return rows.select("doc_id", status.alias("status"), F.least(F.col("failed"), F.lit(most).cast("bigint")).alias("attempts"))


def event_windows(audit: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """ST9. Actions of each actor in tumbling or sliding windows."""
    w = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    return audit.groupBy(w.alias("window"), "actor_id", "action").agg(F.count(F.lit(1)).alias("n"))


def event_sessions(audit: DataFrame, gap: str) -> DataFrame:
    """ST9. Sessions of each actor."""
    return audit.groupBy(F.session_window("created_at", gap).alias("session"), "actor_id").agg(F.count(F.lit(1)).alias("n"))


def retention_purge(documents: DataFrame, keep_days: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """ST6. Documents that stay, and an audit row for each that goes."""
    expired = F.coalesce(F.col("archived_at") < as_of - hours(24 * keep_days), F.lit(False)) if keep_days > 0 else F.lit(False)
    audit = documents.where(expired).select(F.lit("retention").alias("actor"), F.lit("purge").alias("action"), F.col("id").alias("entity_id"), as_of.alias("created_at"))
    return documents.where(~expired), audit
