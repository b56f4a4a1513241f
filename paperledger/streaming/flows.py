"""Structured Streaming forms of the flows. State is one row for each open document or job; watermarks
bound it. Each function takes a streaming DataFrame and returns one, or starts a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..cluster import ship_package
from . import batch as B

#: Closed documents are kept for three weeks, feedback is awaited for two days.
RETENTION, ACK = "21 days", "48 hours"


def stream_feedback(events: DataFrame, delay: str = RETENTION) -> DataFrame:
    """ST3. Newest valid feedback of each document, in update mode; repeats of an event within the
    watermark count once."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return B.latest_feedback(once)


def stream_archive(events: DataFrame, delay: str = RETENTION) -> DataFrame:
    """ST4. First closing feedback of each document, in update mode."""
    return B.first_closing(events.withWatermark("ts", delay))


def stream_ack_timeout(exports: DataFrame, feedback: DataFrame, timeout: str = ACK) -> DataFrame:
    """ST5. Exports (doc_id, exported_at) that had no feedback (doc_id, ts) within the timeout: a
    stream-stream left outer join, so a row comes when the watermark has passed its time."""
    e = exports.withWatermark("exported_at", "1 hour").select(F.col("doc_id").alias("export_doc"), "exported_at")
    f = feedback.withWatermark("ts", "1 hour")
    within = F.expr(f"doc_id = export_doc AND ts >= exported_at AND ts <= exported_at + INTERVAL {timeout}")
    return e.join(f.select("doc_id", "ts"), within, "leftOuter").where("ts is null").select(F.col("export_doc").alias("doc_id"), "exported_at")


QUEUE = "doc_id bigint, attempts bigint, status string, next_attempt_at timestamp"


def stream_export_queue(attempts: DataFrame, most: int = 5) -> DataFrame:
    """ST2. attempts (doc_id, ts, ok) to the state of each job after them: pending with the time of the
    next attempt (30 s, doubled each time, half an hour at most), done, or failed after ``most``."""
    ship_package(attempts.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, status = state.get if state.exists else (0, "pending")
        at = None
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            if status == "pending":
                at = row.ts
                if row.ok:
                    status = "done"
                else:
                    n += 1
                    status = "failed" if n >= most else "pending"
        state.update((n, status))
        due = at + pd.Timedelta(seconds=min(30 * 2**n, 1800)) if status == "pending" and at is not None else pd.NaT
        yield pd.DataFrame({"doc_id": [key[0]], "attempts": [n], "status": [status], "next_attempt_at": pd.Series([due], dtype="datetime64[ns]")})

    return attempts.groupBy("doc_id").applyInPandasWithState(step, QUEUE, "attempts bigint, status string", "update", GroupStateTimeout.NoTimeout)


def stream_event_windows(audit: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """ST9. Actions per window and actor; windows are final when the watermark has passed."""
    return B.event_windows(audit.withWatermark("created_at", delay), size, slide)


def stream_event_sessions(audit: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """ST9."""
    return B.event_sessions(audit.withWatermark("created_at", delay), gap)


def stream_notices(changes: DataFrame, devices: DataFrame) -> DataFrame:
    """ST8. A notice for each status change (doc_id, owner_id, status, onec_status) and device of the
    owner; browsers get none. devices is a static table."""
    from ..operators.store import notice_text

    told = changes.withColumn("notice", notice_text(F.col("status"), F.col("onec_status"))).where("notice is not null")
    to = devices.where("platform in ('android', 'ios')").select(F.col("user_id").alias("owner_id"), "platform", "token")
    return told.join(to, "owner_id").select("doc_id", "token", "platform", "notice.title", "notice.body")


def each_batch(stream: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """ST1, ST7. Runs ``merge`` on the rows of every micro-batch; what it writes should be keyed by
    document, so a repeated batch changes nothing."""
    return stream.writeStream.foreachBatch(lambda df, _: merge(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
