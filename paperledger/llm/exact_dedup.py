"""Exact deduplication against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest. A batch is reduced to one row for
each digest before anything is shuffled, a sort-merge anti-join finds the digests that the index
lacks, and those are appended. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import materialize, shared_path
from .common import look_up

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """A-Z to a-z, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Digests in a bucket of an index that is sized for a table (about 200 MB).
BUCKET_ROWS = 4_000_000


def buckets_for(docs: DataFrame, growth: int = 1) -> int:
    """How many buckets an index for ``growth`` tables of this size should have, 16 at least."""
    return max(16, -(-docs.count() * growth // BUCKET_ROWS))


class DigestIndex:
    """A bucketed, sorted table (digest, keep_id, added) under ``path``.

    ``buckets`` is fixed when the index is made: choose it so that a bucket of the full index is
    100 MB to 1 GB (a row takes about 50 bytes).
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 16) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets
        self.path = path or shared_path(spark, f"digest-index-{name}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, added BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, digests: DataFrame) -> DataFrame:
        """Rows whose digest the index lacks: sort-merge anti-join; the index side needs no shuffle."""
        return digests.join(self.read().hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Appends (digest, keep_id, added): one sorted file for each bucket."""
        rows = rows.select("digest", "keep_id", "added").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.insertInto(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Deduplicates ``docs`` against the index and appends what is new.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts in
    the batch the row with the largest id stays, unless the index has the text from an earlier
    batch: then none stays and keep_id is the index's. Returns for each input row: doc_id, keep_id,
    group_size (rows of the batch with that text), kept, text_sha256.

    Rows without an id take part: an id beats null, and a group of null ids alone keeps all its
    rows with keep_id null. If the kept id itself occurs more than once in the group, each of its
    rows counts as kept. An empty table gives an empty result; of other columns, those in ``carry``
    come back after the rest, and no more are read.
    """
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalized(F.col(text_col)), 256)).alias("digest"), *carry), "digests")
    groups = materialize(rows.groupBy("digest").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    total = rows.count()
    new = index.missing(groups)
    index.append(new.select("digest", F.col("best").alias("keep_id"), F.col("group_size").alias("added")))
    held = groups.join(index.read().select("digest", "keep_id"), "digest").select("digest", "keep_id", "group_size", (F.col("best").eqNullSafe(F.col("keep_id"))).alias("own"))
    held = materialize(held, "digest-held")
    found = look_up(rows, held, "digest", "group_size", total)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *carry,
    )
