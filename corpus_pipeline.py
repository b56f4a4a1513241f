"""From raw documents to token ids in five stages; each works on all that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.cluster import materialize, table
from paperledger.llm import bpe, linear
from paperledger.llm.exact_dedup import DigestIndex, buckets_for, exact_dedup
from paperledger.llm.jaccard import jaccard_join
from paperledger.llm.mixing import copies, mix

#: Documents with a lower score are rejected.
QUALITY = 0.5
#: Target shares of the tokens by language.
MIX_TARGETS = {"en": 0.58, "de": 0.14, "fr": 0.14, "es": 0.14}


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to differ from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a key that no two share, and the key's name: the id where each row has one of its
    own; ids that are null or occur more than once make it a number that is written with the rows."""
    key = fresh(docs, "row_key")
    n, named, distinct = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == named == distinct:
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), f"pipeline-{name}-rows"), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects. It learns from labels of rows that aren't held out.

    Null texts count as empty and have the score of the bias alone; rows without an id are scored like
    others and teach nothing; repeated rows have one score and go or stay together; a score of exactly
    QUALITY stays. An empty table stays empty. Columns may have any names, n_words and scores too.
    """
    labels = table(spark, sf_dir, "labels").where(~linear.is_held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    weights = linear.train(docs, labels)
    inner = [c if c == "text" else f"column_{k}" for k, c in enumerate(docs.columns)]
    scored = linear.score(docs.toDF(*inner), weights, keep=tuple(inner), with_text=True)
    return scored.where(F.col("scores")[0] >= QUALITY).select(*(F.col(x).alias(c) for x, c in zip(inner, docs.columns, strict=True)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps one row: one with the largest id; without an id only if all lack one.

    Null texts equal empty ones. Of rows that share id and text, or lack the id and share the text,
    any one stays. An empty table stays empty. Columns may have any names, row_key too.
    """
    rows, key = keyed(docs, "exact")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets=buckets_for(rows))
    marked = exact_dedup(rows, index, carry=(key,))
    kept = marked.where("kept").groupBy("text_sha256").agg(F.min(key).alias(key))
    return rows.join(kept.select(key), key, "left_semi").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) keeps one row: one with the smallest id; without
    an id only if all lack one. Rows that share an id are judged each by its own text.

    Texts without words, null ones too, are near nothing and stay. Of repeated rows one stays. An
    empty table stays empty. Columns may have any names, row_key too.
    """
    rows, key = keyed(docs, "near")
    groups = jaccard_join(rows.select(F.col(key).alias("row"), "text"), id_col="row", size=5, num=80, den=100, count_links=False)
    groups = groups.select(F.col("doc_id").alias("row"), "component_id").join(rows.select(F.col(key).alias("row"), "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))["row"]
    kept = groups.groupBy("component_id").agg(first.alias(key))
    return rows.join(kept.select(key), key, "left_semi").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as its fitted rate says, in the mean, and one at least.

    The languages of the documents in ``labels`` train the classifier; all rows get posteriors, those
    without an id too, and rows that share an id are drawn each by its own rate. Null and empty texts
    have the rate of the bias' posteriors. Languages that no labelled document has take no part; with
    fewer than two that do, the rows stay as they are. Rows of equal id and text are drawn alike. An empty table
    stays empty. Columns may have any names, row_key and rate too.
    """
    rows, key = keyed(docs, "mixture")
    rate = fresh(rows, "rate")
    known = rows.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").where(F.col("lang").isin(*MIX_TARGETS))
    present = {r["lang"] for r in known.select("lang").distinct().collect()}  # one row for each language at most
    domains = [name for name in MIX_TARGETS if name in present]
    if len(domains) < 2:
        return rows.select(docs.columns)
    domain = F.coalesce(*(F.when(F.col("lang") == name, k) for k, name in enumerate(domains)))
    labels = known.select(F.col(key).alias("doc_id"), domain.alias("label"))
    rates = mix(rows.select(F.col(key).alias("doc_id"), "text"), labels, [MIX_TARGETS[name] for name in domains], least=1.0, grow=True)
    drawn = rows.join(rates.select(F.col("doc_id").alias(key), F.col("rate").alias(rate)), key)
    times = copies(F.col(rate), F.coalesce("doc_id", key))
    return drawn.select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(fresh(docs, "copy"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes that they decode to, and the ids, one row
    for each input row: null ids and repeated rows pass through, null texts count as empty and have no
    ids, an empty table gives an empty result, and other columns are not read."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("encode", encode)]

#: SQL can't express the trained stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
