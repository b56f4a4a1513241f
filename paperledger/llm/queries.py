"""The numbered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_path, table
from . import bpe, linear
from .collocations import collocations
from .exact_dedup import DigestIndex, buckets_for, exact_dedup
from .jaccard import jaccard_join
from .media_archive import media_features, read_archives, write_archives
from .mixing import mix
from .pii import BASE, find_pii, span_keys
from .simhash import simhash_dedup
from .suffix_dedup import suffix_dedup
from .token_planes import read_tokens, write_tokens
from .whitening import whiten
from .window_dedup import substring_dedup


#: Shares of the domains (good, low quality, toxic) in the mixture.
MIX_TARGETS = (0.80, 0.12, 0.08)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~linear.is_held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    scored = linear.score(docs, linear.train(docs, labels)).withColumn("score", F.col("scores")[0])
    return scored.select("doc_id", linear.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain number: 2 toxic, 1 low quality, 0 other."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("label"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")), MIX_TARGETS)
    return mixed.select("doc_id", "n_tokens", *(F.col("posteriors")[k].alias(f"p_{name}") for k, name in enumerate(("good", "low", "toxic"))), "rate")


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, root, digest=True)


def op4_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "media")
    write_archives(table(spark, sf_dir, "documents"), root)
    return media_features(read_archives(spark, root))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets=buckets_for(docs)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "n_intervals")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(span_keys(base), 256).alias("base_sha256"),
        span_keys(F.col("spans")).alias("spans"),
        count("iban"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), most=3, least=10, first=2000, inside=(50, 100))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash_dedup(table(spark, sf_dir, "documents"), size=3, radius=2)
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_shingles")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(table(spark, sf_dir, "embeddings"), components=8)
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))  # null beyond a long


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_planes": op3_token_planes,
    "op4_media_archive": op4_media_archive,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pii": op6_pii,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_collocations": op11_collocations,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        split AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
        grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM split, (VALUES (1), (2), (3)) AS lengths(k)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
        total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
        cuts AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:k], ' ') AS rest FROM c, (VALUES (1), (2)) AS places(j) WHERE j < k),
        scored AS (
            SELECT cuts.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.k = j AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.k = cuts.k - j AND y.phrase = rest),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        held AS (
            SELECT lang, part, max(a) AS longer FROM (
                SELECT lang, array_to_string(w[1:2], ' ') AS part, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY 1, 2),
        kept AS (SELECT best.* FROM best LEFT JOIN held ON held.lang = best.lang AND part = phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
}
