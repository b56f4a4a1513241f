"""Rows without an id, and rows that share one, in the stages that decide on rows."""

from collections import Counter

import corpus_pipeline

from . import fixtures


def test_null_and_repeated_ids(spark, tmp_path):
    a, b, c, d, e = (fixtures.prose(9500 + k, 60) for k in range(5))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, c), (7, d), (8, d.upper()), (None, d), (None, e), (9, e + " tail"), (None, b + " tail"), (11, a + " one two")]
    docs = spark.createDataFrame([(i, t, "ende"[2 * (k % 2) :][:2]) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(3)
    spark.createDataFrame([(7,), (8,), (9,), (11,)], "doc_id bigint").write.parquet(str(tmp_path / "labels.parquet"))
    held = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    exact = corpus_pipeline.exact(spark, docs, str(tmp_path))
    assert exact.columns == docs.columns
    assert held(exact) == Counter([(None, a), (None, b), (7, c), (8, d.upper()), (None, e), (9, e + " tail"), (None, b + " tail"), (11, a + " one two")])

    near = held(corpus_pipeline.near(spark, docs, str(tmp_path)))
    assert sum(near.values()) == len(near) == 5
    assert {(7, c), (7, d), (9, e + " tail"), (11, a + " one two")} < set(near)
    assert len(set(near) & {(None, b), (None, b + " tail")}) == 1

    mixed = held(corpus_pipeline.mixture(spark, docs, str(tmp_path)))
    once = Counter(rows)
    assert set(mixed) == set(once) and all(n >= once[k] for k, n in mixed.items())
    # one language grows to its share, the other stays; no row is drawn once for each of its namesakes
    assert mixed[7, c] <= 2 * once[7, c] * max(1, max(n / once[k] for k, n in mixed.items() if once[k] == 1))


def test_clashing_names_and_empty_tables(spark, tmp_path):
    """Columns named like those that the stages use inside pass through with their values; an empty table stays empty."""
    rows = [(k, fixtures.prose(9600 + k, 40) if k % 5 else None, "ende"[2 * (k % 2) :][:2], f"s{k}", k + 0.5, 1000 + k, -k, f"x{k}", k) for k in range(20)]
    shape = "doc_id bigint, text string, lang string, scores string, rate double, row_key bigint, n_words int, digest string, copy int"
    docs = spark.createDataFrame(rows, shape)
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = {tuple(r) for r in out.collect()}
        assert got <= set(rows) and len(got) >= 16, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == 20
    assert corpus_pipeline.encode(spark, docs.limit(0), str(tmp_path)).count() == 0
