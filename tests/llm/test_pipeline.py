"""The pipeline's stages against brute-force versions on a small corpus."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from . import brute, fixtures
from .test_encoding import reference


def corpus(tmp_path, spark):
    r = random.Random(12)
    docs, labels = [], []
    for i in range(180):
        text = fixtures.prose(9000 + i, r.randint(30, 90))
        if i % 6 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text))
        labels.append((i, int(i % 6 != 0), 0))
    docs += [(200 + i, docs[i][1].upper()) for i in (1, 2, 3)] + [(210 + i, docs[i][1] + " tail") for i in (1, 4, 5)] + [(300, None), (301, "")]
    docs = [(i, t, "ende"[2 * (i % 2) :][:2], f"src{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return {i: t for i, t, *_ in docs}


def test_stages(spark, tmp_path):
    texts = corpus(tmp_path, spark)
    sf, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    at, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        at = spark.read.parquet(path)
        seen[name] = at
    ids = {n: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for n, df in seen.items()}

    good = [i for i in texts if i < 180 and i % 6]
    assert set(good) <= set(ids["quality"]) and not {i for i in texts if i < 180 and i % 6 == 0} & set(ids["quality"])

    exact = brute.exact([(i, texts[i]) for i in ids["quality"]])
    assert ids["exact_dedup"] == sorted(i for i, x in exact.items() if x[2])

    near = brute.jaccard([(i, texts[i]) for i in ids["exact_dedup"]], 5, 80, 100)
    assert ids["near_dedup"] == sorted(i for i, x in near.items() if x[1] == i)

    assert sorted(set(ids["mixture"])) == ids["near_dedup"] and len(ids["mixture"]) >= len(ids["near_dedup"])

    library = reference()
    rows = seen["encode"].select("doc_id", "n_tokens", "decoded_sha256", F.length("ids").alias("size")).collect()
    assert sorted(r["doc_id"] for r in rows) == ids["mixture"]
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert (r["n_tokens"], r["size"] // 4, r["decoded_sha256"]) == (len(library.encode_ordinary(t)), r["n_tokens"], brute.sha(t))
