"""Minimizers with more bytes than one suffix array holds are split by windows."""

import pyarrow as pa
from pyspark.sql import functions as F

from paperledger.llm import suffix_dedup as S

from . import brute, fixtures


def passages():
    """A passage in many documents, each with other surroundings, twice in some; a few rows have equal ones."""
    shared = fixtures.prose(1, 60)
    rows = [(k, fixtures.prose(100 + k, 12) + " " + shared + " " + fixtures.prose(400 + k, 9)) for k in range(70)]
    rows += [(200 + k, fixtures.prose(100 + k, 30) + shared[k:] + fixtures.prose(3, 20)) for k in range(10)]
    rows += [(300, shared + shared), (301, rows[4][1]), (302, rows[4][1][3:] + "!")]
    return rows


def test_split_minimizers(spark):
    done = S.suffix_dedup(fixtures.table(spark, passages()), part_bytes=4000, array_bytes=1500).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert fixtures.by_id(done, "n_bytes", "n_removed", "n_spans", "h") == brute.substrings(passages())


def test_suffix_arrays_are_bounded(monkeypatch):
    """No suffix array is larger than the bound, and none of the copies is lost."""
    bound, sizes, real = 1500, [], S.suffix_order
    monkeypatch.setattr(S, "suffix_order", lambda data, *rest: sizes.append(len(data)) or real(data, *rest))
    texts = pa.table({"doc_id": [i for i, _ in passages()], "text": [t for _, t in passages()]})
    sent = pa.Table.from_batches(list(S._send(100, 1)(iter(texts.to_batches()))))
    judged = S._judge(1, 100, bound)(sent)
    mask = judged.column("asked").to_numpy()
    fetched = S._fetch(100, 1)(texts, judged.filter(pa.array(mask)))
    parts = fetched.column("part").to_numpy()
    matched = [S._match(100, 1, bound)(fetched.filter(pa.array(parts == p))) for p in set(parts.tolist())]
    assert sizes and max(sizes) <= bound
    rows = S._remove(100)(texts, pa.concat_tables([judged.filter(pa.array(~mask)), *matched])).to_pylist()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(r["kept"])) for r in rows} == brute.substrings(passages())
