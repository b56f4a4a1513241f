"""Whitening against numpy and exact fractions."""

import math
import random

import numpy as np
import pytest

from paperledger.llm import whitening as W
from paperledger.llm.queries import op13_whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, n int, x int").repartition(3)


def corpus():
    """Groups of copies, one of a third of all rows, nulls, entries that are null or not finite, other lengths, repeated ids."""
    r = random.Random(1)
    vec = lambda: [r.gauss(0, 1 + k) + 0.5 * k for k in range(12)]
    rows = [(k, vec()) for k in range(150)]
    rows += [(200 + k, rows[k % 7][1]) for k in range(40)] + [(300 + k, rows[0][1]) for k in range(100)]
    odd = [None, [], [1.0], [math.nan] * 12, [None] * 12, [math.inf] + [0.0] * 11, [0.0] * 11 + [-math.inf], vec() + [1.0]]
    return rows + [(900 + k, v) for k, v in enumerate(odd)] + [(None, vec()), (5, vec())]


def plain(rows, d, weights="counts"):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = [v for _, v in kept] if weights == "counts" else [list(v) for v in {tuple(v) for _, v in kept}]
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in fit])
    return kept, n, s, y.T @ y / n


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitened(spark, weights):
    rows = corpus()
    kept, n, s, v = plain(rows, 12, weights)
    got = W.whiten(vectors(spark, rows), weights=weights).collect()
    assert sorted((r.vec_id, r.component) for r in got if r.vec_id is not None) == sorted((i, c + 1) for i, _ in kept for c in range(8) if i is not None)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    sign = {}
    by_id = {i: x for i, x in kept if i not in (5, None)}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-12
        if r.vec_id in by_id:
            x, c = by_id[r.vec_id], r.component - 1
            assert int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
            z = float(np.array([(n * a - b) / n for a, b in zip(x, s, strict=True)]) @ u[:, c] / math.sqrt(e[c]))
            assert sign.setdefault(c, 1 if r.whitened * z > 0 else -1) * z == pytest.approx(r.whitened, abs=1e-8)


def test_query(spark, tmp_path):
    rows = corpus()
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    kept, n, s, _ = plain(rows, 12)
    got = op13_whitening(spark, str(tmp_path)).collect()
    want = sorted(sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for _, x in kept for _ in range(8))
    assert sorted(r.deviation for r in got) == want
    z = {}
    for r in got:
        if r.vec_id not in (5, None):
            z.setdefault(r.vec_id, {})[r.component] = r.whitened
    assert len(z) == len(kept) - 3 and all(len(x) == 8 for x in z.values())


def test_large_entries_stay_exact():
    big = 1 << 61
    x = np.array([[big, -5], [-big, 7], [3, (1 << 63) - 1]], np.int64)
    s, n = [sum(c) for c in zip(*x.tolist(), strict=True)], 3
    assert [int(a) for a in W._total(np.array([1, 1, 1]), x)] == s
    assert W.deviations(x, s, n) == [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x.tolist()]
    assert np.allclose(W.centred(x, s, n), [[a - b / n for a, b in zip(v, s, strict=True)] for v in x.tolist()])


def test_degenerate(spark):
    one = W.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, "0", 0.0, 0.0, 1.0) for c in (1, 2)] * 2
    two = W.whiten(vectors(spark, [(1, [0.5, 0.25, 3.0]), (2, [0.25, 1.0, 3.0])])).collect()
    assert sorted((r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two) == [(1, 1.0, 1.0)] * 2 + [(2, 0.0, 0.0)] * 2 + [(3, 0.0, 0.0)] * 2
    huge = W.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert all(math.isfinite(r.whitened) for r in huge)
    for rows in ([(1, None)], [(1, [])], [(1, [math.nan])]):
        assert W.whiten(vectors(spark, rows)).collect() == []
    assert W.whiten(vectors(spark, [(1, [1.0])]).limit(0)).collect() == []
