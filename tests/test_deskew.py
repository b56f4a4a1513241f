"""Deskewed coordinates against a plain version."""

import math

import pytest

from paperledger.operators import geometry
from paperledger.plans import queries

SHAPE = "doc_id bigint, page_no int, seq bigint, text string, x0 double, y0 double, x1 double, y1 double"


def straightened(words):
    """y0 and y1 of each word after deskewing, by all pairs of words of a band and half a band beside it."""
    out = {}
    for page in {w[:2] for w in words}:
        own = sorted((w for w in words if w[:2] == page), key=lambda w: w[2])
        top = min(w[5] for w in own)
        for w in own:
            lo = top + 160 * math.floor((w[5] - top) / 160)
            near = [x for x in own if lo - 80 <= x[5] <= lo + 240]
            s = sorted((o[5] - x[5]) / (o[4] - x[4]) for i, x in enumerate(near) for o in near[i + 1 :] if 150 <= o[4] - x[4] <= 2000 and abs(o[5] - x[5]) <= 1.2 * (x[7] - x[5]))
            k = s[len(s) // 2] if len(s) >= 12 and 0.020 <= abs(s[len(s) // 2]) <= 0.05 else 0.0
            out[w[0], w[2]] = (pytest.approx(w[5] - k * w[4], abs=1e-6), pytest.approx(w[7] - k * w[4], abs=1e-6))
    return out


def test_deskewed_coordinates(spark):
    """Skewed up, skewed down, too little, too much, and too few pairs."""
    words = []
    for doc, slope, lines in ((1, 0.03, 8), (2, -0.04, 8), (3, 0.005, 8), (4, 0.2, 8), (5, 0.03, 1)):
        for n in range(lines * 5):
            x0, y0 = 100.0 + 200 * (n % 5), 300.0 + 40 * (n // 5)
            words.append((doc, 1, n, "w", x0, y0 + slope * x0, x0 + 60, y0 + 20 + slope * x0))
    got = {(r["doc_id"], r["seq"]): (r["y0"], r["y1"]) for r in geometry.deskew(spark.createDataFrame(words, SHAPE)).collect()}
    assert got == straightened(words)
    flat = {n: 300.0 + 40 * (n // 5) for n in range(40)}
    for d in (1, 2):  # bands at the page's ends may lack pairs
        assert sum(got[d, n][0] == pytest.approx(y, abs=1e-6) for n, y in flat.items()) > 20
    assert got[3, 4][0] == pytest.approx(300 + 0.005 * 900) and got[5, 4][0] == pytest.approx(300 + 0.03 * 900)


def test_query_needs_the_coordinates(spark):
    """The query's plan computes slopes; a count alone would let Spark prune them."""
    words = spark.createDataFrame([(1, 1, 0, "w", 0.0, 0.0, 9.0, 9.0)], SHAPE)
    plan = queries.w12(words)._jdf.queryExecution().optimizedPlan().toString()
    assert "slope" in plan
