"""Page geometry against plain versions."""

import random
from collections import Counter

from paperledger.operators import geometry

SHAPE = "doc_id bigint, page_no int, seq bigint, text string, x0 double, y0 double, x1 double, y1 double"


def test_tall_box_beside_lines(spark):
    """Small words beside a tall box open rows of their own, ten of them; a word as tall joins it, though."""
    words = [(d, 1, 0, "box", 0.0, 0.0, 50.0, 400.0) for d in (1, 2)]
    words += [(1, 1, 1 + k, f"line{k}", 100.0, 10.0 + 30 * k, 150.0, 30.0 + 30 * k) for k in range(10)]
    words += [(2, 1, 1 + k, "_", 100.0, 10.0 + 10 * k, 150.0, 10.0 + 10 * k) for k in range(10)]
    words += [(d, 1, 20, "last", 60.0, 150.0, 90.0, 470.0) for d in (1, 2)]
    got = {(r["doc_id"], r["seq"]): r["row_no"] for r in geometry.group_words_into_rows(spark.createDataFrame(words, SHAPE)).collect()}
    assert got == plain_rows(words)
    assert got[1, 20] == got[1, 0] and got[2, 20] == got[2, 0] and got[1, 1] != got[1, 0]


def test_irregular_pages(spark):
    """Touching rows, equal tops, boxes without height, many pages, some of one word: against all rows one by one."""
    r = random.Random(6)
    words = []
    for doc in range(40):
        for seq in range(r.choice([1, 5, 60])):
            y, x = float(r.randint(0, 120)), float(r.randint(0, 500))
            words.append((doc, 1 + seq % 2, seq, "w", x, y, x + 30, y + r.choice([0, 5, 10, 20, 60])))
    df = spark.createDataFrame(words, SHAPE)
    assert {(x["doc_id"], x["seq"]): x["row_no"] for x in geometry.group_words_into_rows(df).collect()} == plain_rows(words)
    got = {(x["doc_id"], x["page_no"]): x["density"] for x in geometry.rows_density(geometry.group_words_into_rows(df)).collect()}
    rows = {}
    for w in words:
        rows.setdefault(w[:2], []).append(plain_rows(words)[w[0], w[2]])
    for key, numbers in rows.items():
        sizes = [n for n in Counter(numbers).values() if n > 1]
        assert got[key] == (sum(sizes) / len(sizes) if sizes else 0.0)


def test_rows_by_top(spark):
    words = [(1, 1, k, "w", 0.0, y, 9.0, y + 10) for k, y in enumerate([0.0, 5.9, 6.0, 11.0, 12.0, 30.0])]
    assert [x["row_no"] for x in geometry.rows_by_top(spark.createDataFrame(words, SHAPE)).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 3]


def plain_rows(words):
    out = {}
    for page in {w[:2] for w in words}:
        rows = []  # top, bottom, seqs
        for w in sorted((w for w in words if w[:2] == page), key=lambda w: (w[5], w[4], w[2])):
            best = next((k for k, (t, b, _) in enumerate(rows) if min(w[7], b) - max(w[5], t) > 0.35 * max(b - t, 1)), None)
            if best is None:
                rows.append([w[5], w[7], [w[2]]])
            else:
                rows[best] = [min(w[5], rows[best][0]), max(w[7], rows[best][1]), rows[best][2] + [w[2]]]
        for n, k in enumerate(sorted(range(len(rows)), key=lambda k: (rows[k][0], k))):
            out |= {(page[0], seq): n for seq in rows[k][2]}
    return out
