"""Numbers of links against all pairs of texts."""

import random
from collections import Counter

import pytest

from paperledger.llm import jaccard

from . import brute, fixtures


def near_copies():
    """Groups of similar texts, some with exact copies, texts that link only some of their group, and short ones."""
    r, rows = random.Random(4), []
    for g, m in enumerate((14, 9, 3)):
        words = fixtures.prose(700 + g, 90).split()
        for k in range(m):
            w = list(words)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"new{r.random()}"
            rows += [(100 * g + 3 * k + c, " ".join(w)) for c in range(1 + (k % 4 == 0))]
    return rows + [(900, "one two"), (901, "ONE two"), (902, None), (903, "")]


@pytest.mark.parametrize("block_rows", [3, 1024])
def test_number_of_links(spark, monkeypatch, block_rows):
    rows = near_copies()
    sets = {i: brute.shingles(t, 3) for i, t in rows}
    want = {i: sum(j != i and len(x & y) * 100 >= 80 * len(x | y) > 0 for j, y in sets.items()) for i, x in sets.items()}
    assert max(want.values()) > 5 and len(Counter(want.values())) > 4
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(jaccard, "COUNT_ROWS", 2 * block_rows)
    args = dict(size=3, num=80, den=100)
    got = jaccard.jaccard_join(fixtures.table(spark, rows), **args)
    assert fixtures.by_id(got, "n_links") == {i: (n,) for i, n in want.items()}
    assert fixtures.by_id(got, "n_shingles", "component_id") == brute.jaccard(rows, **args)
    if block_rows == 3:
        assert fixtures.by_id(jaccard.jaccard_join(fixtures.table(spark, rows), **args, count_links=False), "n_shingles", "component_id") == brute.jaccard(rows, **args)
