"""SimHash fingerprints and links against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from paperledger.llm import simhash as S
from paperledger.llm.queries import op12_simhash_dedup

from . import brute, fixtures


def fingerprint(text, size=3):
    w = brute.WORD.findall((text or "").translate(brute.LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + size]).encode(), 42) for k in range(max(1, len(w) - size + 1))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def components(prints, radius):
    """Per fingerprint the fingerprints that links reach."""
    left, out = set(prints), {}
    while left:
        ahead = [left.pop()]
        own = set(ahead)
        while ahead:
            x = ahead.pop()
            new = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= new
            own |= new
            ahead += new
        out |= dict.fromkeys(own, frozenset(own))
    return out


def plain(rows, radius=2):
    prints = [fingerprint(t) for _, t in rows]
    reach = components(prints, radius)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        key = reach[p]
        if i is not None:
            least[key] = min(least.get(key, i), i)
    return sorted(((i, f"{p:016x}", least.get(reach[p])) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def corpus():
    """The fixture, near copies, tiny vocabularies, rows without an id, repeated ids."""
    r = random.Random(8)
    base = fixtures.prose(40, 300).split()
    rows = fixtures.rows() + [(1000 - k, " ".join(base[:p] + ["new"] + base[p:])) for k in range(40) for p in [r.randrange(300)]]
    rows += [(2000 + k, " ".join(r.choice("abc") for _ in range(r.randint(1, 6)))) for k in range(150)]
    return rows + [(None, "one two"), (None, None), (None, "nobody else says this"), (5, "one"), (5, "other"), (7, "one two three")]


def test_query(spark, tmp_path):
    rows = corpus()
    fixtures.table(spark, rows).withColumnRenamed("n", "fp").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_simhash_dedup(spark, str(tmp_path)).select("doc_id", "fingerprint", "component_id").collect()
    want = plain(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert len({x[2] for x in want}) < len({x[1] for x in want})


def test_long_texts_count_in_pieces(monkeypatch):
    from paperledger.llm import bytesops as B
    import pyarrow as pa

    texts = [t for _, t in fixtures.rows()]
    monkeypatch.setattr(S, "SHINGLES", 50)
    got, n = S.fingerprints(*B.utf8(pa.array(texts)), 3, 42)
    assert got.tolist() == [fingerprint(t) for t in texts] and n.max() > 8000


@pytest.mark.parametrize("parts", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("radius", [0, 2, 3])
def test_all_links(spark, monkeypatch, parts, radius):
    """Chains and balls of fingerprints, the outermost ones, and tiles of a few rows."""
    r = random.Random(parts)
    prints = {0, (1 << 64) - 1, 1 << 63, 3}
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            x ^= sum(1 << r.randrange(64) for _ in range(r.randint(1, 3))) & ((1 << 64) - 1)
    signed = [p - (p >> 63 << 64) for p in sorted(prints)]
    monkeypatch.setattr(S, "TILE", 3)
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    edges = [(a & ((1 << 64) - 1), b & ((1 << 64) - 1)) for a, b in S.near_edges(df, len(signed), radius, parts).collect()]
    assert all((a ^ b).bit_count() for a, b in edges)
    linked = {p: {p} for p in prints}
    for a, b in edges:
        both = linked[a] | linked[b]
        for x in both:
            linked[x] = both
    want = components(prints, radius)
    assert all(linked[p] == want[p] for p in prints)


def test_parts_follow_the_number():
    assert [S.parts_of(n) for n in (0, 10, 10**4, 10**6, 10**9, 10**13)] == [1, 1, 2, 4, 8, 16]


def test_forest():
    a, b = np.array([5, 6, 7, 1, 1], np.int64), np.array([6, 7, 8, 9, 2], np.int64)
    root, node = S.forest(a, b)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {6: 5, 7: 5, 8: 5, 9: 1, 2: 1}


def test_no_rows(spark):
    assert S.simhash_dedup(fixtures.table(spark, [(1, "a")]).limit(0)).collect() == []
