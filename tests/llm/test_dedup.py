import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperledger.llm import bytesops, jaccard, suffix_dedup
from paperledger.llm.components import connected_components
from paperledger.llm.exact_dedup import DigestIndex, exact_dedup
from paperledger.llm.jaccard import jaccard_join
from paperledger.llm.suffix_dedup import longest_previous_factor, suffix_order
from paperledger.llm.window_dedup import substring_dedup

from . import brute, fixtures


def test_exact(spark):
    got = fixtures.by_id(exact_dedup(fixtures.table(spark), DigestIndex(spark, "i1")), "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.exact(fixtures.rows())


def test_exact_second_batch(spark):
    index = DigestIndex(spark, "i2", buckets=3)
    exact_dedup(fixtures.table(spark, [(1, "a"), (2, "A"), (3, "b")]), index).collect()
    got = fixtures.by_id(exact_dedup(fixtures.table(spark, [(9, "a"), (10, "c"), (11, "C")]), index), "keep_id", "kept")
    assert got == {9: (2, False), 10: (11, False), 11: (11, True)}
    assert sorted(r["keep_id"] for r in index.read().collect()) == [2, 3, 11]
    plan = index.missing(index.read().select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_exact_null_ids_and_repeats(spark):
    got = exact_dedup(fixtures.table(spark, [(None, "z"), (None, "z"), (4, "y"), (4, "y"), (None, "y")]), DigestIndex(spark, "i3")).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in got) == [(0, False), (0, True), (0, True), (4, True), (4, True)]


@pytest.mark.parametrize("part_bytes", [1 << 24, 2000])
def test_windows(spark, part_bytes):
    done = substring_dedup(fixtures.table(spark), part_bytes=part_bytes).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h"))
    assert fixtures.by_id(done, "n_words", "n_removed", "h") == brute.windows(fixtures.rows())


@pytest.mark.parametrize("part_bytes", [1 << 24, 2000])
def test_substrings(spark, part_bytes):
    done = suffix_dedup.suffix_dedup(fixtures.table(spark), part_bytes=part_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert fixtures.by_id(done, "n_bytes", "n_removed", "n_spans", "h") == brute.substrings(fixtures.rows())


def test_longest_previous_factor():
    r = random.Random(3)
    for _ in range(30):
        width = 12
        data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(r.randint(40, 200))), np.uint8)
        starts = np.arange(len(data) - width + 1)
        place = np.array(r.sample(range(len(starts)), len(starts)))
        order, prefix = suffix_order(data, starts, width, place)
        got = longest_previous_factor(order, prefix, place, width) >= width
        text = data.tobytes()
        expected = [any(text[j : j + width] == text[i : i + width] and place[j] < place[i] for j in starts) for i in starts]
        assert got.tolist() == expected


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_jaccard(spark, size, num, den, monkeypatch):
    data = fixtures.rows()
    r = random.Random(size)
    for g in range(12):
        words = fixtures.prose(1000 + g, r.choice((8, 30, 90, 200))).split()
        for k in range(6):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"new{r.random()}"
            data.append((1000 + 10 * g + k, " ".join(w[: len(w) - r.randint(0, 4)])))
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)  # so that hubs have several blocks
    monkeypatch.setattr(jaccard, "BLOCK_COLUMNS", 16)
    got = fixtures.by_id(jaccard_join(fixtures.table(spark, data), size=size, num=num, den=den), "n_shingles", "component_id")
    assert got == brute.jaccard(data, size, num, den)


def test_part_hashes_meet():
    """Any two sets that link share a part hash, at the edges of what the sizes allow too."""
    r = random.Random(5)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        s = jaccard.Similarity(num, den)
        for _ in range(400):
            a = r.randint(1, 80)
            b = r.randint(a, min(2 * a, max(a, a * den // num)))
            least = -(-num * (a + b) // (num + den))
            if least > a:
                continue
            pool = np.array(r.sample(range(1 << 62), a + b - least), np.uint64) * np.uint64(4)
            x, y = np.sort(pool[:a]), np.sort(np.concatenate((pool[:least], pool[a:])))
            assert s.linked(np.array(least), np.array(a), np.array(b))
            if a == b == least:
                continue
            h, owner = jaccard.part_hashes(np.concatenate((x, y)), np.array([0, a, a + b]), s)
            assert set(h[owner == 0].tolist()) & set(h[owner == 1].tolist())


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_empty_tables_and_null_ids(spark):
    empty = fixtures.table(spark, [])
    assert exact_dedup(empty, DigestIndex(spark, "i4")).count() == 0
    for op in (substring_dedup, suffix_dedup.suffix_dedup, jaccard_join):
        assert op(empty).count() == 0
    long = fixtures.prose(3, 60)
    odd = fixtures.table(spark, [(None, long), (None, None), (7, long), (7, long)])
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup(odd).collect()) == [(0, 0), (0, 0), (7, 0), (7, 0)]
    assert odd.count() == suffix_dedup.suffix_dedup(odd).count() == 4
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_join(odd).collect()) == [(0, 0), (0, 0), (7, 7), (7, 7)]


def test_words_and_pack():
    w = bytesops.Words(*bytesops.utf8(__import__("pyarrow").array(["a bb\x0bc", None, "", " d", "e"])))
    assert w.counts.tolist() == [3, 0, 0, 1, 1]
    assert w.hash[0] != w.hash[2]
    a, b = np.arange(5, dtype=np.uint64) << np.uint64(60), -np.arange(5)
    for x, y in zip(bytesops.unpack(bytesops.pack(a, b), "ui"), (a, b), strict=True):
        assert x.tolist() == y.tolist()
