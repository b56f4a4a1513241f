"""Collocations and their graph against plain Python."""

import random
import re
from collections import Counter

import pytest

from paperledger.llm import collocations as C
from paperledger.llm.queries import op11_collocations

from . import brute, fixtures


def split(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(brute.LOWER)):
        if words := re.findall("[^\x20\x09]+", piece):
            yield words


def grams(rows, most):
    f = Counter()
    for lang, text in rows:
        for w in split(text):
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    return f


def plain(rows, most, least, first, inside):
    f = grams(rows, most)
    n = Counter()
    for (lang, p), c in f.items():
        if len(p) == 1:
            n[lang] += c
    found = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(c >= least and len(q) > len(p) and 100 * c >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), c in f.items() if other == lang):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in {x[0] for x in found}:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(lang, r + 1, *x[1:]) for r, x in enumerate(own[:first])]
    return sorted(out)


def corpus():
    """Nulls, empty texts, breaks of all kinds, repeats over themselves, a passage that many texts share, a very long text."""
    r = random.Random(3)
    words = "a b c d e straße 漢字 x-y é".split()
    passage = " ".join(f"P{k}" for k in range(40))
    rows = [(r.choice(["en", "de", None]), "".join(r.choice(words) + r.choice("     \t.,;:!?\n\r\x0b\x0c") for _ in range(120)).upper() if k % 3 else " ".join(r.choice(words) for _ in range(90))) for k in range(30)]
    rows += [("en", passage + ". " + r.choice(words) + " " + passage + " " + r.choice(words)) for _ in range(7)]
    rows += [("en", None), (None, ""), ("fr", " \t . ,"), ("fr", "be " * 500), ("und", "a b a b a b"), ("fr", "only once here"), ("en", fixtures.prose(5, 6000))]
    return rows


def docs(spark, rows):
    return spark.createDataFrame([(lang, text, 1, 2, "x") for lang, text in rows], "lang string, text string, f int, w1 int, phrase string").repartition(3)


@pytest.mark.parametrize(("most", "least", "first", "hot", "held"), [(3, 10, 2000, 1000, 1 << 21), (3, 2, 25, 20, 300), (2, 3, 40, 8, 300), (4, 3, 2000, 1000, 300)])
def test_collocations(spark, monkeypatch, most, least, first, hot, held):
    monkeypatch.setattr(C, "HOT", hot)
    monkeypatch.setattr(C, "HELD", held)
    rows = corpus()
    got = C.collocations(docs(spark, rows), most=most, least=least, first=first).collect()
    assert got and sorted(map(tuple, got)) == plain(rows, most, least, first, 50)


def test_paths(spark):
    """Every edge lies on one path; a path can't be made longer; its weight is that of each of its grams."""
    rows = corpus()
    f = grams(rows, 3)
    got = C.PhraseGraph(docs(spark, rows), 3, 3).paths().collect()
    edges = Counter()
    for lang, phrase, n_words, weight in got:
        w = tuple(phrase.split(" "))
        assert len(w) == n_words
        inner = [w[i : i + 3] for i in range(len(w) - 2)]
        assert {f[lang, e] for e in inner} == {weight} and all(f[lang, w[i : i + 2]] == weight for i in range(1, len(w) - 2))
        edges.update((lang, e) for e in inner)
        for node, near in ((w[-2:], [q for k, q in f if k == lang and q[:2] == w[-2:] and len(q) == 3]), (w[:2], [q for k, q in f if k == lang and q[1:] == w[:2] and len(q) == 3])):
            assert not any(f[lang, q] == f[lang, node] == weight for q in near)
    assert edges == Counter({k: 1 for k, c in f.items() if len(k[1]) == 3 and c >= 3})
    assert max(x.n_words for x in got) >= 40


def test_scores_beyond_64_bits(spark):
    g = C.PhraseGraph(docs(spark, [("en", "a b")]), 2, 1)
    big = 3_000_000_000
    g.grams = spark.createDataFrame([(1, 2, big), (1, 0, big), (2, 0, big + 1)], "w1 bigint, w2 bigint, f bigint")
    g.words = spark.createDataFrame([(1, "en", "a", big), (2, "en", "b", big + 1)], "w bigint, lang string, word string, f bigint")
    g.members = g._paths()
    (row,) = g.collocations().collect()
    assert row.score == 1_000_000 * big * big // (big * (big + 1)) == 999_999


def test_no_rows(spark):
    assert C.collocations(docs(spark, [("en", "")]).limit(0)).collect() == []
    assert C.collocations(docs(spark, [(None, None)])).collect() == []


def test_query(spark, tmp_path):
    rows = corpus()
    docs(spark, rows).drop("phrase").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op11_collocations(spark, str(tmp_path)).collect())) == plain(rows, 3, 10, 2000, 50)
