import time
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperledger.llm import bytesops, linear, mixing, pii

from . import brute, fixtures


def labelled(n=240):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        text = fixtures.prose(5000 + i, r.randint(20, 120))
        if i % 3 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text))
        labels.append((i, int(i % 3 != 0)))
    return docs, labels


def test_features_brute_force():
    texts = ["a b a", "", None, "Hi! hi hi", "x"]
    index, text, words = linear.features(*bytesops.utf8(pa.array(texts)), 12)
    assert words.tolist() == [3, 0, 0, 3, 1]
    # two sizes of word grams, three of shape grams
    assert np.bincount(text, minlength=5).tolist() == [3 + 2 + 3 + 2 + 1, 0, 0, 3 + 2 + 3 + 2 + 1, 1 + 1]
    again = linear.features(*bytesops.utf8(pa.array(["zz", "a b a"])), 12)
    assert sorted(index[text == 0]) == sorted(again[0][again[1] == 1])


def test_ftrl_matches_plain_updates():
    r = np.random.default_rng(0)
    model = linear.Ftrl(6, alpha=0.3, beta=1.0, l1=0.01, l2=0.1)
    z, n = [0.0] * 6, [0.0] * 6

    def weight(i):
        if abs(z[i]) <= 0.01:
            return 0.0
        return -(z[i] - np.sign(z[i]) * 0.01) / ((1.0 + n[i] ** 0.5) / 0.3 + 0.1)

    for _ in range(60):
        at = r.choice(6, 3, replace=False)
        x, y = r.normal(size=3), float(r.integers(2))
        model.update(at, x, y)
        w = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
        for i, xi, wi in zip(at, x, w):
            g = (p - y) * xi
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * wi
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(6)])


def test_quality_held_out(spark):
    docs, labels = labelled()
    table = fixtures.table(spark, [*docs, (900, None), (901, ""), (None, "x")])
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (12345, 0)], "doc_id bigint, label int")
    weights = linear.train(table, marks.where(~linear.is_held_out(F.col("doc_id"))), bits=14, shards=2)
    scored = {r["doc_id"]: r["scores"][0] for r in linear.score(table, weights).collect()}
    held = [(i, y) for i, y in labels if brute.held_out(i)]
    assert len(held) > 50
    assert np.mean([(scored[i] >= 0.5) == y for i, y in held]) >= 0.97
    assert 0 < scored[900] == scored[901] < 1
    assert None in scored


def test_training_without_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, label int")
    weights = linear.train(fixtures.table(spark, []), none, bits=10)
    assert not weights.any()
    assert linear.score(fixtures.table(spark, []), weights).count() == 0


def test_held_out_rule(spark):
    got = spark.range(200).select("id", linear.is_held_out(F.col("id")).alias("h")).collect()
    assert {r["id"]: r["h"] for r in got} == {i: brute.held_out(i) for i in range(200)}


def plain_rates(tokens, p, targets, total, least, steps=4000):
    """The same objective by many small gradient steps of the rates scaled by tokens."""
    want = np.array(targets) / np.sum(targets) * total
    r = np.ones(len(tokens))
    a = p * tokens[:, None]
    inv = np.linalg.inv(p.T @ a)
    for _ in range(steps):
        r = np.maximum(r - 0.2 * p @ (inv @ (r @ a - want)), least)
    return r, r @ a


@pytest.mark.parametrize(("targets", "least"), [((0.5, 0.3, 0.2), 0.0), ((0.05, 0.05, 0.9), 0.0), ((0.4, 0.3, 0.3), 1.0)])
def test_rates(spark, targets, least):
    r = np.random.default_rng(3)
    tokens, p = r.integers(1, 200, 300), r.dirichlet((0.3, 0.3, 0.3), 300)
    members = spark.createDataFrame([(int(i), int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], mixing.SHAPE).repartition(3)
    total = float(tokens.sum()) * (1.0 if least == 0 else 1.3)
    steps, sums = mixing.fit_rates(members, targets, least, total)
    _, expected = plain_rates(tokens.astype(float), p, targets, total, least)
    assert np.allclose(sums, expected, rtol=2e-3)
    rows = mixing.with_rates(members, steps, 3, least).collect()
    rates = np.array([x["rate"] for x in sorted(rows, key=lambda x: x["doc_id"])])
    assert rates.min() >= least
    assert np.allclose(rates @ (p * tokens[:, None]), sums, rtol=1e-6)


def test_mix(spark):
    docs, labels = labelled(120)
    table = fixtures.table(spark, [*docs, (900, None), (None, "x y z")])
    marks = spark.createDataFrame(labels, "doc_id bigint, label int")
    rows = mixing.mix(table, marks, (0.5, 0.5)).collect()
    assert len(rows) == 122 and min(r["rate"] for r in rows) >= 0
    share = [sum(r["n_tokens"] * r["rate"] * r["posteriors"][k] for r in rows) for k in (0, 1)]
    assert share[0] == pytest.approx(share[1], rel=1e-2)
    grown = mixing.mix(table, marks, (0.5, 0.5), least=1.0, grow=True).select("doc_id", "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("n")).collect()
    assert min(r["n"] for r in grown) >= 1 and all(abs(r["n"] - r["rate"]) < 1 for r in grown)
    assert mixing.mix(fixtures.table(spark, []), marks, (1.0, 1.0)).count() == 0
    with pytest.raises(ValueError):
        mixing.fit_rates(spark.createDataFrame([], mixing.SHAPE), (-1.0, 2.0))


def test_growth_meets_targets(spark, recwarn):
    """Every document stays, and the copies have the shares that were asked, whatever total that takes."""
    r = np.random.default_rng(5)
    domain = r.choice(3, 600, p=[0.7, 0.2, 0.1])
    words = [[f"{a}{b}{'xyz'[d]}" for a in "bdfgklmnprst" for b in "aeiou"] for d in range(3)]
    texts = [(i, " ".join(r.choice(words[d], r.integers(20, 60)))) for i, d in enumerate(domain)]
    marks = spark.createDataFrame([(i, int(d)) for i, d in enumerate(domain) if i % 2], "doc_id bigint, label int")
    goal = np.array([0.4, 0.3, 0.3])
    n = mixing.copies(F.col("rate"), F.col("doc_id")).alias("n")
    rows = mixing.mix(fixtures.table(spark, texts), marks, list(goal), least=1.0, grow=True).select("*", n).collect()
    assert len(rows) == 600 and min(x["n"] for x in rows) >= 1
    for times in ("rate", "n"):
        sums = sum(np.array(x["posteriors"]) * x["n_tokens"] * x[times] for x in rows)
        assert np.abs(sums / sums.sum() - goal).max() < (0.0015 if times == "rate" else 0.02)
    by_domain = np.bincount(domain[[x["doc_id"] for x in rows]], weights=[x["n_tokens"] * x["n"] for x in rows])
    assert np.abs(by_domain / by_domain.sum() - goal).max() < 0.06  # posteriors are soft
    assert max(x["rate"] for x in rows) < 10
    assert not [w for w in recwarn if "mixture's shares" in str(w.message)]


def test_growth_out_of_reach(spark):
    """No rates reach the targets where no posterior does: the fit ends, everything stays, a warning says so."""
    members = spark.createDataFrame([(i, 10, [0.4, 0.6]) for i in range(40)], mixing.SHAPE)
    steps, sums = mixing.fit_rates(members, (0.8, 0.2), least=1.0, free=True)
    assert len(steps) <= 2 * mixing.STALLED and sums[0] / sums.sum() == pytest.approx(0.4)


PII_TEXTS = [
    None,
    "",
    "mail bob.smith+x@mail.example.co.uk or a@b, x@y.z., a@b@c.d e@@f.g @h.i",
    "😀😀 tel +1 (988) 555-2485 and +12 3 +123456789012345678 +1()()()2",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.0004 1.2.3 0000255.1.1.1",
    "card 4041894974608795 4041-8949-7460-8795 4041 8949 7460 8796 00000000000000000 1-2",
    "4041894974608795 4041894974608795",
    "iban DE89 3704 0044 0532 0130 00 konto, GB82WEST12345698765432 GB83WEST12345698765432",
    "ñ" * 50 + "é@x.y ü a1@x.y\nb2@z.w" + "漢" * 3 + "9.9.9.9",
    "a" * 30000 + " " + "1" * 30000 + "." * 3000 + "+" * 3000 + "1.1" * 4000,
    "x@" + "a." * 9000 + "b " + "1 2-3 " * 5000,
]


def test_pii(spark):
    rows = list(enumerate(PII_TEXTS))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(fixtures.table(spark, rows)).collect()}
    for i, t in rows:
        assert [s for s in got[i] if s[0] in pii.BASE] == brute.pii(t), i
        for kind, a, b in got[i]:
            assert kind != "iban" or t[a:b].replace(" ", "") in ("DE89370400440532013000", "GB82WEST12345698765432")
    assert sum(k == "iban" for s in got.values() for k, _, _ in s) == 2
    assert pii.find_pii(fixtures.table(spark, [])).count() == 0
    assert pii.find_pii(fixtures.table(spark, [(None, "a@b.c"), (None, "a@b.c")])).count() == 2


def test_pii_random(spark):
    r = random.Random(6)
    rows = [(i, "".join(r.choice("0123456789 .-+()@ab\n😀") for _ in range(r.randint(0, 120)))) for i in range(1500)]
    got = {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["spans"] if s["kind"] in pii.BASE] for x in pii.find_pii(fixtures.table(spark, rows)).collect()}
    assert got == {i: brute.pii(t) for i, t in rows}


def test_pii_score_and_mask(spark):
    rows = [(1, "call my phone +1 (988) 555-2485 now"), (2, "nothing " * 10 + "+1 (988) 555-2485"), (3, None)]
    found = {r["doc_id"]: [round(s["score"], 2) for s in r["spans"]] for r in pii.find_pii(fixtures.table(spark, rows)).collect()}
    assert found == {1: [0.7], 2: [0.6], 3: []}
    masked = fixtures.by_id(pii.mask_pii(fixtures.table(spark, [*rows, (4, "x a@1.2.3.4 y")])), "masked")
    assert masked == {1: ("call my phone <phone> now",), 2: ("nothing " * 10 + "<phone>",), 3: ("",), 4: ("x <email> y",)}


def test_pii_many_matches(spark):
    """Blocks of matches are placed one after the other; a text with very many takes seconds, not hours."""
    few = [(n, "".join(f"u{k}@h{k}.org é 10.0.{k % 300}.1 +49 30 {k:07d}; " for k in range(n))) for n in (1, 255, 256, 257, 700)]
    got = {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["spans"] if s["kind"] in pii.BASE] for x in pii.find_pii(fixtures.table(spark, few)).collect()}
    assert got == {i: brute.pii(t) for i, t in few}
    began = time.time()
    many = fixtures.table(spark, [(1, " ".join(f"u{k}@h{k}.org" for k in range(100_000)))])
    row = pii.find_pii(many).selectExpr("size(spans) n", "spans[99999] last").first()
    assert row["n"] == 100_000 and row["last"]["value"] == "u99999@h99999.org"
    assert time.time() - began < 60
