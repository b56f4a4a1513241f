"""A small table with every awkward case, and helpers."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def rows() -> list[tuple[int, str | None]]:
    """Ids out of order; nulls, empty and blank texts, copies in other case, near copies, shared
    passages, repeats inside one text, long words, text outside the basic plane, a very long text."""
    shared = prose(1, 40)
    base = prose(2, 120).split()
    out: list[tuple[int, str | None]] = [(50, None), (3, ""), (4, "  \n\t "), (5, "one"), (6, "one two"), (7, "one two three"), (8, "ONE two three"), (9, "one two three")]
    out += [(100 + k, prose(k, 30) + " " + shared + "\n" + prose(k + 50, 20)) for k in range(6)]
    out += [(200 - k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(0, 12, 2)]
    out += [(300, "be " * 400), (301, "be " * 150), (302, "x" * 3000 + " " + "x" * 400), (303, prose(9, 50) + " " + prose(9, 50))]
    out += [(310, "naïve 😀 漢字 " * 60), (311, "Ñandú 😀 漢字 naïve 😀 漢字 " * 30), (320, prose(77, 9000))]
    out += [(321, prose(77, 9000)[2000:9000]), (330, "a\x0bb\x0cc\rd " * 20), (331, "a b c d " * 20)]
    return out


def table(spark, data=None, extra=True):
    data = rows() if data is None else data
    if not extra:
        return spark.createDataFrame(data, "doc_id bigint, text string")
    # columns whose names the operators use inside
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in data], "doc_id bigint, text string, home int, digest string, n bigint").repartition(3)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
