"""Collocations from a weighted de Bruijn graph of words.

1. Edges are the grams of the longest length, nodes those one word shorter; an edge leads from the node
   of its first words to that of its last words. Every occurrence of a word in a piece of text starts
   one edge, filled up with END where the piece ends: these are the corrections at the ends of pieces.
2. The weight of an edge is the number of its occurrences. What flows out of a node, its END edges
   included, is the number of the node's occurrences; summing nodes by their first words gives all
   shorter counts. Edges are dealt out by their first word, so that nearly all sums are complete where
   they are; those of a first word with more than a thousandth of all words by two words, and so on.
3. Edges and nodes of some weight stay. A node is unary if one edge that enters and one that leaves it
   have its whole weight; edges in a row over unary nodes are compacted to paths by pointer doubling.
   Inside a path every count is the path's weight; only at its two ends nodes are looked up.
4. Candidates are scored by their cuts in whole numbers, those inside longer ones drop out, and the first
   of each language are ranked, in shares of a language first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from . import bytesops as B

#: Edges that a task holds before it adds up equal ones.
HELD = 2 << 20
#: Words whose spellings a task holds before it reduces them to distinct ones.
SPELT = 1 << 19
#: Edges that begin with a gram are dealt out by one word more if more than one in HOT words starts it.
HOT = 1000
#: Shares in which a language's candidates are ranked first.
SHARES = 256
#: More than the words of the longest phrases.
DEEP = 16
#: Nothing follows in this piece.
END = 0

BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True


class Pieces:
    """The words of a slice of texts: start, end, text number, piece number and a hash that language and spelling give."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        raw, offsets = B.utf8(batch.column("text"))
        self.data = data = B.LOWER[raw]
        n = len(data)
        inside = ~GAP[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:n]
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        breaks = np.cumsum(BREAK[data], dtype=np.int64)
        self.piece = (breaks[self.start] if n else self.start) + self.text  # grows at a break and at a new text
        names, at = B.utf8(batch.column("lang"))
        lang = B.rolling_bytes(names).stretch(at[:-1], at[1:])
        h = B.mix(B.rolling_bytes(data).stretch(self.start, self.end) ^ B.mix(lang)[self.text])
        self.hash = np.where(h == END, B.U(1), h)

    def grams(self, most: int) -> list[np.ndarray]:
        """For every word itself and the words after it, END beyond the piece."""
        out = [self.hash]
        for k in range(1, most):
            w = np.zeros(len(self.hash), B.U)
            w[:-k] = np.where(self.piece[k:] == self.piece[:-k], self.hash[k:], B.U(END))
            out.append(w)
        return out


def added_up(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one with the sum of n. Rows of one first word come together, which compresses well."""
    if not len(n):
        return columns, n
    key, bits = np.zeros(len(n), B.U), 64
    mixed = np.zeros(len(n), B.U)
    for k, c in enumerate(columns):
        mixed = B.mix(mixed ^ c)
        take = bits if k == len(columns) - 1 else max(1, bits * 3 // 8)
        bits -= take
        key |= (mixed >> B.U(64 - take)) << B.U(bits)
    order = np.argsort(key)
    columns = [c[order] for c in columns]
    new = reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
    starts = np.flatnonzero(np.concatenate(([True], new)))
    return [c[starts] for c in columns], np.add.reduceat(n[order], starts)


def _key(columns: Sequence[np.ndarray]) -> np.ndarray:
    """One hash of the words of each gram."""
    return reduce(lambda h, c: B.mix(h ^ c), columns, np.full(len(columns[0]), len(columns), B.U))


def _edges(most: int, hot: list[tuple[int, ...]]):
    """w1 .. w_most, salt and n of the edges of a task.

    Edges are dealt out by their first word, those whose first word is hot by their first two, and so
    on. The salt is 0 for the first, else a hash of the words behind the first by which an edge is dealt
    out and, modulo DEEP, the number of words by which it is.
    """
    busy = [np.sort(_key([np.array(c, np.int64).view(B.U) for c in zip(*own, strict=True)])) for k in range(1, most) if (own := [h for h in hot if len(h) == k])]
    names = [*(f"w{k + 1}" for k in range(most)), "salt", "n"]

    def record(columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        salt = np.zeros(len(n), np.int64)
        on = np.arange(len(n))
        for k, keys in enumerate(busy, 1):  # a gram is hot only if all its beginnings are
            on = on[np.isin(_key([c[on] for c in columns[:k]]), keys)]
            salt[on] = (_key([c[on] for c in columns[1 : k + 1]]) >> B.U(52)).astype(np.int64) * DEEP + k + 1
        return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(salt.astype(np.int32)), pa.array(n)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            columns, n = added_up(columns, np.ones(len(columns[0]), np.int64))
            for k in range(0, len(n), 1 << 16):
                yield record([c[k : k + (1 << 16)] for c in columns], n[k : k + (1 << 16)])

        for batch in B.slices(batches):
            held.append(Pieces(batch).grams(most))
            size += len(held[-1][0])
            if size >= HELD:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _words(most: int):
    """Rows of two kinds: each task's distinct words (w, lang, word), and the grams shorter than edges that
    start at more than one in 2*HOT of the words held at a time (w null; gram and n)."""
    names = ["w", "lang", "word", "gram", "n"]
    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, B.U)  # what this task has sent since it last forgot
        held: list[list[np.ndarray]] = []
        size = 0
        busy: dict[tuple[int, ...], int] = {}

        def count() -> None:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            n = np.ones(size, np.int64)
            for length in range(most - 1, 0, -1):
                columns, n = added_up(columns[:length], n)
                for k in np.flatnonzero(n * 2 * HOT > size).tolist():
                    gram = tuple(int(c.view(np.int64)[k]) for c in columns)
                    busy[gram] = busy.get(gram, 0) + int(n[k])

        for batch in B.slices(batches):
            p = Pieces(batch)
            held.append(p.grams(most)[: most - 1])
            size += len(p.hash)
            if size >= HELD:
                count()
                held, size = [], 0
            h, first = np.unique(p.hash, return_index=True)
            new = first[~np.isin(h, seen, assume_unique=True)]
            seen = np.union1d(seen, h) if len(seen) < SPELT else h
            body = p.data.tobytes()
            spelt = [body[a:b] for a, b in zip(p.start[new].tolist(), p.end[new].tolist(), strict=True)]
            lang = batch.column("lang").take(pa.array(p.text[new])).cast(pa.string())
            none = [pa.nulls(len(new), t) for t in types[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(p.hash[new].view(np.int64)), lang, pa.array(spelt, pa.binary()).cast(pa.string()), *none], names=names)
        if size:
            count()
        none = [pa.nulls(len(busy), t) for t in types[:3]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(list(map(list, busy)), types[3]), pa.array(list(busy.values()), types[4])], names=names)

    return run


def _w(k: int, start: int = 1) -> list[str]:
    return [f"w{i}" for i in range(start, start + k)]


class PhraseGraph:
    """The counts and the compacted graph of the phrases with ``least`` occurrences or more.

    ``words``: w, lang, word, f of every word. ``grams``: w1 .. w_most (0 behind a shorter gram's last
    word) and f. ``links``: edges e1 .. that have one unary node before them, behind edge h1 ...
    ``members``: edge (e1 ..), first edge of its path (h1 ..), place in it (from 0) and f, the path's weight.

    Null texts count as empty, a null language as ``und``. Words are told apart by 64 bits of hash of
    language and spelling: among ten billion different words some two pairs would meet.
    """

    def __init__(self, docs: DataFrame, most: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> None:
        if not 2 <= most < DEEP or least < 1:
            raise ValueError(f"phrases have 2 to {DEEP - 1} words and occur")
        ship_package(docs.sparkSession)
        self.most, self.least = most, least
        docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        spelt = materialize(self._spelt(docs), "phrases-words")
        self.grams = materialize(self._grams(docs, self._hot(spelt)), "phrases-grams")
        one = self._of(1).select(F.col("w1").alias("w"), "f")
        self.words = materialize(spelt.where("w is not null").select("w", "lang", "word").join(one, "w"), "phrases-vocabulary")
        self.members = self._paths()

    def _of(self, k: int) -> DataFrame:
        """Grams of k words, those of one word all, and f."""
        at = F.col(f"w{k}") != END
        return self.grams.where(at if k == self.most else at & (F.col(f"w{k + 1}") == END)).select(*_w(k), "f")

    def _spelt(self, docs: DataFrame) -> DataFrame:
        rows = docs.mapInArrow(_words(self.most), "w bigint, lang string, word string, gram array<bigint>, n bigint")
        return rows.groupBy("w", "lang", "word", "gram").agg(F.sum("n").alias("n"))

    def _hot(self, spelt: DataFrame) -> list[tuple[int, ...]]:
        """At most 2*HOT grams of each length, among them all that start at one in HOT words or more.

        Of the occurrences of such a gram at least half are in stretches of text where it starts at one
        in 2*HOT words, so what is reported of it adds up to one in 2*HOT of all words.
        """
        reports = spelt.where("gram is not null").select("gram", "n")
        most = (reports.where(F.size("gram") == k).orderBy(F.desc("n"), "gram").limit(2 * HOT).collect() for k in range(1, self.most))
        return [tuple(r["gram"]) for rows in most for r in rows]

    def _grams(self, docs: DataFrame, hot: list[tuple[int, ...]]) -> DataFrame:
        m = self.most
        ws = _w(m)
        raw = docs.mapInArrow(_edges(m, hot), ", ".join([*(f"{w} bigint" for w in ws), "salt int", "n bigint"]))
        # all below is summed in the partition that has a first word's edges, or a share of a hot one's
        dealt = ["w1", "salt", *ws[1:]]
        flows = raw.repartition("w1", "salt").groupBy(*dealt).agg(F.sum("n").alias("n"))
        for k in range(m, 1, -1):
            # what flows out of a gram of k - 1 words, END included, is what it occurs; of grams of k words
            # stay those of some weight and shares of hot ones. The first word and the salt are not part of
            # what is exploded, so that Spark knows the rows to be dealt out by them still
            filled = [F.col(w) for w in ws[1 : k - 1]] + [F.lit(END).cast("long")] * (m - k + 1)
            of_k = F.lit(True) if k == m else F.col(ws[k]) == END
            from_k = F.struct(*(c.alias(w) for c, w in zip(filled, ws[1:], strict=True)))
            heavy = (F.col(ws[k - 1]) != END) & ((F.col("n") >= self.least) | (F.pmod("salt", F.lit(DEEP)) > k))
            rows = flows.select("w1", "salt", "n", F.explode(F.array(F.when(~of_k | heavy, F.struct(*ws[1:])), F.when(of_k, from_k))).alias("g")).where("g is not null")
            flows = rows.select("w1", *(F.col("g")[w].alias(w) for w in ws[1:]), "salt", "n").groupBy(*dealt).agg(F.sum("n").alias("n"))
        summed = flows.groupBy(*ws).agg(F.sum("n").alias("f"))
        return summed.where((F.col("f") >= self.least) | (F.col("w2") == END))

    def _paths(self) -> DataFrame:
        m = self.most
        edges, nodes = self._of(m), self._of(m - 1).where(F.col("f") >= self.least)
        node = _w(m - 1)
        # a node's whole weight in one edge on either side
        enters = edges.select(F.col("w1").alias("before"), *(F.col(b).alias(a) for a, b in zip(node, _w(m - 1, 2), strict=True)), "f").join(nodes, [*node, "f"])
        leaves = edges.select(*node, F.col(f"w{m}").alias("after"), "f").join(nodes, [*node, "f"])
        e, h = [f"e{k + 1}" for k in range(m)], [f"h{k + 1}" for k in range(m)]
        both = enters.join(leaves, [*node, "f"])
        links = both.select(*(F.col(w).alias(x) for w, x in zip([*node, "after"], e, strict=True)), *(F.col(w).alias(x) for w, x in zip(["before", *node], h, strict=True)), F.lit(1).cast("long").alias("place"), "f")
        self.links = state = materialize(links, "phrases-links")
        far = [F.col(f"far_{x}") for x in h]
        while True:
            # an edge that hangs on another one's place hangs on what that one hangs on
            step = state.select(*(F.col(x).alias(y) for x, y in zip(e, h, strict=True)), *(F.col(x).alias(f"far_{x}") for x in h), F.col("place").alias("more"))
            jumped = state.join(step, h, "left").select(*e, *(F.coalesce(x, F.col(y)).alias(y) for x, y in zip(far, h, strict=True)), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), "f", F.col("more").isNotNull().alias("on"))
            state = materialize(jumped, "phrases-paths")
            if state.where("on").isEmpty():
                break
        state = state.drop("on")
        alone = edges.toDF(*e, "f").join(state.select(*e), e, "left_anti")
        return materialize(state.unionByName(alone.select(*e, *(F.col(x).alias(y) for x, y in zip(e, h, strict=True)), F.lit(0).cast("long").alias("place"), "f")), "phrases-members")

    def paths(self) -> DataFrame:
        """lang, phrase (all words of a path), n_words and f. A path lies inside one piece of some text."""
        h, e = ([f"{x}{k + 1}" for k in range(self.most)] for x in "he")
        word = lambda c: self.words.select(F.col("w").alias(c), "lang", F.col("word").alias("word"))
        heads = self.members.where("place = 0").select(*h, F.posexplode(F.array(*(F.col(x) for x in e[:-1]))).alias("at", "w"))
        rest = self.members.select(*h, (F.col("place") + self.most - 1).cast("int").alias("at"), F.col(e[-1]).alias("w"))
        spelt = heads.unionByName(rest).join(word("w"), "w").groupBy(*h).agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
        weight = self.members.where("place = 0").select(*h, "f")
        return spelt.join(weight, h).select("lang", F.array_join(F.col("words")["word"], " ").alias("phrase"), F.size("words").alias("n_words"), "f")

    def _with_longest(self, k: int) -> DataFrame:
        """Grams of k words, f, and the most occurrences of a gram of k + 1 words that holds them."""
        m, ws = self.most, _w(k)
        grams = self._of(k).where(F.col("f") >= self.least)
        if k < m - 1:
            longer = self._of(k + 1)
            ends = [longer.select(*ws, "f"), longer.select(*(F.col(b).alias(a) for a, b in zip(ws, _w(k, 2), strict=True)), "f")]
        else:
            # nodes inside a path have its weight on both sides; other nodes are where paths begin and end
            inner = self.links.select(*(F.col(f"e{i + 1}").alias(w) for i, w in enumerate(ws)), "f")
            tails = self.members.join(self.links.select(*(F.col(f"h{i + 1}").alias(f"e{i + 1}") for i in range(m))), [f"e{i + 1}" for i in range(m)], "left_anti")
            ends = [inner, self.members.where("place = 0").select(*(F.col(f"e{i + 1}").alias(w) for i, w in enumerate(ws)), "f"), tails.select(*(F.col(f"e{i + 2}").alias(w) for i, w in enumerate(ws)), "f")]
        most = reduce(DataFrame.union, ends).groupBy(*ws).agg(F.max("f").alias("longer"))
        return grams.join(most, ws, "left").withColumn("longer", F.coalesce("longer", F.lit(0)))

    def collocations(self, first: int = 2000, inside: tuple[int, int] = (50, 100)) -> DataFrame:
        """lang, rank, phrase, a, l, r, n, score: the first ``first`` phrases of 2 to ``most`` words of each language.

        a: occurrences; cutting a phrase in two gives l and r, the occurrences of its parts, and the score
        floor(1000000 * a * a / (l * r)); the lowest score counts, of equal ones that of the shortest
        first part. Phrases inside a longer one with inside[0] / inside[1] of their occurrences or more
        drop out. n: all words of the language. Ranked by falling score, falling a, rising phrase (bytes).
        """
        parts = [self._candidates(k, inside) for k in range(2, self.most + 1)]
        rows = reduce(DataFrame.unionByName, parts)
        falling = [F.desc("score"), F.desc("a")]
        share = Window.partitionBy("lang", F.pmod(F.xxhash64(*_w(self.most)), F.lit(SHARES))).orderBy(*falling)
        rows = materialize(rows.withColumn("place", F.rank().over(share)).where(F.col("place") <= first).drop("place"), "phrases-candidates")
        for k in range(2, self.most):
            rows = rows.join(self.words.select(F.col("w").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
        middle = [F.when(F.col("size") > k, F.col(f"word{k}")) for k in range(2, self.most)]
        rows = rows.withColumn("phrase", F.concat_ws(" ", "first", *middle, "last"))  # concat_ws leaves nulls out
        in_share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*falling, "phrase")
        rows = rows.withColumn("place", F.row_number().over(in_share)).where(F.col("place") <= first)
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*falling, "phrase"))).where(F.col("rank") <= first)
        total = self.words.groupBy("lang").agg(F.sum("f").alias("n"))
        return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

    def _at(self, rows: DataFrame, words: list[str], name: str, known: Column | None = None) -> DataFrame:
        """``rows`` with the occurrences of the gram of ``words``; where ``known`` they are the row's own (a)."""
        k = len(words)
        if k == 1:
            spelling = [F.col("word").alias("first"), "lang"] if words == ["w1"] else [F.col("word").alias("last")]
            return rows.join(self.words.select(F.col("w").alias(words[0]), F.col("f").alias(name), *spelling), words)
        found = self._of(k).select(*(F.col(x).alias(y) for x, y in zip(_w(k), words, strict=True)), F.col("f").alias(name))
        if known is None:
            return rows.join(found, words)
        return rows.where(known).withColumn(name, F.col("a")).unionByName(rows.where(~known).join(found, words))

    def _candidates(self, k: int, inside: tuple[int, int]) -> DataFrame:
        m, ws = self.most, _w(k)
        whole = lambda c: c.cast("decimal(19,0)")
        if k < m:
            rows = self._with_longest(k).where(~(whole(F.col("longer")) * inside[1] >= whole(F.col("f")) * inside[0])).select(*ws, F.col("f").alias("a"))
            starts = ends = None
        else:
            followed = self.links.select(*(F.col(f"h{i + 1}").alias(f"e{i + 1}") for i in range(m)), F.lit(True).alias("followed"))
            edges = self.members.join(followed, [f"e{i + 1}" for i in range(m)], "left")
            rows = edges.select(*(F.col(f"e{i + 1}").alias(w) for i, w in enumerate(ws)), F.col("f").alias("a"), (F.col("place") > 0).alias("after"), F.col("followed").isNotNull().alias("before"))
            starts, ends = F.col("after"), F.col("before")  # behind, ahead of a unary node
        # occurrences of the first j words and of the rest, for each cut
        for j in range(1, k):
            rows = self._at(rows, ws[:j], f"l{j}", starts if j == m - 1 else None)
            rows = self._at(rows, ws[j:], f"r{j}", ends if k - j == m - 1 else None)
        cuts = []
        for j in range(1, k):
            score = F.call_function("div", whole(F.col("a")) * whole(F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)"), whole(F.col(f"l{j}")) * whole(F.col(f"r{j}")))
            cuts.append(F.struct(score.cast("long").alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
        best = F.array_min(F.array(*cuts))
        pad = [F.lit(END).cast("long").alias(f"w{i}") for i in range(k + 1, m + 1)]
        return rows.select(*ws, *pad, F.lit(k).alias("size"), "lang", "first", "last", "a", best["l"].alias("l"), best["r"].alias("r"), best["score"].alias("score"))


def collocations(docs: DataFrame, most: int = 3, least: int = 10, first: int = 2000, inside: Sequence[int] = (50, 100)) -> DataFrame:
    """The ``first`` collocations of each language in ``docs`` (lang, text); see PhraseGraph and its
    collocations for columns, rules and what nulls mean. A very long text is one unit of work in one
    task. Repeated rows count each. An empty table gives an empty result; other columns are not read."""
    return PhraseGraph(docs, most, least).collocations(first, tuple(inside))
